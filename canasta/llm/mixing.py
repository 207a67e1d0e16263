"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end; the stream is cut into blocks of
equal words, at least ``LEAST_BLOCKS`` where it has so many words. Slot k of the mix takes the van der Corput
point of k, which falls into one source's piece of the cumulated shares. The r-th slot of a source takes block r mod
(its blocks), so passes repeat only after a whole pass, and a source's slots are spread evenly over the mix.
A source gets its whole number of slots: what the points give beyond is void, and what they leave out,
a few slots or all of a tiny source, follows after the last point. So the words taken are within about
half a block of the target, 1 % of it or one word.

Defined cases: a null text has size 0 and is never taken; a null source is a source, ordered last;
repeated rows are separate rows; an empty table gives an empty mix; sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import WORD, numbered, written
from canasta.session import broadcast_if_small

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Most words of a block, and the blocks that a source is cut into at least.
BLOCK = 64
LEAST_BLOCKS = 50
#: Cells of the unit interval that points and shares are matched by.
CELLS = 1024
#: Rows that are numbered together.
NUMBERED_TOGETHER = 100_000


def source_targets(sized: DataFrame, weights=WEIGHTS, max_passes=MAX_PASSES) -> DataFrame:
    """One row per source: number, size, rows, weight and target.

    Targets share all words by weight, stop at ``max_passes`` times the source, and the rest is shared
    again. With sources by cap / weight, those below the final level are capped: the level at a source is
    what is left by the capped ones before it, over the weights from it on. Windows run over one row per
    source.
    """
    stats = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    stats = stats.withColumn("source_no", F.row_number().over(by_name) - 1)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    stats = stats.withColumn("weight", F.get(cycle, F.pmod("source_no", F.lit(len(weights)))))
    stats = stats.withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / after
    stats = stats.withColumn("level", level)
    free = F.col("cap") > F.col("level") * F.col("weight")
    final = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(everything)
    stats = stats.withColumn("final", final["level"])
    return stats.withColumn(
        "target", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    ).select("source_no", "source", "source_size", "source_rows", "weight", "target")


def with_blocks(sources: DataFrame, block: int) -> DataFrame:
    """``sources`` with their block, in words, and number of blocks; the last one keeps what is left over (below
    two blocks)."""
    words = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {LEAST_BLOCKS}")))
    sized = sources.withColumn("block", words.cast("long"))
    return sized.withColumn("blocks", F.greatest(F.lit(1), F.expr("source_size div block")))


def schedule(sources: DataFrame, slots: int, max_passes=MAX_PASSES) -> DataFrame:
    """About ``slots`` slots: slot, source_no, pass, block_no.

    ``sources`` has source_no, blocks and share (summing to 1). Points and shares meet in cells of the
    unit interval, an equality join whose right side has at most a row per cell and source. Each source
    gets its share of the slots, rounded, and at most ``max_passes`` passes.
    """
    quota = F.least(F.round(F.col("share") * slots).cast("long"), F.col("blocks") * max_passes)
    sources = sources.withColumn("quota", F.coalesce(quota, F.lit(0).cast("long")))
    spark = sources.sparkSession
    ordered = Window.orderBy("source_no")
    upto = F.sum("share").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    pieces = sources.where("share > 0").withColumn("upto", upto)
    pieces = pieces.withColumn("from", F.coalesce(F.lag("upto").over(ordered), F.lit(0.0)))
    last = F.lead("upto").over(ordered).isNull()
    pieces = pieces.withColumn("upto", F.when(last, 1.0).otherwise(F.col("upto")))
    cell = lambda c: F.least(F.lit(CELLS - 1), F.floor(F.col(c) * CELLS))
    pieces = pieces.withColumn("cell", F.explode(F.sequence(cell("from"), cell("upto"))))
    bits = max(1, slots.bit_length())
    mirrored = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double")
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", mirrored / float(2**bits))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    taken = points.join(
        broadcast_if_small(pieces.select("cell", "source_no", "blocks", "from", "upto")), "cell"
    ).where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto")))
    taken = written(taken.select("slot", "source_no", "blocks"), "slots")
    bucket = F.expr(f"slot div {NUMBERED_TOGETHER}")
    ranked = numbered(taken, ["source_no"], bucket, ["slot"], "rank").select("slot", "source_no", "rank")
    given = taken.groupBy("source_no").agg(F.count(F.lit(1)).alias("given"))
    short = sources.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    short = short.where("quota > given").select("source_no", F.explode(F.sequence("given", F.col("quota") - 1)).alias("rank"))
    # after the points sources take turns, in the order of (slot, source_no)
    late = short.select((F.col("rank") + F.lit(slots)).alias("slot"), "source_no", "rank")
    every = ranked.union(late).join(broadcast_if_small(sources.select("source_no", "blocks", "quota")), "source_no")
    return every.where("rank < quota").select(
        "slot", "source_no", F.expr("rank div blocks").alias("pass"), F.pmod("rank", "blocks").alias("block_no")
    )


def sized_documents(docs: DataFrame, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """doc_id, source, size in words and the hash that shuffles and tells apart rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(body, F.col(doc_id)).alias("mark"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_passes=MAX_PASSES, block=BLOCK, **columns) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), mark.

    Only ids, sizes and hashes leave the scan. A source's stream is placed by hash buckets whose number
    follows its rows, slots by ranges of slots: no task holds a source.
    """
    sized = written(sized_documents(docs, **columns), "sized")
    sources = written(with_blocks(source_targets(sized, weights, max_passes), block), "sources")
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks")))
    sources = sources.withColumn("slots", F.coalesce(wanted, F.lit(0.0)))
    total = sources.agg(F.sum("slots")).first()[0] or 0.0
    shared = sources.withColumn("share", F.col("slots") / F.lit(total) if total else F.lit(0.0))
    used = schedule(shared, round(total), max_passes).groupBy("source_no", "block_no").agg(
        F.count(F.lit(1)).alias("times")
    )

    keyed = broadcast_if_small(sources.drop("weight", "slots"))
    rows = sized.join(keyed, sized["source"].eqNullSafe(keyed["source"])).drop("source")
    bucket = F.pmod(F.xxhash64("mark"), F.expr(f"1 + source_rows div {NUMBERED_TOGETHER}"))
    placed = numbered(rows, ["source_no"], bucket, ["mark", "doc_id", "size"], "place", "size", "start")
    at = lambda x: F.least(F.expr(f"({x}) div block"), F.col("blocks") - 1)
    cut = placed.withColumn(
        "block_no", F.explode(F.sequence(at("start"), F.greatest(at("start"), at("start + size - 1"))))
    )
    block_end = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("source_size")).otherwise(
        (F.col("block_no") + 1) * F.col("block")
    )
    words = F.least(F.col("start") + F.col("size"), block_end) - F.greatest("start", F.col("block_no") * F.col("block"))
    pieces = cut.withColumn("words", F.greatest(F.lit(0), words)).join(used, ["source_no", "block_no"], "left")
    return pieces.groupBy("source_no", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"),
        F.first("mark").alias("mark"),
    ).drop("source_no", "place")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken / size, rounded half up.

    A source's blocks are taken in order, so that at most one document of it is taken in part.
    Repeated rows are told apart by a running number.
    """
    names = options.get("doc_id", "doc_id"), options.get("text", "text")
    taken = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    same = Window.partitionBy("_id", "_mark").orderBy("_mark")
    counted = taken.select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), copies.alias("_copies")
    )
    counted = counted.withColumn("_again", F.row_number().over(same)).where("_copies > 0")
    body = F.coalesce(F.col(names[1]), F.lit(""))
    rows = docs.withColumn("_id", F.col(names[0])).withColumn("_mark", F.xxhash64(body, F.col(names[0])))
    rows = rows.withColumn("_again", F.row_number().over(same))
    matched = rows.alias("r").join(
        counted.alias("c"),
        F.col("r._id").eqNullSafe(F.col("c._id"))
        & (F.col("r._mark") == F.col("c._mark"))
        & (F.col("r._again") == F.col("c._again")),
    )
    repeated = matched.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("c._copies"))))
    return repeated.select(*(F.col(f"r.`{c}`") for c in docs.columns))
