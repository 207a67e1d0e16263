"""Benchmark decontamination by SimHash windows.

Texts are compared as words of letters and digits, lower-cased, in shingles of five words (all words for
shorter items). A window has as many words as a benchmark item. Windows are laid around all places where
enough of an item's shingles lie close together, in whatever order: a window below the threshold's share of
shared places cannot reach the similarity and is left out before it is made. Of the others those that end at
a shared place are made: moving a window back to such a place takes no shared shingle from it, so the
best window of a document and item is among them, and the first of equally good ones.

Each window and item gets a 64-bit SimHash of its shingles, the repeats of a shingle numbered and hashed
apart, so that the overlap of counts decides and not their squares. Fingerprints are
cut into ``BLOCKS`` blocks; if two differ in at most ``RADIUS`` bits, some block differs in at most
``RADIUS // BLOCKS``, so an index of the items' blocks with that many bits flipped finds every pair
within the radius. The radius is more than four deviations beyond what a similarity of 0.8 makes of 64
bits. Candidates are verified by the exact weighted Jaccard similarity: sum of the smaller over sum of
the larger counts.

Defined cases: texts and items that are null or have no word match nothing; a document shorter than an
item is one window; repeated rows are reported each; null ids are reported as null.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.llm.shared import written
from canasta.session import broadcast_if_small

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 23


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _rest(column: str, skip: int) -> Column:
    return F.slice(F.col(column), skip + 1, F.greatest(F.lit(0), F.size(column) - skip))


def _head(column: str, leave: int) -> Column:
    return F.slice(F.col(column), 1, F.greatest(F.lit(0), F.size(column) - leave))


def with_shingles(df: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """``df`` with arrays s1, s2, ... of the hashes of its shingles, up to the greatest of ``lengths``."""
    df = df.withColumn("s1", F.transform(words(text), lambda w: F.xxhash64(w)))
    for k in range(2, max(lengths, default=1) + 1):
        longer = F.zip_with(_head(f"s{k - 1}", 1), _rest("s1", k - 1), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"s{k}", longer)
    return df


def simhash(shingles: Column) -> Column:
    """Bit b is set when more shingles have it than not; repeats count."""

    def bit(b):
        votes = F.aggregate(shingles, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int") * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    every = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(every, F.lit(0).cast("long"), lambda whole, b: whole.bitwiseOR(b))


def occurrences(shingles: str) -> Column:
    """The shingles, of which the second, third, ... occurrence gets a hash of its own."""
    x = F.col(shingles)
    seen = lambda y, i: F.size(F.filter(F.slice(x, 1, i), lambda z: z == y))
    apart = F.transform(x, lambda y, i: F.when(seen(y, i) > 0, F.xxhash64(y, seen(y, i))).otherwise(y))
    return F.when(F.size(F.array_distinct(x)) == F.size(x), x).otherwise(apart)


def _block(fingerprint: str, number: Column) -> Column:
    bits = 64 // BLOCKS
    moved = F.call_function("shiftrightunsigned", F.col(fingerprint), number * bits)
    return moved.bitwiseAND((1 << bits) - 1)


def _flips() -> Column:
    bits = range(64 // BLOCKS)
    masks = [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(bits, n)]
    return F.array(*(F.lit(m).cast("long") for m in masks))


def _numbers() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays by the counts of their elements, which ``occurrences`` has told apart."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def slices(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``windows`` (mark, size, k, first) with own, the window's shingles.

    A text meets its windows as one list, so that its shingles are there once and not for every window.
    """
    lists = windows.groupBy("mark").agg(F.collect_list(F.struct("size", "k", "first")).alias("windows"))
    each = texts.join(lists, "mark").select("mark", *(f"s{i}" for i in lengths), F.inline("windows"))
    span = F.col("size") - F.col("k") + 1
    own = F.coalesce(*(F.when(F.col("k") == i, F.slice(f"s{i}", F.col("first") + 1, span)) for i in lengths))
    return each.select("mark", "size", "k", "first", own.alias("own"))


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, size in words, k (its shingles' length) and shingles of the items that have words."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    rows = with_shingles(rows, "text", [SHINGLE]).where(F.size("s1") > 0)
    k = F.least(F.lit(SHINGLE), F.size("s1"))
    chosen = F.get(F.array(*(f"s{i}" for i in range(1, SHINGLE + 1))), k - 1)
    return rows.select("item_id", F.size("s1").alias("size"), k.alias("k"), chosen.alias("shingles"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = SIMILARITY,
) -> DataFrame:
    """doc_id, mark, item_id, first_word and similarity of the best window of each document and item.

    The first pass explodes shingles and keeps those of the benchmark: nothing is shuffled while its
    shingles are few enough to broadcast. Only documents with enough of them are read again.
    """
    items = written(items_of(benchmark, item_id, item_text), "items")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    places = items.select("k", "item_id", "size", F.explode(F.array_distinct("shingles")).alias("shingle"))
    places = broadcast_if_small(places)
    shingled = with_shingles(rows.drop("doc_id"), "body", lengths)
    hits = None
    for k in lengths:
        # the outer form, as the inner one would filter by the array's size below every step that builds it
        own = shingled.select("mark", F.posexplode_outer(f"s{k}").alias("at", "shingle")).where("at is not null")
        found = own.join(places.where(F.col("k") == k), "shingle")
        found = found.select("mark", "item_id", "size", "k", "at")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return rows.limit(0).select("doc_id", "mark", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("first_word"), F.lit(0.0).alias("similarity"))
    spread = hits.groupBy("mark", "item_id", "size", "k").agg(F.sort_array(F.collect_set("at")).alias("places"))
    # windows that end at a shared place and have enough of them, wherever these lie in the item
    span = F.col("size") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.ceil(threshold * span - 1e-9).cast("int"))
    full = lambda at, i: (i >= need - 1) & (F.get("places", i - need + 1) > at - span)
    starts = F.transform(F.filter("places", full), lambda at: F.greatest(F.lit(0), at - span + 1))
    windows = spread.select("mark", "size", "k", F.explode(starts).alias("first")).distinct()
    windows = written(windows, "windows")

    marks = broadcast_if_small(windows.select("mark").distinct())
    again = rows.select("mark", "body").join(marks, "mark", "left_semi").dropDuplicates(["mark"])
    again = written(with_shingles(again, "body", lengths).select("mark", *(f"s{i}" for i in lengths)), "shingled")
    # of equal windows of a text the first one stands for all: repeated passages cost no more than one
    told = slices(again, windows, lengths).withColumn("content", F.xxhash64("own"))
    first = written(told.groupBy("mark", "size", "k", "content").agg(F.min("first").alias("first")), "first-windows")
    cut = slices(again, first, lengths)
    cut = written(cut.select("mark", "size", "first", occurrences("own").alias("votes")), "cuts")
    cut = written(cut.select("mark", "size", "first", "votes", simhash(F.col("votes")).alias("print")), "prints")

    probes = cut.select("mark", "size", "first", "print", _numbers().alias("block"))
    probes = probes.withColumn("value", _block("print", F.col("block")))
    index = written(items.select("item_id", "size", occurrences("shingles").alias("votes")), "votes")
    item_votes = index.select("item_id", F.col("votes").alias("item_votes"))
    index = index.select("item_id", "size", simhash(F.col("votes")).alias("item_print"))
    index = index.select("item_id", "size", "item_print", _numbers().alias("block"))
    index = index.withColumn("value", F.explode(F.transform(_flips(), lambda m: _block("item_print", F.col("block")).bitwiseXOR(m))))
    near = probes.join(broadcast_if_small(index), ["size", "block", "value"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.select("mark", "first", "size", "item_id").distinct()
    pairs = near.join(cut.select("mark", "first", "size", "votes"), ["mark", "first", "size"])
    pairs = pairs.join(item_votes, "item_id")
    scored = pairs.select("mark", "item_id", "first", similarity("votes", "item_votes").alias("similarity"))
    best = scored.where(F.col("similarity") >= threshold - 1e-9).groupBy("mark", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("first")).alias("back"))).alias("best")
    )
    best = written(best.select("mark", "item_id", (-F.col("best.back")).alias("first_word"), "best.similarity"), "leaks")
    return rows.select("doc_id", "mark").join(broadcast_if_small(best), "mark").select(
        "doc_id", "mark", "item_id", "first_word", "similarity"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item."""
    leaks = contaminated(docs, benchmark, text=text, **options).select(F.col("mark").alias("_leaked")).distinct()
    mark = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(broadcast_if_small(written(leaks, "leaked")), mark == F.col("_leaked"), "left_anti")
