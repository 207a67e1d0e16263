"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words; its weight is its count in the text times the mean inverse document
frequency of its words. Each text draws ``BANDS × ROWS`` consistent weighted samples; two texts draw the same
one with the probability of their weighted Jaccard similarity. Texts that agree on a whole band share a
bucket, and a pair is a link when its exact weighted Jaccard similarity is at least ``SIMILARITY``. Classes
are the connected components of the links. A pair at the threshold meets with probability
1 - (1 - 0.8⁴)^14 > 0.999.

Buckets of more than ``SMALL`` nodes are never expanded into pairs. Equal texts are one node from the start. In each
round a large bucket that still holds several classes compares a few leaders with its nodes of other classes, and
links join classes. Once a round no longer joins many, the texts left in such buckets meet by an exact prefix
filter on their rarest shingles (``prefix_pairs``). So no link between different classes is missed, while links within
a class need not be looked for. Pairs whose total weights alone rule out the threshold are left out.

Defined cases: a null text is an empty one; empty texts are equal, hence one class. A text of fewer than
five words is one shingle. Rows with equal ids are one document each; the class id is the least id of
the class. Texts without words other than blanks only equal themselves.

Document frequencies are counted for all documents in ``CELLS`` hash cells per word, a fixed size however many
words there are; words that share a cell share their frequency.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import small_batches, written
from canasta.llm.words import Ranges, mixed, window_starts, word_chunks

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 14
ROWS = 4
CELLS = 1 << 18
#: Nodes of a bucket up to which all its pairs are compared at once.
SMALL = 16
#: Leaders of a bucket and round.
LEADERS = 4

_TABLE = 1 << 16
_MASK = np.uint64(_TABLE - 1)


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of equal steps, by bisection."""
    p = (np.arange(_TABLE) + 0.5) / _TABLE
    low, high = np.zeros(_TABLE), np.full(_TABLE, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - np.exp(-x) * (1 + x) < p
        low, high = np.where(less, x, low), np.where(less, high, x)
    return x


_cache: dict = {}


def _tables():
    if "gamma" not in _cache:
        gamma = _gamma_table()
        _cache["gamma"] = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    return _cache["gamma"]


def cells_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def weighted_shingles(words, idf: np.ndarray):
    """(text number, shingle hash, weight) of the distinct shingles of each text, by text."""
    long = np.diff(words.first) >= SHINGLE
    starts = window_starts(words.first, SHINGLE)
    own = words.doc[starts]
    whole = np.flatnonzero(~long & (np.diff(words.first) > 0))
    hashes = Ranges(words.values)
    begin = np.concatenate([starts, words.first[whole]])
    end = np.concatenate([starts + SHINGLE, words.first[whole + 1]])
    doc = np.concatenate([own, whole])
    value = hashes(begin, end)
    sums = np.concatenate([[0.0], np.cumsum(idf[cells_of(words.values)], dtype=np.float64)])
    weight = (sums[end] - sums[begin]) / (end - begin)
    key = mixed(value + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    at, count = at[order], count[order]
    return doc[at], value[at], weight[at] * count


def bands_of(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Band hashes, texts × bands; rows of texts without shingles mean nothing."""
    gamma, log_gamma = _tables()
    out = np.zeros((texts, BANDS), np.uint64)
    if not len(doc):
        return out
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    sizes = np.diff(np.append(firsts, len(doc)))
    log_weight = np.log(weight).astype(np.float32)
    for band in range(BANDS):
        key = np.full(len(firsts), band + 1, np.uint64)
        for row in range(ROWS):
            salt = mixed(np.array([band * ROWS + row + 1], np.uint64))[0]
            z = mixed(value ^ salt)
            r = gamma[z & _MASK]
            shift = (z >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
            step = np.floor(log_weight / r + shift)
            a = log_gamma[(z >> np.uint64(16)) & _MASK] - r * (step - shift + 1)
            least = np.minimum.reduceat(a, firsts)
            hit = np.flatnonzero(a == np.repeat(least, sizes))
            chosen = hit[np.searchsorted(hit, firsts)]
            key = mixed(key ^ mixed(value[chosen] + step[chosen].astype(np.int64).astype(np.uint64)))
        out[doc[firsts], band] = key
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Inverse document frequency per cell, over all documents, and their number."""
    small_batches(docs.sparkSession)

    def count(batches):
        cells, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for at, end, words in word_chunks(batch.column(0)):
                rows += end - at
                key = np.unique(words.doc * CELLS + cells_of(words.values))
                cells += np.bincount(key % CELLS, minlength=CELLS)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(cells[used], rows))], ["cell", "n"]
        )

    found = docs.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = found.toPandas()
    total = int(counts.n[counts.cell < 0].sum())
    frequency = np.zeros(CELLS)
    some = counts[counts.cell >= 0]
    frequency[some.cell.to_numpy()] = some.n.to_numpy()
    return (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32), total


def signatures(docs: DataFrame, idf: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (of equal texts), bands (empty without shingles) and total weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            ids, nodes, texts = batch.columns
            for at, end, words in word_chunks(texts):
                doc, value, weight = weighted_shingles(words, shared.value)
                bands = bands_of(doc, value, weight, end - at)
                some = np.zeros(end - at, bool)
                some[doc] = True
                border = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(border), pa.array(bands[some].ravel().view(np.int64)))
                total = np.bincount(doc, weight, end - at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), nodes.slice(at, end - at), lists, pa.array(total)],
                    ["doc_id", "node", "bands", "weight"],
                )

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("node"), body.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, node binary, bands array<long>, weight double")


def similar_pairs(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity reaches ``threshold``.

    The b side's text is fetched first and the a side's last: a leader's text is shipped once, and where it
    leads many pairs the adaptive join splits them.
    """
    shared = docs_broadcast(pairs, idf)

    def verify(batches):
        for batch in batches:
            both = pa.concat_arrays([batch.column(2), batch.column(3)])
            n = batch.num_rows
            found: list = [None] * (2 * n)
            for at, _, words in word_chunks(both):
                doc, value, weight = weighted_shingles(words, shared.value)
                border = np.searchsorted(doc, np.arange(words.texts + 1))
                for i in range(words.texts):
                    own = slice(border[i], border[i + 1])
                    found[at + i] = value[own], weight[own]
            keep = []
            for i in range(n):
                (va, wa), (vb, wb) = found[i], found[n + i]
                _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
                shared_weight = np.minimum(wa[ia], wb[ib]).sum()
                total = wa.sum() + wb.sum() - shared_weight
                keep.append(bool(total > 0 and shared_weight >= threshold * total - 1e-9 * total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keep)], ["a", "b", "linked"]
            )

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(verify, "a binary, b binary, linked boolean").where("linked").select("a", "b")


def docs_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) of every node; the class is the least node that links lead to.

    Labels sink along links and are then followed one step further, until nothing changes; every round
    is written, so its cost and lineage stay those of one join.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(nodes.select("node", F.col("node").alias("class")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("near"))
        sunk = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "class", F.least("class", F.coalesce("near", "class")).alias("next")
        )
        roots = sunk.select(F.col("node").alias("root"), F.col("next").alias("further"))
        jumped = sunk.join(roots, sunk["next"] == roots["root"], "left").select(
            "node", "class", F.least("next", F.coalesce("further", "next")).alias("next")
        )
        step = written(jumped, "labels")
        changed = not step.where(F.col("class") != F.col("next")).isEmpty()
        labels = step.select("node", F.col("next").alias("class"))
        if not changed:
            return labels


def _others(rows: DataFrame) -> DataFrame:
    return rows.select(
        "bucket", F.col("node").alias("other"), F.col("class").alias("class_b"), F.col("weight").alias("weight_b")
    )


def _met(rows: DataFrame, others: DataFrame, order, threshold: float) -> DataFrame:
    """(a, b) of different classes that meet in a bucket and whose total weights allow the threshold."""
    fits = F.least("weight", "weight_b") >= F.greatest("weight", "weight_b") * (threshold - 1e-9)
    met = rows.join(others, "bucket").where((F.col("class") != F.col("class_b")) & order & fits)
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def leader_pairs(rows: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Pairs of each bucket's leaders of this turn with its nodes of other classes."""
    rank = Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    chosen = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= LEADERS)
    return _met(rows, _others(chosen), F.col("node") != F.col("other"), threshold)


def prefix_pairs(rows: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """All pairs of different classes that can reach the threshold, by an exact prefix filter.

    Shingles are put in one order, rare ones first. If two texts reach the threshold t, the first shingle that
    they share has, with those after it, at least t of either text's weight, and t / (1 + t) of both weights
    together. So only shingles of such a rest are emitted, and a text with more than 1 - t of its weight in
    shingles of its own meets nobody. Frequencies for the order are counted in ``CELLS`` cells among these texts.
    """
    members = rows.select("node", "class").distinct()
    found = written(texts.join(members, "node").select("node", "class", "text"), "open-texts")
    spark = found.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(idf)

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, words in word_chunks(batch.column(0)):
                cells += np.bincount(cells_of(weighted_shingles(words, weights.value)[1]), minlength=CELLS)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "n"])

    counts = found.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(CELLS, np.int64)
    frequency[counts.cell.to_numpy()] = counts.n.to_numpy()
    shared = spark.sparkContext.broadcast(frequency)

    def cut(batches):
        for batch in batches:
            nodes, classes, column = batch.columns
            for at, _, words in word_chunks(column):
                doc, value, weight = weighted_shingles(words, weights.value)
                order = np.lexsort((value, shared.value[cells_of(value)], doc))
                doc, value, weight = doc[order], value[order], weight[order]
                total = np.bincount(doc, weight, words.texts)
                border = np.searchsorted(doc, np.arange(words.texts + 1))
                through = np.concatenate([[0.0], np.cumsum(weight)])
                left = total[doc] - (through[:-1] - through[border[doc]])
                keep = left >= total[doc] * (threshold - 1e-9)
                own = pa.array(doc[keep] + at)
                arrays = [nodes.take(own), classes.take(own), pa.array(value[keep].view(np.int64)), pa.array(left[keep]), pa.array(total[doc[keep]])]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "class", "shingle", "left", "total"])

    schema = "node binary, class binary, shingle long, left double, total double"
    prefixes = written(found.select("node", "class", "text").mapInArrow(cut, schema), "prefixes")
    shared_shingles = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle")
    prefixes = written(prefixes.join(shared_shingles, "shingle"), "shared-prefixes")
    other = prefixes.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "class", "left", "total")])
    enough = F.least("left", "left_b") >= (F.col("total") + F.col("total_b")) * (threshold / (1 + threshold) - 1e-9)
    met = prefixes.join(other, "shingle").where((F.col("class") != F.col("class_b")) & (F.col("node") < F.col("node_b")) & enough)
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY
) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), node (its text) and class_no of every row of ``docs``."""
    idf, _ = document_frequencies(docs, text)
    signed = written(signatures(docs, idf, doc_id, text), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.max("weight").alias("weight"))
    nodes = written(nodes, "nodes")
    entries = nodes.select(F.explode("bands").alias("bucket"), "node", "weight")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    entries = written(entries.join(shared, "bucket"), "buckets")
    members = entries.select("node").distinct()

    # one text per compared node: that of its least document, by an exact test of the text's hash
    chosen = nodes.join(members, "node").select(F.col("node"), F.col("doc_id").alias("_id"))
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).cast("long").alias("_id"), F.unhex(F.md5(body.cast("binary"))).alias("node"), body.alias("text"))
    texts = written(found.join(chosen, ["_id", "node"]).dropDuplicates(["node"]).select("node", "text"), "texts")

    labels = members.select("node", F.col("node").alias("class"))
    links = checked = before = None
    turn = 0
    while True:
        turn += 1
        now = written(entries.join(labels, "node"), "classes")
        sizes = now.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")
        )
        open_buckets = written(sizes.where("classes > 1"), "open")
        large = open_buckets.where(F.col("n") > SMALL)
        apart = large.agg(F.sum(F.col("classes") - 1)).first()[0] or 0
        # leaders no longer join classes: what is left is compared by its rarest shingles
        last = before is not None and apart > before * 3 / 4
        before = apart
        rest = now.join(large.select("bucket"), "bucket")
        found = [prefix_pairs(rest, texts, idf, threshold) if last else leader_pairs(rest, turn, threshold)] if apart else []
        if turn == 1:
            few = now.join(open_buckets.where(F.col("n") <= SMALL).select("bucket"), "bucket")
            found.append(_met(few, _others(few), F.col("node") < F.col("other"), threshold))
        if not found:
            break
        pairs = reduce(DataFrame.union, found).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        fresh = written(similar_pairs(pairs, texts, idf, threshold), "linked")
        links = fresh if links is None else links.union(fresh)
        checked = pairs if checked is None else checked.union(pairs)
        labels = components(members, links)
        if last or not apart:
            break
    named = nodes.select("node", "doc_id").join(labels, "node", "left")
    named = named.withColumn("class", F.coalesce("class", "node"))
    least = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    classes = named.join(least, "class").select("node", "class_id", F.col("class").alias("class_no"))
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "node", "class_no")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: of the least id, then of the least
    text hash; of repeated rows one stays."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    classes = near_duplicates(docs, **options)
    name = lambda d, t: F.concat_ws(":", F.coalesce(F.col(d).cast("string"), F.lit("")), t)
    first = classes.groupBy("class_no").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    kept = first.select(name("first.doc_id", F.lower(F.hex("first.node"))).alias("__name"))
    body = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.withColumn("__name", name(doc_id, body)).join(kept, "__name")
    repeats = Window.partitionBy("__name").orderBy("__name")
    return rows.withColumn("__row", F.row_number().over(repeats)).where("__row = 1").select(docs.columns)
