"""Spelling variants: words at one insertion, deletion or replacement, by a dictionary of trie-node pairs.

All words are put into two tries, one of the words and one of the words reversed, and the nodes of both are
numbered in pre-order. A word cut before its character i is the pair (node of its first i characters, node of
the rest in the reversed trie); a word that skips character i is the pair of what is left on both sides. Two
words differ by a replacement when they skip the same place and leave the same pair, and by an insertion when
a skipping pair is the other's cut pair. All joins are on these two integers, so neighbours are exact.

The words of one pair differ in a single character, hence they are at most as many as there are characters.
Each learns how many the others are and which is the best of them; pairs of words are never listed. A
deletion out of a run of equal characters counts at the run's first place only.

Tries are built in sorted ranges of words: each range numbers its own nodes, and the path it shares with the
range before is mapped to that one's numbers. Only one row per range reaches the driver.

Defined cases: a null text has no words; a null id is the empty text where ids enter a hash; repeated rows count
again. Equal counts are ordered by code point. An empty table, or one without frequent words, gives no rows.
"""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.llm.shared import small_batches, written

#: Least code points of a word, and least occurrences.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often as the word.
RATIO = 5
#: One in so many (document, run) pairs loses a code point.
DROP_EVERY = 199
#: Words of one range of a trie.
RANGE_WORDS = 50_000


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    drop_every: int = DROP_EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word and n of all words of letters, after the deletions by hash, that are long and frequent enough.

    A shorter run cannot become a word, so the pattern leaves it out.
    """
    body = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = F.regexp_extract_all(body, F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("hash", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("hash") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = rows.select(F.when(F.col("hash") % drop_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def _range_paths(batches):
    """Node numbers, counted within this range of sorted words, along each word; the root is 0."""
    part, before, path, fresh = TaskContext.get().partitionId(), "", [0], 1
    for batch in batches:
        paths, words = [], batch.column(0).to_pylist()
        for word in words:
            kept = _common(before, word)
            path = path[: kept + 1] + list(range(fresh, fresh + len(word) - kept))
            fresh += len(word) - kept
            before = word
            paths.append(path)
        lists = pa.array(paths, pa.list_(pa.int64()))
        parts = pa.array([part] * len(words), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts, lists], ["word", "own", "part", "path"])


def trie_paths(words: DataFrame, n_words: int) -> DataFrame:
    """own and path of every row of ``words`` (word, own): the trie's node numbers from the root along the word.

    ``word`` is unique. Numbers rise in pre-order, so those of the last nodes are in the words' order.
    """
    small_batches(words.sparkSession)
    placed = words.select("word", "own").repartitionByRange(n_words // RANGE_WORDS + 1, "word").sortWithinPartitions("word")
    local = written(placed.mapInArrow(_range_paths, "word string, own long, part int, path array<long>"), "trie")
    ends = local.groupBy("part").agg(
        F.min("word").alias("first"),
        F.max("word").alias("last"),
        F.max(F.array_max("path")).alias("nodes"),
        F.max_by("path", "word").alias("path"),
    )
    rows, before, known, free = [], "", [0], 1
    for end in sorted(ends.toLocalIterator(), key=lambda r: r["part"]):
        kept = _common(before, end["first"])
        carried, shift = known[: kept + 1], free - kept - 1
        rows.append((end["part"], kept, carried, shift))
        known = [carried[x] if x <= kept else x + shift for x in end["path"]]
        free, before = free + end["nodes"] - kept, end["last"]
    # one row per range, each no longer than a word
    shifts = words.sparkSession.createDataFrame(rows, "part int, kept int, carried array<long>, shift long")
    numbers = F.transform(
        "path", lambda x: F.when(x <= F.col("kept"), F.get("carried", x.cast("int"))).otherwise(x + F.col("shift"))
    )
    return local.join(F.broadcast(shifts), "part").select("word", "own", numbers.alias("path"))


def node_pairs(words: DataFrame) -> DataFrame:
    """before, after, kind, no and n for every cut (kind 0) and skipped place (1; 2 within a run of equal characters).

    ``words`` has no, n, signs (the characters), path and back (the reversed word's path).
    """
    size = F.size("signs")
    skips = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("path", i).alias("before"),
            F.get("back", size - 1 - i).alias("after"),
            F.when((i > 0) & (F.get("signs", i) == F.get("signs", i - 1)), 2).otherwise(1).alias("kind"),
        ),
    )
    cuts = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(
            F.get("path", i).alias("before"), F.get("back", size - i).alias("after"), F.lit(0).alias("kind")
        ),
    )
    return words.select("no", "n", F.inline(F.concat(skips, cuts)))


def neighbours(pairs: DataFrame) -> DataFrame:
    """no, n_near (number of near words) and best (negative n and no of the most frequent one)."""
    members = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "no", "kind")))
    groups = pairs.groupBy("before", "after").agg(members.alias("all")).where(F.size("all") > 1)
    groups = groups.select(
        "all",
        F.filter("all", lambda x: x["kind"] > 0).alias("skips"),
        F.filter("all", lambda x: x["kind"] == 1).alias("firsts"),
        F.get(F.filter("all", lambda x: x["kind"] == 0), 0).alias("cut"),
    )
    named = lambda x: F.when(x.isNotNull(), F.struct(x["less"].alias("less"), x["no"].alias("no")))
    top, second = F.get("skips", 0), F.get("skips", 1)

    def seen(x):
        replaced = named(F.when(top["no"] == x["no"], second).otherwise(top))
        shorter = F.when(x["kind"] == 1, named(F.col("cut")))
        near = F.size("skips") - 1 + F.when((x["kind"] == 1) & F.col("cut").isNotNull(), 1).otherwise(0)
        is_cut = x["kind"] == 0
        return F.struct(
            x["no"].alias("no"),
            F.when(is_cut, F.size("firsts")).otherwise(near).alias("near"),
            F.when(is_cut, named(F.get("firsts", 0)))
            .otherwise(F.array_min(F.array(replaced, shorter)))
            .alias("best"),
        )

    told = groups.select(F.inline(F.transform("all", seen))).where("near > 0")
    return told.groupBy("no").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """no and root of ``forms`` (no, form_no): the end of the chain, which has at most ``longest`` steps.

    Each round doubles the reach of all pointers.
    """
    reach = written(forms.select("no", F.col("form_no").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        further = reach.select(F.col("no").alias("root"), F.col("root").alias("next"))
        reach = written(
            reach.join(further, "root", "left").select("no", F.coalesce("next", "root").alias("root")), "roots"
        )
    return reach


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``counts`` (word, n), whose words are unique."""
    counts = written(counts.select("word", "n"), "words")
    size, most, least = counts.agg(F.count(F.lit(1)), F.max("n"), F.min("n")).first()
    forward = trie_paths(counts.select("word", F.col("n").alias("own")), size).select(
        "word", F.col("own").alias("n"), "path", F.element_at("path", -1).alias("no")
    )
    forward = written(forward, "forward")
    back = trie_paths(forward.select(F.reverse("word").alias("word"), F.col("no").alias("own")), size)
    words = forward.join(back.select(F.col("own").alias("no"), F.col("path").alias("back")), "no")
    near = neighbours(node_pairs(words.withColumn("signs", F.split("word", ""))))
    form_n = -F.col("best.less")
    told = forward.select("word", "n", "no").join(near, "no", "left").select(
        "word",
        "n",
        "no",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form_n >= ratio * F.col("n"), F.col("best.no")).alias("form_no"),
        F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n"),
    )
    told = written(told, "near-words")
    # each form occurs `ratio` times as often as its word
    longest = int(math.log(max(1, (most or 1) / (least or 1)), ratio)) + 1
    ends = roots(told.where("form_no IS NOT NULL"), longest)
    names = told.select(F.col("no").alias("form_no"), F.col("word").alias("form"))
    root_names = told.select(F.col("no").alias("root"), F.col("word").alias("root_word"))
    linked = told.where("form_no IS NOT NULL").join(names, "form_no").join(ends, "no").join(root_names, "root")
    none = F.lit(None).cast("string")
    alone = told.where("form_no IS NULL").select("word", none.alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n").union(alone)
