"""Collocations: phrases of two to four words, grown best-first with bounds from prefix counts.

A phrase of count a, cut into a first part (count l) and a rest (count r), scores floor(2000000 a / (l + r)) at
its lowest-scoring cut. A phrase that begins with prefix q and word w occurs at most f(q) times, and its rest after w
at least as often as itself: so no phrase grown from q scores more than 2000000 f(q) / (f(w) + f(q)).
Words and pairs are counted whole. Then the frontier is expanded for each language: only prefixes whose bound
reaches a target are grown to triples and quadruples, and only phrases that reach it are also grown to the
left, where a longer phrase may absorb them. A language is settled when, at its target, enough phrases survive,
ties included; else its target sinks and the frontier reaches further, until nothing is left to grow.

A phrase goes when a longer one, itself frequent, holds it and occurs at least 0.8 times as often. It is enough
to look one word further: the count of what lies between is no lower.

Words are named by 64-bit hashes of language and word, which are tested against a second hash: on a clash all is
counted again with other names. Phrases are tuples of names, so counts are exact. Which phrases to
count is told to the tasks by bit maps of ``CELLS`` hash cells, whatever their number; cells that clash only make
some more phrases be counted. Counting sums in the tasks first; no table of phrases is collected.

Defined cases: a null text has no words, a null language is ``und``. Ids play no part: rows count as often
as they occur. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import small_batches, written
from canasta.llm.words import BYTE_VALUES, chunks, mixed, texts_of, words_of
from canasta.session import broadcast_if_small

LEAST_COUNT = 30
LONGEST = 4
PER_LANGUAGE = 2000
SCALE = 2_000_000
NO_LANGUAGE = "und"
CELLS = 1 << 25
#: The first target is the score of this many times the wanted phrases, and each later one of so many times more.
FIRST_REACH, FURTHER = 4, 8

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = _BREAKS.copy()
_SPACE[[0x20, 0x09]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9FB21C651E98DF25)

#: A bit map's test: phrases of so many words, from so many words after the start, must be in the map.
Test = tuple[int, int, bytes]


def _pieces(batch: pa.RecordBatch, salt: int):
    """(names, second hashes, languages, whether the next word is of the same piece, words) of a batch's chunks."""
    data, offsets = texts_of(batch.column(0))
    language = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
    for at, end in chunks(offsets):
        words = words_of(data, offsets[at : end + 1], _SPACE, BYTE_VALUES[_LOWER])
        own = language[at:end][words.doc]
        names = mixed(words.values + mixed(own + np.uint64(salt)))
        second = mixed((words.values ^ _STEP) * _STEP) ^ own
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[words.data])])
        joined = np.zeros(len(names), bool)
        joined[:-1] = (words.doc[1:] == words.doc[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
        yield names, second, own, joined, words


def _keys(names: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1 to ``size`` words from each place; those that leave the piece mean nothing."""
    keys = [names]
    for extra in range(1, size):
        further = np.zeros_like(names)
        further[: len(names) - extra] = keys[-1][: len(names) - extra]
        further[: len(names) - extra] = mixed(further[: len(names) - extra] * _STEP + names[extra:])
        keys.append(further)
    return keys


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _places(keys, joined, size, tests) -> np.ndarray:
    """Starts of the phrases of ``size`` words that pass all tests of one of the lists ``tests``."""
    whole = np.ones(max(0, len(joined) - size + 1), bool)
    for i in range(size - 1):
        whole &= joined[i : i + len(whole)]
    at = np.flatnonzero(whole)
    some = np.zeros(len(at), bool)
    for every in tests:
        ok = np.flatnonzero(~some)
        for level, shift, bits in every:
            ok = ok[_inside(bits, keys[level - 1][at[ok] + shift])]
        some[ok] = True
    return at[some]


@dataclass
class Corpus:
    """text and language hash of all documents, and the names' salt."""

    rows: DataFrame
    salt: int = 0

    def _map(self, function, schema: str) -> DataFrame:
        small_batches(self.rows.sparkSession)
        return self.rows.select("text", "lang_no").mapInArrow(function, schema)

    def words(self) -> DataFrame:
        """w1 (the name), least and most second hash, lang_no and n of every word."""
        salt = self.salt

        def count(batches):
            for batch in batches:
                for names, second, own, _, _ in _pieces(batch, salt):
                    pair = mixed(names + second)  # equal only if both are, but for one in 2^64
                    _, at, n = np.unique(pair, return_index=True, return_counts=True)
                    arrays = [names[at].view(np.int64), second[at].view(np.int64), own[at].view(np.int64), n]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["w1", "second", "lang_no", "n"])

        found = self._map(count, "w1 long, second long, lang_no long, n long")
        return found.groupBy("w1").agg(
            F.sum("n").alias("n"),
            F.min("second").alias("least"),
            F.max("second").alias("most"),
            F.min("lang_no").alias("lang_no"),
        )

    def phrases(self, size: int, tests: list[list[Test]], least: int) -> DataFrame:
        """key, w1 to w<size> and n of the phrases that pass ``tests`` and occur ``least`` times."""
        salt = self.salt
        context = self.rows.sparkSession.sparkContext
        shared = context.broadcast(tests)

        def count(batches):
            own = [[(level, shift, np.frombuffer(bits, np.uint8)) for level, shift, bits in every] for every in shared.value]
            for batch in batches:
                for names, _, _, joined, _ in _pieces(batch, salt):
                    keys = _keys(names, size)
                    at = _places(keys, joined, size, own)
                    parts = [keys[-1][at], *(names[at + i] for i in range(size))]
                    order = np.lexsort(parts)
                    parts = [x[order] for x in parts]
                    new = np.zeros(len(at), bool)
                    new[:1] = True
                    for x in parts:
                        new[1:] |= x[1:] != x[:-1]
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(at)))
                    arrays = [*(pa.array(x[first].view(np.int64)) for x in parts), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, names_out)

        names_out = ["key", *_words(size), "n"]
        found = self._map(count, ", ".join(f"{c} long" for c in names_out))
        return found.groupBy("key", *_words(size)).agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def spelled(self, bits: bytes) -> DataFrame:
        """w1 and word of the words in a bit map, each once per task at most."""
        salt = self.salt
        shared = self.rows.sparkSession.sparkContext.broadcast(bits)

        def spell(batches):
            own, told = np.frombuffer(shared.value, np.uint8), set()
            for batch in batches:
                for names, _, _, _, words in _pieces(batch, salt):
                    hit = np.flatnonzero(_inside(own, names))
                    unique, at = np.unique(names[hit], return_index=True)
                    fresh = [(int(x), hit[i]) for x, i in zip(unique.view(np.int64), at, strict=True) if int(x) not in told]
                    told.update(x for x, _ in fresh)
                    # lower() of bytes changes A-Z alone
                    text = [words.data[words.start[i] : words.end[i]].tobytes().lower().decode() for _, i in fresh]
                    arrays = [pa.array([x for x, _ in fresh], pa.int64()), pa.array(text, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["w1", "word"])

        return self._map(spell, "w1 long, word string").groupBy("w1").agg(F.min("word").alias("word"))


def _words(size: int, start: int = 1) -> list[str]:
    return [f"w{i}" for i in range(start, start + size)]


def bit_map(rows: DataFrame, key: str = "key") -> bytes:
    """CELLS bits, those of the keys set, from Spark's bit maps of 32768 bits, which count from 1."""
    place = F.col(key).bitwiseAND(CELLS - 1) + 1
    parts = rows.groupBy((F.bitmap_bucket_number(place) - 1).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray(CELLS // 8)
    for row in parts.toLocalIterator():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = row["bits"]
    return bytes(out)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a / (left + right)), exact beyond 64 bits."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(8,0)"), wide(left) + wide(right)).cast("long")


def _count_of(df: DataFrame, counts: DataFrame, size: int, start: int, name: str, how: str = "inner") -> DataFrame:
    """``df`` with the count of the words w<start>.. as column ``name``."""
    keys = _words(size, start)
    return df.join(counts.select(*[F.col(c).alias(k) for c, k in zip(_words(size), keys, strict=True)], F.col("n").alias(name)), keys, how)


def scored(grams: DataFrame, size: int, counts: dict[int, DataFrame], how: str = "inner") -> DataFrame:
    """``grams`` with lang_no, a, l, r and score at its lowest cut, and bound, the most that it can grow to.

    With ``how`` left a count that is not known leaves out its cut, so the score is only an upper limit.
    """
    for k in range(1, size):
        grams = _count_of(grams, counts[k], k, 1, f"l{k}")
        grams = _count_of(grams, counts[size - k], size - k, k + 1, f"r{k}", how if size - k == 3 else "inner")
    a = F.col("n")
    cuts = [
        F.when(F.col(f"r{k}").isNotNull(), F.struct(_score(a, F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, size)
    ]
    lowest = F.least(*cuts) if size > 2 else cuts[0]
    known = grams.withColumn("cut", lowest).withColumn("bound", _score(a, F.col("l1"), a))
    lang = counts[1].select("w1", "lang_no")
    return known.join(lang, "w1").select(
        "key", *_words(size), "n", "lang_no", "bound", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")
    )


def targets(known: DataFrame, rank: int, settled: DataFrame | None) -> DataFrame:
    """lang_no and target: the score at ``rank`` among the known phrases of a language, else 0."""
    if settled is not None:
        known = known.join(settled.select("lang_no"), "lang_no", "left_anti")
    order = Window.partitionBy("lang_no").orderBy(F.desc("score"))
    at = known.select("lang_no", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= rank)
    last = at.groupBy("lang_no").agg(F.max("rank").alias("rank"), F.min("score").alias("score"))
    return last.select("lang_no", F.when(F.col("rank") == rank, F.col("score")).otherwise(0).alias("target"))


def _reaching(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted, "lang_no").where(F.col(column) >= F.col("target")).select("key")


def _absorbed(longer: DataFrame, size: int, shorter: int, counts: DataFrame) -> DataFrame:
    """Keys of the phrases of ``shorter`` words inside those of ``size`` words that occur at least 0.8 times as often."""
    found = []
    for start in range(1, size - shorter + 2):
        inner = longer.select(*[F.col(c).alias(f"w{i + 1}") for i, c in enumerate(_words(shorter, start))], F.col("n").alias("longer"))
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        met = inner.join(counts.select("key", "n", *_words(shorter)), _words(shorter)).where(wide("longer") * 100 >= wide("n") * 80)
        found.append(met.select("key"))
    return reduce(DataFrame.union, found)


def _survivors(two, three, four, every_four, wanted) -> DataFrame:
    """lang_no, w1 to w4, a, l, r and score of the phrases that reach their language's target and are not absorbed.

    ``every_four`` also has the quadruples that are below the target for sure, whose score is not known.
    """
    none = F.lit(None).cast("long")
    gone = {2: _absorbed(three, 3, 2, two).union(_absorbed(every_four, 4, 2, two)), 3: _absorbed(every_four, 4, 3, three)}
    parts = []
    for size, rows in ((2, two), (3, three), (4, four)):
        kept = rows.join(gone[size].distinct(), "key", "left_anti") if size in gone else rows
        words = [F.col(c) if i < size else none.alias(c) for i, c in enumerate(_words(LONGEST))]
        parts.append(kept.select("lang_no", *words, F.col("n").alias("a"), "l", "r", "score"))
    every = reduce(DataFrame.union, parts).join(wanted, "lang_no")
    return every.where(F.col("score") >= F.col("target")).drop("target")


def best_phrases(corpus: Corpus, words: DataFrame, least: int, wanted: int) -> DataFrame:
    """The surviving phrases of every language that can be among its first ``wanted``, with lang_no and name hashes."""
    spark = corpus.rows.sparkSession
    one = written(words.where(F.col("n") >= least).select("w1", "n", "lang_no"), "words")
    in_one = bit_map(one, "w1")
    found = written(corpus.phrases(2, [[(1, 0, in_one), (1, 1, in_one)]], least), "pairs")
    two = written(scored(found, 2, {1: one, 2: found}), "pairs")
    in_two = bit_map(two)
    three_all = four_all = settled = answer = None
    known, reach = two.select("lang_no", "score"), FIRST_REACH * wanted
    while True:
        goal = written(targets(known, reach, settled), "targets")
        if goal.isEmpty():
            break
        goal = broadcast_if_small(goal)
        grow, check = bit_map(_reaching(two, "bound", goal)), bit_map(_reaching(two, "score", goal))
        near = [(2, 0, in_two), (2, 1, in_two)]
        fresh = written(corpus.phrases(3, [[(2, 0, grow), *near], [(2, 1, check), *near]], least), "triples")
        three_all = fresh if three_all is None else written(three_all.union(fresh).dropDuplicates(_words(3)), "triples")
        three = written(scored(three_all, 3, {1: one, 2: two}), "triples")
        grow, check = bit_map(_reaching(three, "bound", goal)), bit_map(_reaching(three, "score", goal))
        outer = [(2, 0, in_two), (2, 1, in_two), (2, 2, in_two)]
        fresh = written(corpus.phrases(4, [[(3, 0, grow), *outer], [(3, 1, check), *outer]], least), "quadruples")
        four_all = fresh if four_all is None else written(four_all.union(fresh).dropDuplicates(_words(4)), "quadruples")
        # a quadruple that may reach the target needs its last three words' count
        limit = scored(four_all, 4, {1: one, 2: two, 3: three_all}, "left")
        able = limit.join(goal, "lang_no").where(F.col("score") >= F.col("target"))
        ends = able.select(*[F.col(c).alias(f"w{i + 1}") for i, c in enumerate(_words(3, 2))]).distinct()
        missing = written(ends.join(three_all, _words(3), "left_anti"), "missing")
        if not missing.isEmpty():
            fresh = corpus.phrases(3, [[(3, 0, bit_map(_keyed(missing)))]], least)
            three_all = written(three_all.union(fresh).dropDuplicates(_words(3)), "triples")
            three = written(scored(three_all, 3, {1: one, 2: two}), "triples")
        four = written(scored(four_all, 4, {1: one, 2: two, 3: three_all}), "quadruples")
        survivors = written(_survivors(two, three, four, four_all, goal), "survivors")
        enough = survivors.groupBy("lang_no").agg(F.count(F.lit(1)).alias("n"))
        done = goal.join(enough, "lang_no", "left").where((F.col("n") >= wanted) | (F.col("target") == 0)).select("lang_no")
        done = written(done, "settled")
        fresh = survivors.join(broadcast_if_small(done), "lang_no")
        answer = fresh if answer is None else answer.union(fresh)
        settled = done if settled is None else settled.union(done)
        known = two.select("lang_no", "score").union(three.select("lang_no", "score")).union(four.select("lang_no", "score"))
        reach *= FURTHER
    if answer is None:
        return spark.createDataFrame([], "lang_no long, w1 long, w2 long, w3 long, w4 long, a long, l long, r long, score long")
    return answer


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (w1 to w3) with their phrase's hash, as the tasks work it out."""

    def add(batches):
        for batch in batches:
            names = [np.asarray(batch.column(i)).view(np.uint64) for i in range(3)]
            key = mixed(mixed(names[0] * _STEP + names[1]) * _STEP + names[2])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return rows.select(*_words(3)).mapInArrow(add, "key long")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST_COUNT, wanted: int = PER_LANGUAGE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``wanted`` phrases of every language."""
    language = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(F.col(text).alias("text"), language.alias("lang"), F.xxhash64(language).alias("lang_no"))
    languages = written(rows.groupBy("lang").agg(F.min("lang_no").alias("lang_no")), "languages")
    corpus = Corpus(rows)
    while True:
        words = written(corpus.words(), "names")
        if words.where("least <> most").isEmpty():
            break
        corpus.salt += 1
    totals = words.groupBy("lang_no").agg(F.sum("n").alias("n"))
    best = written(best_phrases(corpus, words, least, wanted), "best")
    order = Window.partitionBy("lang_no").orderBy(F.desc("score"), F.desc("a"))
    best = written(best.withColumn("place", F.rank().over(order)).where(F.col("place") <= wanted).drop("place"), "best")
    needed = reduce(DataFrame.union, [best.select(F.col(c).alias("w1")) for c in _words(LONGEST)]).where("w1 IS NOT NULL")
    needed = needed.distinct()
    spelled = written(corpus.spelled(bit_map(needed, "w1")).join(needed, "w1", "left_semi"), "spelled")
    for i, c in enumerate(_words(LONGEST)):
        best = best.join(spelled.select(F.col("w1").alias(c), F.col("word").alias(f"text{i}")), c, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"text{i}" for i in range(LONGEST)]))
    last = Window.partitionBy("lang_no").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= wanted)
    named = ranked.join(totals, "lang_no").join(languages, "lang_no")
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
