"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it greedily:
the automaton is followed as long as it can, and where it cannot, a phrase ends and the next begins.
The fewer phrases a language needs, the closer the text is to it; the phrase count times the
logarithm of the training length, over the text's length, estimates the cross entropy per character. The
language with the lowest estimate wins; ties go to the smaller name by code point.

Texts are lower-cased; characters that are no letters count as one blank per run. A text is parsed in
pieces of ``PIECE`` characters, each beginning a phrase, so that long texts are parsed side by side.

Defined cases: a null text, and one without a letter, is ``und`` with score 0. Rows with a null text or
language, and texts without a letter, are not learned from. With nothing to learn from, all is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import small_batches

#: Bounds of the training sample: documents per language, and characters of them that are learned.
SAMPLE_DOCUMENTS = 200
SAMPLE_CHARACTERS = 24_000
#: Distinct letters a language may have; rarer ones match nothing.
LETTERS = 240
PIECE = 512
#: Characters of documents that a task parses at once.
PARSED_TOGETHER = 1_000_000

UNKNOWN = "und"
_BLANK = 32
_TOP = 0x110000


def _folding() -> np.ndarray:
    """Code point → itself for letters, else a blank."""
    kept = np.full(_TOP, _BLANK, np.uint32)
    letters = [c for c in range(_TOP) if chr(c).isalpha()]
    kept[letters] = letters
    return kept


_cache: dict = {}


def _folded(text: str) -> np.ndarray:
    """The text's lower-case letters as code points, each run of others as one blank."""
    if "fold" not in _cache:
        _cache["fold"] = _folding()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = _cache["fold"][points]
    blank = points == _BLANK
    again = np.zeros(len(points), bool)
    again[1:] = blank[1:] & blank[:-1]
    return points[~again]


def automaton(points: list[int], letters: dict[int, int], width: int) -> np.ndarray:
    """The suffix automaton of ``points`` as a table of states × letter classes.

    A cell holds the next state times two. Where the automaton has no such step, the cell holds the
    state that the next phrase begins with, and its lowest bit is set. Class 0 is padding, which stays.
    Class 1 is any unknown letter. The last state begins a text and follows a letter that this language
    does not have, which is a phrase of its own: every step from it begins a phrase.
    """
    steps, link, length = [{}], [-1], [0]
    last = 0
    for point in points:
        c = letters.get(point)
        if c is None:
            last = 0
            continue
        own = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in steps[at]:
            steps[at][c] = own
            at = link[at]
        if at >= 0:
            to = steps[at][c]
            if length[to] == length[at] + 1:
                link[own] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = copy
                    at = link[at]
                link[to] = link[own] = copy
        last = own
    begin = len(steps)
    table = np.full((begin + 1, width), -1, np.int32)
    for state, out in enumerate(steps):
        table[state, list(out)] = np.fromiter(out.values(), np.int32, len(out)) * 2
    fresh = np.where(table[0] >= 0, table[0], begin * 2) | 1
    table = np.where(table >= 0, table, fresh)
    table[begin] = fresh
    table[:, 0] = np.arange(begin + 1) * 2
    return table.astype(np.int32)


class Model:
    """Automata of all languages, over one set of letter classes."""

    def __init__(self, samples: dict[str, str]):
        folded = {lang: _folded(text) for lang, text in sorted(samples.items())}
        self.languages = list(folded)
        found, counts = np.unique(np.concatenate([*folded.values(), np.zeros(0, np.uint32)]), return_counts=True)
        common = found[np.argsort(-counts, kind="stable")][: LETTERS * max(1, len(folded))]
        self.letters = {int(p): i + 2 for i, p in enumerate(sorted(common))}
        self.classes = np.ones(_TOP, np.uint16)
        for point, number in self.letters.items():
            self.classes[point] = number
        width = len(self.letters) + 2
        self.width = width
        self.tables = [automaton(p.tolist(), self.letters, width).ravel() for p in folded.values()]
        self.weights = np.array([np.log2(max(2, len(p))) for p in folded.values()])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text in each language."""
        pieces = np.array([max(1, -(-len(t) // PIECE)) for t in texts])
        grid = np.zeros((int(pieces.sum()), PIECE), np.uint16)
        row = 0
        for text, n in zip(texts, pieces.tolist(), strict=True):
            flat = grid[row : row + n].reshape(-1)
            flat[: len(text)] = self.classes[text]
            row += n
        lengths = np.count_nonzero(grid, axis=1)
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(grid[order].T).astype(np.int32)
        active = len(order) - np.searchsorted(lengths[order][::-1], np.arange(PIECE), side="right")
        counts = np.zeros((len(self.tables), len(order)), np.int64)
        for table, count in zip(self.tables, counts, strict=True):
            at = np.full(len(order), len(table) // self.width - 1, np.int32)
            ended = np.zeros(len(order), np.int32)
            for column, n in zip(columns, active.tolist(), strict=True):
                if not n:
                    break
                cell = table[at[:n] * self.width + column[:n]]
                ended[:n] += cell & 1
                at[:n] = cell >> 1
            count[order] = ended
        return np.add.reduceat(counts, np.concatenate([[0], np.cumsum(pieces)[:-1]]), axis=1).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        folded = [_folded(t) if t else np.zeros(0, np.uint32) for t in texts]
        known = [i for i, p in enumerate(folded) if (p != _BLANK).any()]
        if not known or not self.languages:
            return names, scores
        cost = self.phrases([folded[i] for i in known]) * self.weights
        best = cost.argmin(axis=1)
        share = (1 / cost) / (1 / cost).sum(axis=1, keepdims=True)
        for i, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = self.languages[b], s[b]
        return names, scores


def training_sample(docs: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """(lang, text): per language at most ``SAMPLE_DOCUMENTS`` documents in the order of a hash of the
    id, each cut to ``SAMPLE_CHARACTERS``. Documents whose crc32(id) mod 5 is 0 are held out."""
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    rows = docs.where(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & ~_held_out(doc_id) & F.col(text).rlike(r"\p{L}")
    ).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.substring(text, 1, SAMPLE_CHARACTERS).alias("text"))
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= SAMPLE_DOCUMENTS)


def _held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, **columns) -> Model:
    """The model of a bounded sample: its texts per language, longest bound ``SAMPLE_CHARACTERS``.

    Each document gives an equal part of the characters; what short ones leave goes to those after them.
    """
    samples: dict[str, list[str]] = {}
    for row in training_sample(docs, **columns).orderBy("lang", "_rank").select("lang", "text").toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["text"])
    texts = {}
    for lang, found in samples.items():
        left, kept = SAMPLE_CHARACTERS, []
        for i, text in enumerate(sorted(found, key=len)):
            kept.append(text[: left // (len(found) - i)])
            left -= len(kept[-1])
        texts[lang] = "\n".join(kept)
    return Model(texts)


def identify(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; row-local, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def predict(batches):
        model = shared.value
        for batch in batches:
            ids, held, texts = batch.columns
            texts = texts.to_pylist()
            names, scores, at = [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= PARSED_TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                some = model.predict(texts[at:end])
                names += some[0]
                scores += some[1]
                at = end
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """The rows of ``docs``, all columns, that the parse finds a language for: those with at least one letter.

    Only texts without a letter score 0, whatever the learned labels are called. With nothing to learn from there
    is no parse, and the letters decide alone.
    """
    if not model.languages:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        scores = []
        for at in range(0, len(texts), 100):
            scores += shared.value.predict(texts.iloc[at : at + 100].tolist())[1]
        return pd.Series([s > 0 for s in scores], dtype=bool)

    small_batches(docs.sparkSession)
    return docs.where(found(F.col(text)))
