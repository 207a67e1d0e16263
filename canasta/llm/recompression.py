"""Substring dedup over words by recompression.

Rounds name runs and pairs of words by their content: each round gives every symbol a hash of the words
it stands for, sorts symbols into two sides by a bit of the hash, and joins neighbours that are equal (a
run) or lie left and right (a pair). A name is a function of the words it covers, so all tasks give one
name to equal substrings without exchanging tables of names; only symbols near the border of a repeat may
differ. Borders of high-level symbols that depend on few words around them are thinned to those of least
hash nearby, and serve as anchors (``repeats``): windows of equal words share one, and are then compared
exactly by hashes of their words.

A window is ``WINDOW`` consecutive words of one text. Every word is removed that lies in a window whose
words also start in a document with a smaller id. Null and empty texts have no words; texts shorter than a
window lose nothing. Words are runs of anything but blank, tab and line breaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canasta.llm.repeats import FAR, Method, Units, borders_of, covered, keyed, smallest_within, with_runs
from canasta.llm.words import Ranges, chunks, mixed, texts_of, words_of

WINDOW = 50
ROUNDS = 3
#: Words to either side that may decide a symbol's border, and that it is the least of.
DECIDED_BY = 6
LEAST_OF = 6


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    words = words_of(data, offsets)
    return Units(words.values, words.first, words.start, words.end)


def symbol_borders(units: Units, ranges: Ranges, rounds: int = ROUNDS):
    """Borders of the symbols after ``rounds``, and the reach of words that decide each."""
    at, back, ahead = borders_of(units)
    for turn in range(rounds):
        if len(at) < 3:
            break
        name = ranges(at[:-1], at[1:])
        side = mixed(name ^ np.uint64(turn + 1)) & np.uint64(1)
        joined = (name[:-1] == name[1:]) | (side[:-1] < side[1:])
        inner = at[1:-1]
        kept = ~joined | (ahead[1:-1] >= FAR)
        near, far = back[:-2][kept], ahead[2:][kept]
        own_text = ahead[1:-1][kept] >= FAR
        near, far = np.where(own_text, -FAR, near), np.where(own_text, FAR, far)
        at = np.concatenate([at[:1], inner[kept], at[-1:]])
        back = np.concatenate([[-FAR], near, [-FAR]])
        ahead = np.concatenate([[FAR], far, [FAR]])
    return at, back, ahead


def anchors(units: Units, ranges: Ranges) -> np.ndarray:
    at, back, ahead = symbol_borders(units, ranges)
    sure = at[(back >= at - DECIDED_BY) & (ahead <= at + DECIDED_BY)]
    ranks = ranges(sure - 2, sure + 2)
    return smallest_within(sure, ranks, len(units.values) + 1, LEAST_OF)


METHOD = Method(word_units, anchors, DECIDED_BY + LEAST_OF, DECIDED_BY + LEAST_OF, WINDOW, False)


def kept_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one blank, of every document."""

    def cut(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for at, end in chunks(offsets):
                words = words_of(data, offsets[at : end + 1])
                whole = words.data.tobytes()
                n, gone, kept = [], [], []
                for i in range(end - at):
                    a, b = words.first[i], words.first[i + 1]
                    left = np.flatnonzero(~covered(batch.column(2)[at + i].values, b - a, WINDOW)) + a
                    n.append(b - a)
                    gone.append(b - a - len(left))
                    spans = zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)
                    kept.append(b" ".join([whole[s:e] for s, e in spans]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    texts = keyed(docs, doc_id, text)
    return with_runs(texts, METHOD).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
