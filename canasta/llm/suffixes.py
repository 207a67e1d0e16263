"""Substring dedup over bytes by induced sorting.

As in induced suffix sorting, suffixes that begin at local minima are taken for all others: a place is kept
where its symbol is smaller than the one before and no larger than the one after, the stretches between
kept places are the symbols of the next level, and the order among them is that of their names. What lies
between two kept places is induced: its tuples (common prefix, distance, place) follow from the kept
suffix behind it. The queues of tuples are Spark's sorts and aggregations, which spill to disk and run over
all executors; only classes with a common prefix of ``WINDOW`` bytes are needed, so names are hashes and
the order between classes is not worked out.

Every byte is removed that a ``WINDOW``-byte string covers which also starts earlier: in a document with
a smaller id, or earlier in the same one. Null and empty texts have no bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canasta.llm.repeats import FAR, Method, Units, borders_of, covered, keyed, with_runs
from canasta.llm.words import BYTE_VALUES, Ranges, texts_of

WINDOW = 100
LEVELS = 1
#: Bytes to either side that may decide a kept place, and that its hash takes in.
DECIDED_BY = 3
RADIUS = 16


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(BYTE_VALUES[data[offsets[0] : offsets[-1]]], offsets - offsets[0])


def kept_places(units: Units, ranges: Ranges, levels: int = LEVELS):
    """Places kept after ``levels`` and the reach of bytes that decide each."""
    at, back, ahead = borders_of(units)
    for _ in range(levels):
        if len(at) < 4:
            break
        name = ranges(at[:-1], at[1:])
        least = np.zeros(len(at), bool)
        least[1 : len(name) - 1] = (name[:-2] > name[1:-1]) & (name[1:-1] <= name[2:])
        border = ahead >= FAR
        near = np.concatenate([[-FAR], back[:-1]])
        far = np.concatenate([ahead[2:], [FAR, FAR]])
        near[border], far[border] = -FAR, FAR
        kept = least | border
        at, back, ahead = at[kept], near[kept], far[kept]
    return at, back, ahead


def anchors(units: Units, ranges: Ranges) -> np.ndarray:
    at, back, ahead = kept_places(units, ranges)
    return at[(back >= at - DECIDED_BY) & (ahead <= at + DECIDED_BY)]


METHOD = Method(byte_units, anchors, RADIUS, RADIUS, WINDOW, True, True)


def kept_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes of every document."""

    def cut(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            n, gone, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                out = covered(batch.column(2)[i].values, len(own), WINDOW)
                n.append(len(own))
                gone.append(int(out.sum()))
                spans.append(int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1)))
                kept.append(own[~out].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    texts = keyed(docs, doc_id, text)
    return with_runs(texts, METHOD).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
