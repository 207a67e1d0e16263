"""Windows of fixed length that occur earlier, found through anchors.

A text is a sequence of units (bytes or words). A method places anchors: places that are chosen by the
units within a fixed radius around them alone, so that equal stretches carry equal anchors. A window
belongs to one of the anchors whose whole radius lies inside it, the first or the one of least hash, which equal
windows agree on; a window without one stands for itself. The windows of one anchor are consecutive, and one row
carries them all:

* ``kin``: hash of the radius, equal for all rows that hold an equal window,
* ``whole``: hash of everything the windows cover, equal when all of them are.

The rows are shuffled once, by kin, and rows whose kin is alone are done with. Among rows with equal kin and whole,
all but the earliest are repeats outright. Where one kin has several wholes (the ends of repeats), the
earliest row of each goes on with the text its windows cover, and the windows of a kin are compared by their hashes
in the task that has the kin. Kins of more than ``LARGE`` rows list their windows one by one instead, and
these are grouped over all tasks.

Rows that repeat one of the same stretch of texts are told at once, so a hot kin has few rows of each task where starts in
the same document count. Texts are shuffled once, for both joins with their runs.
Hashes of windows are only compared among rows of equal kin: 128 bits decide.

Repeated ids: rows with equal id are ordered by a hash of the text; rows with equal id and text are one
document, reported once per row. A null id is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import numbered, small_batches, written
from canasta.llm.words import Ranges, chunks, mixed, texts_of, window_starts

#: Beyond any place in a text.
FAR = 1 << 60
#: Rows of a kin up to which one task compares its windows.
LARGE = 20_000
#: Rows whose windows are compared at once.
COMPARED_TOGETHER = 5_000

_TOP = np.iinfo(np.uint64).max
_PLACE = np.uint64(32)


@dataclass
class Units:
    """Values of the units of consecutive texts; ``first[i]`` to ``first[i + 1]`` are those of text i.
    ``start`` and ``end`` are their bytes, counted from the first text; without them each byte is a unit."""

    values: np.ndarray
    first: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def bytes_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units from ``low`` up to ``high`` begin and end."""
        return (low, high) if self.start is None else (self.start[low], self.end[high - 1])


@dataclass(frozen=True)
class Method:
    """How texts become units and where anchors lie.

    ``anchors`` gives sorted places, each decided by the units from ``left`` before it to ``right`` after
    it; places nearer to the border of a text are not given.
    """

    units: Callable[[np.ndarray, np.ndarray], Units]
    anchors: Callable[[Units, Ranges], np.ndarray]
    left: int
    right: int
    window: int
    within: bool  # whether an earlier start in the same document counts
    least: bool = False  # whether the anchor of least hash owns a window, or the first


def smallest_within(places: np.ndarray, ranks: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Those of ``places`` whose rank is the smallest among all places up to ``reach`` away."""
    top = np.iinfo(np.uint64).max
    dense = np.full(n + 2 * reach, top, np.uint64)
    dense[places + reach] = ranks
    width, low = 1, dense
    while width < 2 * reach + 1:
        step = min(width, 2 * reach + 1 - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return places[low[places] == ranks]


def borders_of(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit a symbol of its own: its starts and an end, and how far back and ahead the units lie
    that decide them. The borders of texts are out of reach of every radius."""
    n = len(units.values)
    at = np.arange(n + 1)
    back, ahead = at.copy(), at.copy()
    back[units.first], ahead[units.first] = -FAR, FAR
    return at, back, ahead


def owned_windows(units: Units, method: Method, places: np.ndarray):
    """(anchor or -1, first start, last start) of each run of windows, by owner; for those without, by window."""
    n = method.window
    starts, ends = units.first[:-1], units.first[1:]
    text = np.searchsorted(units.first, places, side="right") - 1
    before = np.concatenate([[-FAR], places[:-1]])
    low = np.maximum(np.maximum(before - method.left + 1, places + method.right - n), starts[text])
    high = np.minimum(places - method.left, ends[text] - n)
    some = low <= high
    owner, low, high = places[some], low[some], high[some]
    # windows that no run covers
    size = len(units.values) + 1
    edges = np.zeros(size + 1, np.int64)
    full = ends - starts >= n
    np.add.at(edges, starts[full], 1)
    np.add.at(edges, ends[full] - n + 1, -1)
    np.add.at(edges, low, -1)
    np.add.at(edges, high + 1, 1)
    alone = np.flatnonzero(np.cumsum(edges) > 0)
    return (
        np.concatenate([owner, np.full(len(alone), -1)]),
        np.concatenate([low, alone]),
        np.concatenate([high, alone]),
    )


def windows_of_least(units: Units, method: Method, places: np.ndarray, ranges: Ranges):
    """As ``owned_windows``, where the anchor of least hash owns a window, of equal ones the first."""
    size = len(units.values) + 1
    places = places[(places >= method.left) & (places + method.right < size)]
    hashes = ranges(places - method.left, places + method.right) >> _PLACE << _PLACE
    low = np.full(size + method.window, _TOP, np.uint64)
    low[places] = hashes | places.astype(np.uint64)
    low = low[method.left :]
    inside = method.window - method.left - method.right + 1
    width = 1
    while width < inside:
        step = min(width, inside - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    starts = window_starts(units.first, method.window)
    own = low[starts]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | (own[1:] == _TOP)
    at = np.flatnonzero(new)
    own = own[at]
    owner = np.where(own == _TOP, -1, (own & np.uint64((1 << 32) - 1)).astype(np.int64))
    return owner, starts[at], starts[np.append(at, len(starts))[1:] - 1]


def _repeated_here(kin, whole, doc, low) -> np.ndarray:
    """Which rows have an earlier one of equal kin and whole among them."""
    order = np.lexsort((low, doc, whole, kin))
    same = (kin[order][1:] == kin[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    # a document that comes twice is the same place, not a repeat
    again = (doc[order][1:] == doc[order][:-1]) & (low[order][1:] == low[order][:-1])
    out = np.zeros(len(kin), bool)
    out[order[1:]] = same & ~again
    return out


def _kin(owner, low, ranges: Ranges, method: Method) -> np.ndarray:
    alone = owner < 0
    start = np.where(alone, low, owner - method.left)
    end = np.where(alone, low + method.window, owner + method.right)
    return ranges(start, end)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def window_rows(docs: DataFrame, method: Method) -> DataFrame:
    """Rows of windows of every document (doc, text): kin, whole, doc, low, n. Where a row surely repeats an earlier
    one, whole is null and kin is any."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = texts_of(batch.column(1))
            for at, end in chunks(offsets):
                units = method.units(data, offsets[at : end + 1])
                ranges = Ranges(units.values)
                places = method.anchors(units, ranges)
                owner, low, high = windows_of_least(units, method, places, ranges) if method.least else owned_windows(units, method, places)
                kin, whole = _kin(owner, low, ranges, method), ranges(low, high + method.window)
                text = np.searchsorted(units.first, low, side="right") - 1
                doc, start = ids[at + text], low - units.first[text]
                sure = _repeated_here(kin, whole, doc, start) if method.within else np.zeros(len(kin), bool)
                kin = np.where(sure, mixed(doc.view(np.uint64) ^ mixed(start.astype(np.uint64))), kin)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(kin),
                        pa.array(whole.view(np.int64), mask=sure),
                        pa.array(doc),
                        pa.array(start.astype(np.int32)),
                        pa.array((high - low + 1).astype(np.int32)),
                    ],
                    ["kin", "whole", "doc", "low", "n"],
                )

    return docs.mapInArrow(rows, "kin long, whole long, doc long, low int, n int")


def _runs_of(runs: pa.Array):
    """Borders of the rows and fields of a column of lists of structs."""
    border = np.concatenate([[0], np.cumsum(np.diff(runs.offsets.to_numpy()))])
    flat = runs.flatten()
    return border, [flat.field(i).to_numpy() for i in range(flat.type.num_fields)]


def covered_texts(texts: DataFrame, method: Method) -> DataFrame:
    """kin, doc, low and what its windows cover, of every run of texts (doc_id, doc, text, runs of kin, low and n)."""

    def rows(batches):
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            ids = batch.column(1).to_numpy()
            data, offsets = texts_of(batch.column(2))
            border, (kin, low, n) = _runs_of(batch.column(3))
            for at, end in chunks(offsets):
                part = data[offsets[at] : offsets[end]]
                units = method.units(data, offsets[at : end + 1])
                own = slice(border[at], border[end])
                text = np.repeat(np.arange(end - at), np.diff(border[at : end + 1]))
                first = units.first[text] + low[own]
                start, stop = units.bytes_of(first, first + n[own] + method.window - 1)
                whole = part.tobytes()
                bodies = [whole[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kin[own]), pa.array(ids[at + text]), pa.array(low[own]), pa.array(bodies, pa.binary())],
                    ["kin", "doc", "low", "body"],
                )

    return texts.mapInArrow(rows, "kin long, doc long, low int, body binary")


def _late(table: pa.Table, method: Method) -> pa.RecordBatch:
    """doc and runs (low, n) of the windows of covered texts that occur earlier among those of their kin."""
    kin, doc, low = (table.column(i).to_numpy() for i in range(3))
    units = method.units(*texts_of(table.column(3).combine_chunks()))
    starts = window_starts(units.first, method.window)
    value = Ranges(units.values)(starts, starts + method.window)
    row = np.searchsorted(units.first, starts, side="right") - 1
    kin, doc, low = kin[row], doc[row], low[row] + (starts - units.first[row])
    order = np.lexsort((low, doc, value, kin))
    begins = np.ones(len(order), bool)
    begins[1:] = (np.diff(kin[order]) != 0) | (value[order][1:] != value[order][:-1])
    least = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    later = doc[order] != doc[least]
    if method.within:
        later |= low[order] != low[least]
    at = np.sort(order[later])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(row[at]) != 0)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at[begin]]), pa.array(low[at[begin]].astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "low", "n"]
    )


def late_windows(bodies: DataFrame, method: Method, together: int = COMPARED_TOGETHER) -> DataFrame:
    """doc, low, n of the runs of windows that occur earlier, from covered texts."""

    def rows(batches):
        waiting, count, enough = [], 0, together
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= enough:
                table = pa.Table.from_batches(waiting).combine_chunks()
                border = int(np.searchsorted(table.column(0).to_numpy(), table.column(0)[-1].as_py()))
                if border:
                    yield _late(table.slice(0, border), method)
                waiting, count = table.slice(border).to_batches(), count - border
                enough = max(together, 2 * count)
        if count:
            yield _late(pa.Table.from_batches(waiting), method)

    return bodies.repartition("kin").sortWithinPartitions("kin").mapInArrow(rows, "doc long, low int, n int")


def single_windows(texts: DataFrame, method: Method) -> DataFrame:
    """kin, hash, doc and start of the windows of texts (doc, text, runs of kin, low and n)."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = texts_of(batch.column(1))
            border, (kin, low, n) = _runs_of(batch.column(2))
            for at, end in chunks(offsets):
                units = method.units(data, offsets[at : end + 1])
                own = slice(border[at], border[end])
                text = np.repeat(np.arange(end - at), np.diff(border[at : end + 1]))
                count = n[own]
                text, kins = np.repeat(text, count), np.repeat(kin[own], count)
                start = np.repeat(low[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = start + units.first[text]
                value = Ranges(units.values)(place, place + method.window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kins), _long(value), pa.array(ids[at + text]), pa.array(start.astype(np.int32))],
                    ["kin", "hash", "doc", "low"],
                )

    return texts.mapInArrow(rows, "kin long, hash long, doc long, low int")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc (an ordered number of the document) and text. Unique ids are their own numbers."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "text")
    name = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))
    names = written(rows.select(name.alias("name")).distinct(), "names")
    numbers = numbered(names.withColumn("all", F.lit(0)), ["all"], F.lit(0), ["name"], "doc").drop("all")
    found = rows.withColumn("name", name).join(numbers.withColumnRenamed("name", "own"), F.col("name").eqNullSafe(F.col("own")))
    return written(found.select("doc_id", "doc", "text"), "numbered")


def told_rows(docs: DataFrame, method: Method) -> DataFrame:
    """Rows of windows that may occur earlier: kin, doc, low, n, later (they do) and large (kins of many rows)."""
    of_kin = Window.partitionBy("kin")
    rows = window_rows(docs, method).repartition("kin").select(
        "*",
        F.count(F.lit(1)).over(of_kin).alias("c"),
        (F.min("whole").over(of_kin) != F.max("whole").over(of_kin)).alias("several"),
    )
    rows = rows.where("c > 1 or whole is null")
    before = Window.partitionBy("kin", "whole").orderBy(*(["doc", "low"] if method.within else ["doc"]))
    rows = rows.select("*", (F.col("whole").isNull() | (F.rank().over(before) > 1)).alias("later"))
    kin = F.when(~F.col("later"), F.col("kin")).alias("kin")
    return rows.where("later or several").select(kin, "doc", "low", "n", "later", (F.col("c") > LARGE).alias("large"))


def repeated_runs(texts: DataFrame, method: Method) -> DataFrame:
    """doc and its runs (low, n) of starts of windows that occur earlier; documents with any."""
    small_batches(texts.sparkSession)
    told = written(told_rows(texts.select("doc", "text"), method), "told")
    runs = F.collect_set(F.struct("kin", "low", "n")).alias("runs")
    open_runs = told.where("not later and not large").groupBy("doc").agg(runs)
    # all columns of the texts, as in ``with_runs``: both joins use one exchange
    some = texts.join(open_runs, "doc", "left").select("doc_id", "doc", F.when(F.col("runs").isNotNull(), F.col("text")).alias("text"), "runs")
    late = told.where("later").select("doc", "low", "n").union(late_windows(covered_texts(some, method), method))
    many = told.where("not later and large")
    if not many.isEmpty():
        windows = texts.join(many.groupBy("doc").agg(runs), "doc").select("doc", "text", "runs")
        windows = written(single_windows(windows, method), "windows")
        first = windows.groupBy("kin", "hash").agg(F.min(F.struct("doc", "low")).alias("least"), F.count(F.lit(1)).alias("c"))
        first = first.where("c > 1").drop("c")
        late = late.union(windows.join(first, ["kin", "hash"]).where(_later(method)).select("doc", "low", F.lit(1).alias("n")))
    return late.groupBy("doc").agg(F.collect_set(F.struct("low", "n")).alias("runs"))


def _later(method: Method):
    here = F.struct("doc", "low") if method.within else F.col("doc")
    return here > (F.col("least") if method.within else F.col("least.doc"))


def covered(runs: list | None, size: int, window: int) -> np.ndarray:
    """Which of ``size`` units the windows of ``runs`` cover."""
    edges = np.zeros(size + 1, np.int64)
    if runs is not None and len(runs):
        low, n = runs.field(0).to_numpy(), runs.field(1).to_numpy()
        np.add.at(edges, low, 1)
        np.add.at(edges, low + n - 1 + window, -1)
    return np.cumsum(edges[:-1]) > 0


def with_runs(texts: DataFrame, method: Method) -> DataFrame:
    """``texts`` (doc_id, doc, text) with their runs of repeats, null without any."""
    return texts.join(repeated_runs(texts, method), "doc", "left").select("doc_id", "text", "runs")
