"""k-means of many models at once: an iteration is one scan of the points, however many models take part.

Points are whole numbers (scaled features in steps of 2^-20), so the sums of a cluster are exact: results do not
depend on how the rows are placed or in which order partial sums arrive. A task compares its rows with the
centres of all models in blocks of numpy arrays and returns one row per centre; the driver sees those sums alone.
Starts come from a bounded sample of points by k-means++ and a few rounds on that sample; all points
then move the centres until they stand still, and a model that stands still leaves the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps per unit of a scaled feature.
UNIT = float(1 << 20)
#: Points that starts are chosen from.
SEED_POINTS = 20_000
#: k-means++ starts on those points for one start of a model, and rounds of each.
SEED_TRIES = 4
SEED_ROUNDS = 50
#: Models whose costs differ by no more than this share are alike; the first of them is taken.
ALIKE = 1e-9
_BLOCK = 4096


@dataclass
class Moments:
    """Of the clusters of one model: members, sums of coordinates, sums of squared lengths and of squared distances."""

    centers: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    costs: np.ndarray

    @property
    def cost(self) -> float:
        return float(self.costs.sum())

    def means(self) -> np.ndarray:
        """The members' means; a cluster without members keeps its centre."""
        some = self.n > 0
        return np.where(some[:, None], self.sums / UNIT / np.maximum(self.n, 1)[:, None], self.centers)


def coordinates(points: DataFrame) -> list[str]:
    return [c for c in points.columns if c.startswith("_p")]


def to_points(features: DataFrame, columns: Sequence[str], means: Sequence[float], stds: Sequence[float]) -> DataFrame:
    """``features`` with _p0, _p1, ..: standard scores in steps of 1 / UNIT; 0 for a constant feature."""
    scored = {
        f"_p{j}": F.round((F.col(c).cast("double") - m) / s * UNIT).cast("long") if s else F.lit(0).cast("long")
        for j, (c, m, s) in enumerate(zip(columns, means, stds, strict=True))
    }
    return features.withColumns(scored)


def scan(points: DataFrame, models: Sequence[np.ndarray]) -> list[Moments]:
    """Moments of all models' clusters, from one pass over ``points``. The task's code needs no other module of ours."""
    columns = coordinates(points)
    centers, spans, unit, block = np.concatenate(models), _spans(models), UNIT, _BLOCK
    size = len(columns)
    names = ["center", "n", "squares", "cost", *[f"s{j}" for j in range(size)]]

    def add(batches):
        n, sums = np.zeros(len(centers), np.int64), np.zeros((size, len(centers)), np.int64)
        squares, costs = np.zeros(len(centers)), np.zeros(len(centers))
        for batch in batches:
            whole = np.stack([batch.column(j).to_numpy() for j in range(size)])
            for at in range(0, batch.num_rows, block):
                steps = whole[:, at : at + block]
                x = steps / unit
                far = np.zeros((x.shape[1], len(centers)))
                for j in range(size):
                    apart = x[j][:, None] - centers[:, j]
                    far += apart * apart
                lengths, rows = (x * x).sum(axis=0), np.arange(x.shape[1])
                for a, b in spans:
                    near = far[:, a:b].argmin(axis=1)
                    count = lambda w=None: np.bincount(near, w, b - a)  # noqa: E731, B023
                    n[a:b] += count()
                    squares[a:b] += count(lengths)
                    costs[a:b] += count(far[rows, near + a])
                    for j in range(size):
                        sums[j, a:b] += count(steps[j]).astype(np.int64)
        used = np.flatnonzero(n)
        found = [used, n[used], squares[used], costs[used], *(s[used] for s in sums)]
        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names)

    schema = "center long, n long, squares double, cost double, " + ", ".join(f"s{j} long" for j in range(size))
    parts = points.select(*columns).mapInArrow(add, schema).groupBy("center")
    # a row per centre
    rows = parts.agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
    n, sums = np.zeros(len(centers), np.int64), np.zeros((len(centers), size))
    squares, costs = np.zeros(len(centers)), np.zeros(len(centers))
    for r in rows:
        i = r["center"]
        n[i], squares[i], costs[i] = r["n"], r["squares"], r["cost"]
        sums[i] = [r[f"s{j}"] for j in range(size)]
    return [Moments(centers[a:b], n[a:b], sums[a:b], squares[a:b], costs[a:b]) for a, b in spans]


def _spans(models: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(m) for m in models]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def lloyd(points: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tolerance: float = 0.0) -> tuple[list[np.ndarray], int]:
    """Centres of all models after at most ``max_iter`` scans, and the scans made.

    A model leaves once none of its centres moves by more than ``tolerance``; at 0 its centres are its members' means.
    """
    centers, moving, scans = [np.array(s) for s in starts], list(range(len(starts))), 0
    while moving and scans < max_iter:
        scans += 1
        found = scan(points, [centers[i] for i in moving])
        still = []
        for i, moments in zip(moving, found, strict=True):
            after = moments.means()
            if np.sqrt(((after - centers[i]) ** 2).sum(axis=1)).max() > tolerance:
                still.append(i)
            centers[i] = after
        moving = still
    return centers, scans


def starts(sample: np.ndarray, k: int, seed: int, tries: int = SEED_TRIES, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """k centres on ``sample`` (rows of points): the cheapest of a few k-means++ starts, each moved for some rounds."""
    random, best, least_cost = np.random.default_rng([seed, k]), None, np.inf
    lengths = (sample * sample).sum(axis=1)
    for _ in range(tries):
        centers = sample[[random.integers(len(sample))]]
        least = ((sample - centers[0]) ** 2).sum(axis=1)
        for _ in range(1, k):
            chance = np.cumsum(least)
            at = min(int(np.searchsorted(chance, random.random() * chance[-1], side="right")), len(sample) - 1)
            centers = np.concatenate([centers, sample[[at]]])
            least = np.minimum(least, ((sample - sample[at]) ** 2).sum(axis=1))
        for _ in range(rounds):
            # squared distances but for the points' own lengths, which do not change the order
            far = (centers * centers).sum(axis=1) - 2 * (sample @ centers.T)
            near = far.argmin(axis=1)
            cost = float(far[np.arange(len(sample)), near].sum() + lengths.sum())
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, sample[:, j], k) for j in range(sample.shape[1])], axis=1)
            after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
            if (after == centers).all():
                break
            centers = after
        if cost < least_cost:
            best, least_cost = centers, cost
    return best


def fit(points: DataFrame, sample: np.ndarray, k_values: Sequence[int], seed: int, n_init: int, max_iter: int, tolerance: float = 1e-4) -> list[Moments]:
    """The cheapest of ``n_init`` models of every k, whose centres are its members' means unless ``max_iter`` ends it before.

    All models take part in every scan until they move by no more than ``tolerance``; the best of each k goes
    on until it stands still.
    """
    tries = [(k, i) for k in k_values for i in range(n_init)]
    with ThreadPoolExecutor(8) as pool:
        first = list(pool.map(lambda t: starts(sample, t[0], seed + t[1]), tries))
    centers, scans = lloyd(points, first, max_iter, tolerance)
    found = scan(points, centers)
    best = []
    for k in k_values:
        own = [m for (size, _), m in zip(tries, found, strict=True) if size == k]
        least = min(m.cost for m in own)
        best.append(next(m for m in own if m.cost <= least * (1 + ALIKE)))
    settled, _ = lloyd(points, [m.centers for m in best], max(0, max_iter - scans))
    return [_without_empty(m) for m in scan(points, settled)]


def _without_empty(m: Moments) -> Moments:
    some = m.n > 0
    return Moments(m.centers[some], m.n[some], m.sums[some], m.squares[some], m.costs[some])


def nearest(columns: Sequence[str], centers: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equals: the same arithmetic as in :func:`scan`, in SQL functions."""
    far = []
    for center in centers.tolist():
        parts = [(F.col(c) / UNIT - value) * (F.col(c) / UNIT - value) for c, value in zip(columns, center, strict=True)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        far.append(total)
    distances = F.array(*far)
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def squared_silhouettes(points: DataFrame, models: Sequence[Moments]) -> list[float | None]:
    """Mean silhouette by squared Euclidean distance of every model, all from one scan; None for a single cluster.

    The mean squared distance of a point to a cluster follows from the cluster's moments.
    """
    scored = [m for m in models if len(m.n) > 1]
    if not scored:
        return [None] * len(models)
    columns, unit, block = coordinates(points), UNIT, _BLOCK
    tables = [(m.centers, m.n.astype(float), m.sums / UNIT / m.n[:, None], m.squares / m.n) for m in scored]

    def add(batches):
        total = np.zeros(len(tables))
        for batch in batches:
            whole = np.stack([batch.column(j).to_numpy() for j in range(len(columns))])
            for at in range(0, batch.num_rows, block):
                x = whole[:, at : at + block] / unit
                lengths, rows = (x * x).sum(axis=0), np.arange(x.shape[1])
                for i, (centers, n, means, squares) in enumerate(tables):
                    far = np.zeros((x.shape[1], len(n)))
                    for j in range(len(columns)):
                        apart = x[j][:, None] - centers[:, j]
                        far += apart * apart
                    own = far.argmin(axis=1)
                    spread = np.maximum(lengths[:, None] + squares - 2 * (x.T @ means.T), 0)
                    inner = spread[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
                    spread[rows, own] = np.inf
                    outer = spread.min(axis=1)
                    larger = np.maximum(inner, outer)
                    score = np.divide(outer - inner, larger, out=np.zeros_like(inner), where=larger > 0)
                    total[i] += score[n[own] > 1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tables))), pa.array(total)], ["model", "total"])

    parts = points.select(*columns).mapInArrow(add, "model long, total double")
    sums = {r["model"]: r["total"] for r in parts.groupBy("model").agg(F.sum("total").alias("total")).collect()}
    found = iter(sums[i] / m.n.sum() for i, m in enumerate(scored))
    return [float(next(found)) if len(m.n) > 1 else None for m in models]
