"""Client segmentation with k-means, segment profiles and segment categories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from canasta import fixed
from canasta.functions.columns import segment_label
from canasta.functions.distribution import exact_quantiles
from canasta.functions.ranking import top_k_per_group
from canasta.operators import kmeans
from canasta.operators.enrich import with_category_names
from canasta.operators.features import client_sample
from canasta.session import is_small

#: Segment counts up to which per-segment tables are broadcast.
FEW_SEGMENTS = 10_000

#: Segments that silhouettes are worked out for at most; a task holds one number per segment and sampled client.
SCORED_SEGMENTS = 64


def has_few_segments(segments: DataFrame) -> bool:
    return is_small(segments.select("segment_id").distinct(), FEW_SEGMENTS)


# ---- k-means ----------------------------------------------------------------


@dataclass
class Segmentation:
    """Outcome of :func:`fit_segments`."""

    k: int
    silhouette: float | None
    sweep: list[tuple[int, float, float | None]]
    scaled_centers: list[list[float]] | None
    """In standard scores; None when all clients are one segment."""
    n_clients: int
    centers: list[list[float]]
    clients: DataFrame
    """client_id, segment_id and the features; segment 0 is the largest."""
    cached: DataFrame

    def release(self) -> None:
        """Frees the cached features; ``clients`` is recomputed if used later."""
        self.cached.unpersist()

    def elbow(self, spark: SparkSession) -> DataFrame:
        """k, inertia (2 decimals) and silhouette (4) of every k tried."""
        return spark.createDataFrame(self.sweep, "k INT, inertia DOUBLE, silhouette DOUBLE").select(
            "k", F.round("inertia", 2).alias("inertia"), F.round("silhouette", 4).alias("silhouette")
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        """The chosen k, its silhouette (4 decimals; null when nothing could be scored) and the clients."""
        row = spark.createDataFrame(
            [(self.k, self.silhouette, self.n_clients)], "k INT, silhouette DOUBLE, total_clients LONG"
        )
        return row.select("k", F.round("silhouette", 4).alias("silhouette"), "total_clients")

    def mapping(self) -> DataFrame:
        return self.clients.select("client_id", "segment_id")


def scaled_vectors(
    features: DataFrame, columns: Sequence[str] = tuple(fixed.SEGMENT_FEATURES)
) -> tuple[DataFrame, list[float], list[float]]:
    """Features assembled and standardised, with the mean and std used."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_raw")
    assembled = assembler.transform(features)
    scaler = StandardScaler(inputCol="_raw", outputCol="scaled", withMean=True, withStd=True)
    fitted = scaler.fit(assembled)
    return (
        fitted.transform(assembled).drop("_raw"),
        fitted.mean.toArray().tolist(),
        fitted.std.toArray().tolist(),
    )


def fit_segments(
    features: DataFrame,
    k_values: Sequence[int] = tuple(fixed.K_VALUES),
    seed: int = fixed.SEED,
    n_init: int = fixed.KMEANS_STARTS,
    max_iter: int = fixed.KMEANS_ITERATIONS,
) -> Segmentation:
    """k-means for every k, the best silhouette kept, segments renumbered by size.

    The models of all k and all starts share their scans (see :mod:`canasta.operators.kmeans`). Starts are
    chosen from at most ``kmeans.SEED_POINTS`` clients, taken by a hash of their id; sums are exact. So the same
    clients give the same segments however they arrive. Only that sample, centres and sums reach the driver.

    Only k up to the number of distinct feature rows are tried. A k that leaves one cluster has no
    silhouette and is never chosen; if all are so, all clients are one segment. A model may have fewer clusters
    than asked for.
    """
    columns = list(fixed.SEGMENT_FEATURES)
    features = features.select("client_id", *columns)
    n_clients, means, stds = _spread(features, columns)
    if not n_clients:
        raise ValueError("there are no clients to segment")
    points = kmeans.to_points(features, columns, means, stds).persist(StorageLevel.MEMORY_AND_DISK)
    names = kmeans.coordinates(points)
    most = max([*k_values, 1])
    distinct = points.select(*names).distinct().limit(most).count()
    possible = [k for k in k_values if 1 < k <= distinct]
    models, scores = [], []
    if possible:
        sample = np.array([r[:] for r in client_sample(points, kmeans.SEED_POINTS, seed).select(*names).collect()], float)
        models = kmeans.fit(points, sample / kmeans.UNIT, possible, seed, n_init, max_iter)
        scores = kmeans.squared_silhouettes(points, models)
    # Features are scaled by the sample std; the published inertia uses the population std.
    inertia_scale = n_clients / (n_clients - 1) if n_clients > 1 else 1.0
    sweep = [(k, m.cost * inertia_scale, s) for k, m, s in zip(possible, models, scores, strict=True)]
    scored = [i for i, s in enumerate(scores) if s is not None]
    if not scored:
        clients = points.select("client_id", F.lit(0).alias("segment_id"), *columns)
        return Segmentation(1, None, sweep, None, n_clients, [means], clients, points)
    best = max(scored, key=lambda i: scores[i])  # the first of equals
    found = models[best]
    order = sorted(range(len(found.n)), key=lambda old: (-int(found.n[old]), old))
    scaled = found.centers[order]
    clients = points.select("client_id", kmeans.nearest(names, scaled).alias("segment_id"), *columns)
    centers = [[c * s + m for c, s, m in zip(center, stds, means, strict=True)] for center in scaled.tolist()]
    return Segmentation(len(order), scores[best], sweep, scaled.tolist(), n_clients, centers, clients, points)


def of_mapping(features: DataFrame, segments: DataFrame) -> Segmentation:
    """A given segmentation (client_id, segment_id) in the same form, renumbered by size; its centres are the member means.

    Its one sweep entry has the inertia and the squared silhouette of that mapping.
    """
    columns = list(fixed.SEGMENT_FEATURES)
    mapping = renumber_segments(features.select("client_id").join(segments, "client_id"))
    members = features.select("client_id", *columns).join(mapping, "client_id")
    n_clients, means, stds = _spread(members, columns)
    points = kmeans.to_points(members, columns, means, stds).persist(StorageLevel.MEMORY_AND_DISK)
    rows = points.groupBy("segment_id").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("segment_id").collect()
    centers = [[float(r[c]) for c in columns] for r in rows]
    cost, silhouette = _given_scores(points)
    clients = points.select("client_id", "segment_id", *columns)
    inertia = cost * n_clients / (n_clients - 1) if n_clients > 1 else 0.0
    return Segmentation(len(rows), silhouette, [(len(rows), inertia, silhouette)], None, n_clients, centers, clients, points)


def _given_scores(points: DataFrame) -> tuple[float, float | None]:
    """Sum of squared distances to the member means, and mean squared silhouette, of segments numbered from 0.

    Both follow from the segments' moments; the second joins each point with the one row of all segments' moments.
    """
    names = kmeans.coordinates(points)
    x = [F.col(c) / kmeans.UNIT for c in names]
    length = sum((v * v for v in x[1:]), x[0] * x[0])
    moments = points.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("square"), *[F.avg(v).alias(f"m{j}") for j, v in enumerate(x)]
    )
    every = moments.select(F.array_sort(F.collect_list(F.struct("segment_id", "n", "square", *[f"m{j}" for j in range(len(x))]))).alias("every"))
    row = every.first()["every"]
    cost = sum(r["n"] * (r["square"] - sum(r[f"m{j}"] ** 2 for j in range(len(x)))) for r in row)
    if len(row) < 2:
        return cost, None
    far = [
        length + F.lit(r["square"]) - F.lit(2.0) * sum((v * r[f"m{j}"] for j, v in enumerate(x)), F.lit(0.0)) for r in row
    ]
    own = F.element_at(F.array(*far), F.col("segment_id") + 1)
    n = F.element_at(F.array(*[F.lit(r["n"]) for r in row]), F.col("segment_id") + 1)
    others = F.array_min(F.array(*[F.when(F.col("segment_id") != r["segment_id"], d) for r, d in zip(row, far, strict=True)]))
    inner = F.greatest(F.lit(0.0), own * n / F.greatest(n - 1, F.lit(1)))
    larger = F.greatest(inner, others)
    score = F.when((n > 1) & (larger > 0), (others - inner) / larger).otherwise(0.0)
    return cost, points.agg(F.avg(score)).first()[0]


def silhouettes(
    features: DataFrame,
    segments: DataFrame,
    n: int = fixed.SILHOUETTE_SAMPLE,
    seed: int = fixed.SEED,
    within_sample: bool = False,
) -> DataFrame:
    """client_id, segment_id and Euclidean silhouette of at most ``n`` clients, taken by a hash of their id.

    Distances are between standard scores. Each sampled client is compared with all clients, or with the
    sample alone if ``within_sample``: every task adds up the distances from its block of rows to the sample, per
    segment, and ships one number per sampled client and segment. The sample goes to all tasks: n rows of
    five numbers. A segment of one client scores 0; there must be at most SCORED_SEGMENTS segments.
    """
    columns = list(fixed.SEGMENT_FEATURES)
    members = features.select("client_id", *columns).join(segments.select("client_id", "segment_id"), "client_id")
    names = sorted(r[0] for r in members.select("segment_id").distinct().limit(SCORED_SEGMENTS + 1).collect())
    if len(names) > SCORED_SEGMENTS:
        raise ValueError(f"more than {SCORED_SEGMENTS} segments")
    _, means, stds = _spread(members, columns)
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])[F.col("segment_id")]
    scores = [(F.col(c).cast("double") - m) / s if s else F.lit(0.0) for c, m, s in zip(columns, means, stds, strict=True)]
    axes = [f"_z{j}" for j in range(len(columns))]
    placed = members.select("client_id", "segment_id", number.alias("_segment"), *[z.alias(a) for z, a in zip(scores, axes, strict=True)])
    chosen = client_sample(placed, n, seed).persist(StorageLevel.MEMORY_AND_DISK)
    rows = chosen.collect()
    spark, count = features.sparkSession, len(names)
    points = np.array([r[3:] for r in rows], float).reshape(len(rows), len(columns))

    def add(batches):
        total, seen = np.zeros((count, len(points))), np.zeros(count, np.int64)
        lengths = (points * points).sum(axis=1)
        for batch in batches:
            own = batch.column(0).to_numpy()
            whole = np.stack([batch.column(j + 1).to_numpy() for j in range(points.shape[1])], axis=1)
            for at in range(0, len(own), 256):
                x = whole[at : at + 256]
                far = (x * x).sum(axis=1)[:, None] + lengths - 2 * (x @ points.T)
                far = np.sqrt(np.maximum(far, 0))
                for i in np.unique(own[at : at + 256]):
                    inside = own[at : at + 256] == i
                    total[i] += far[inside].sum(axis=0)
                    seen[i] += int(inside.sum())
        segment, point = np.divmod(np.arange(total.size), max(1, len(points)))
        arrays = [pa.array(segment), pa.array(point), pa.array(total.ravel()), pa.array(seen[segment])]
        yield pa.RecordBatch.from_arrays(arrays, ["_segment", "point", "total", "n"])

    base = chosen if within_sample else placed
    schema = "_segment long, point long, total double, n long"
    sums = base.select("_segment", *axes).mapInArrow(add, schema).groupBy("_segment", "point").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    known = spark.createDataFrame(
        [(i, r["client_id"], r["_segment"]) for i, r in enumerate(rows)], "point long, client_id long, _own int"
    ).join(placed.select("client_id", "segment_id"), "client_id")
    own = F.col("_segment") == F.col("_own")
    met = sums.where("n > 0").join(known, "point").groupBy("point", "client_id", "segment_id").agg(
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("inner"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("outer"),
    )
    larger = F.greatest("inner", "outer")
    score = F.when((F.col("n") > 1) & (larger > 0), (F.col("outer") - F.col("inner")) / larger).otherwise(0.0)
    return met.select("client_id", "segment_id", score.alias("silhouette"))


def mean_silhouette(scores: DataFrame) -> DataFrame:
    """One row: the clients scored and their mean silhouette, 4 decimals."""
    return scores.agg(F.count(F.lit(1)).alias("num_clients"), F.round(F.avg("silhouette"), 4).alias("silhouette"))


def _spread(features: DataFrame, columns: Sequence[str]) -> tuple[int, list[float], list[float]]:
    """Rows, and the mean and sample std of every column; 0 where there is none."""
    row = features.agg(
        F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in columns]
    ).first()
    size = len(columns)
    return row[0], [float(x or 0.0) for x in row[1 : size + 1]], [float(x) for x in row[size + 1 :]]


def centroids(segmentation: Segmentation, spark: SparkSession) -> DataFrame:
    """Cluster centres in original units, 2 decimals, with their label."""
    rows = [(i, *center) for i, center in enumerate(segmentation.centers)]
    schema = "segment_id INT, " + ", ".join(f"{c} DOUBLE" for c in fixed.SEGMENT_FEATURES)
    table = spark.createDataFrame(rows, schema).withColumns(
        {c: F.round(c, 2) for c in fixed.SEGMENT_FEATURES}
    )
    return table.withColumn("label", _label())


# ---- profiles of any (client_id, segment_id) mapping ------------------------


def _label() -> Column:
    return segment_label(
        F.col("purchase_frequency"), F.col("total_units"), F.col("category_diversity")
    )


def _members(features: DataFrame, segments: DataFrame) -> DataFrame:
    return features.select("client_id", *fixed.SEGMENT_FEATURES).join(segments, "client_id")


def segment_sizes(segments: DataFrame) -> DataFrame:
    """segment_id, size and the number it gets when ordered by size.

    The ordering window sees one row per segment.
    """
    order = Window.orderBy(F.desc("size"), F.asc("segment_id"))
    return (
        segments.groupBy("segment_id")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("new_segment_id", F.row_number().over(order) - 1)
    )


def renumber_segments(segments: DataFrame) -> DataFrame:
    """The mapping with segments numbered from 0, largest first."""
    sizes = segment_sizes(segments)
    if has_few_segments(segments):
        sizes = F.broadcast(sizes)
    return segments.join(sizes, "segment_id").select(
        "client_id", F.col("new_segment_id").alias("segment_id")
    )


def segment_summary(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Size, share of clients, centroid (member means) and label of every segment."""
    members = _members(features, segments)
    total = members.select(F.count(F.lit(1)).alias("n")).scalar()
    means = [F.round(F.avg(c), 2).alias(c) for c in fixed.SEGMENT_FEATURES]
    return (
        members.groupBy("segment_id")
        .agg(F.count(F.lit(1)).alias("size"), *means)
        .select(
            "segment_id",
            _label().alias("label"),
            "size",
            F.round(F.col("size").cast("double") / total.cast("double") * 100.0, 1).alias(
                "percentage"
            ),
            *fixed.SEGMENT_FEATURES,
        )
        .orderBy(F.desc("size"), "segment_id")
    )


def segment_stats(features: DataFrame, segments: DataFrame) -> DataFrame:
    """mean, median, std, min and max of every feature in every segment, 2 decimals."""
    members = _members(features, segments)
    names = list(fixed.SEGMENT_FEATURES)
    wide = members.groupBy("segment_id").agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in names
        ]
    )
    moments = wide.select("segment_id", F.inline(F.array(*names)))
    medians = exact_quantiles(
        members, ["segment_id"], names, 0.5, few_groups=has_few_segments(segments)
    ).select("segment_id", "feature", F.col("quantile").alias("median"))
    return (
        moments.join(medians, ["segment_id", "feature"])
        .select(
            "segment_id",
            "feature",
            *[F.round(c, 2).alias(c) for c in ("mean", "median", "std", "min", "max")],
        )
        .orderBy("segment_id", "feature")
    )


def segment_top_categories(
    client_categories: DataFrame,
    categories: DataFrame,
    segments: DataFrame,
    n: int = fixed.SEGMENT_TOP_CATEGORIES,
) -> DataFrame:
    """Categories bought by the most clients of each segment.

    Starts from the distinct (client, category) pairs, so a hot client brings
    one row per category into the join.
    """
    bought = with_category_names(client_categories, categories).join(segments, "client_id")
    clients = bought.groupBy("segment_id", "category_name").agg(
        F.countDistinct("client_id").alias("num_clients")
    )
    return top_k_per_group(
        clients, ["segment_id"], [F.desc("num_clients"), F.asc("category_name")], n
    )


def radar(summary: DataFrame) -> DataFrame:
    """Segment centroids as percent of the largest segment value per feature."""
    long = summary.select(
        "segment_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).alias("centroid"))
                    for c in fixed.SEGMENT_FEATURES
                ]
            )
        ),
    )
    largest = F.max("centroid").over(Window.partitionBy("feature"))
    scale = F.when(largest == 0, F.lit(1.0)).otherwise(largest)
    return long.select(
        "feature",
        "segment_id",
        F.round(F.lit(100.0) * (F.col("centroid") / scale), 0).cast("int").alias("value"),
    ).orderBy("feature", "segment_id")


def segment_sample(clients: DataFrame, n: int = fixed.SEGMENT_SAMPLE) -> DataFrame:
    """Clients with segment and features for a scatter plot, grouped by segment."""
    sample = client_sample(clients, n)
    return sample.select(
        "client_id", "segment_id", *[F.round(c, 2).alias(c) for c in fixed.SEGMENT_FEATURES]
    ).orderBy("segment_id", "client_id")
