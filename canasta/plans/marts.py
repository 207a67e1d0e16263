"""The seven result documents, each a set of named marts, and the full refresh."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canasta import fixed
from canasta.operators import (
    distributions,
    features as feats,
    kpis,
    rules as assoc,
    segmentation as seg,
    timeseries,
)
from canasta.operators.grain import client_items, unnest
from canasta.session import materialize, run_folder, tune
from canasta.sources.marts import read_mart, record_run, write_mart

Marts = dict[str, DataFrame]


def executive_summary(lines: DataFrame, categories: DataFrame, txns: DataFrame) -> Marts:
    return {
        "kpis": kpis.kpis(lines, txns),
        "top_categories": kpis.top_categories(lines, categories),
        "top_clients": kpis.top_clients(txns),
        "peak_days": kpis.peak_days(txns),
        "categories_by_volume": kpis.categories_by_volume(lines, categories),
        "sales_by_store": kpis.sales_by_store(txns),
        "weekly_heatmap": kpis.weekly_heatmap(txns),
    }


def time_series(txns: DataFrame) -> Marts:
    return {
        "daily": timeseries.daily(txns),
        "weekly": timeseries.weekly(txns),
        "monthly": timeseries.monthly(txns),
        "by_store_daily": timeseries.store_daily(txns),
    }


def boxplot_data(units: DataFrame, txns: DataFrame) -> Marts:
    return {
        "basket_size_stats": distributions.basket_size_stats(txns),
        "client_total_stats": distributions.client_total_stats(txns),
        "outlier_clients": distributions.outlier_clients(txns),
        "category_basket_stats": distributions.category_basket_stats(units),
        "basket_size_histogram": distributions.basket_size_histogram(txns),
    }


def heatmap_data(spark: SparkSession, features: DataFrame) -> Marts:
    return {
        "labels": feats.feature_labels(spark),
        "correlation_matrix": feats.correlation_matrix(features),
        "client_features_sample": feats.client_sample(features),
        "client_features_count": feats.client_count(features),
    }


def clustering(
    spark: SparkSession, segmentation: seg.Segmentation, features: DataFrame
) -> Marts:
    mapping = segmentation.mapping()
    sizes = seg.segment_summary(features, mapping).select("segment_id", "size", "percentage")
    return {
        "elbow": segmentation.elbow(spark),
        "summary": segmentation.summary(spark),
        "segments": sizes.join(seg.centroids(segmentation, spark), "segment_id").orderBy(
            "segment_id"
        ),
        "segment_stats": seg.segment_stats(features, mapping),
        "sampled_silhouette": seg.mean_silhouette(
            seg.silhouettes(features, mapping, within_sample=True)
        ),
        "client_sample": seg.segment_sample(segmentation.clients),
    }


def client_segments(
    spark: SparkSession,
    segmentation: seg.Segmentation,
    client_categories: DataFrame,
    categories: DataFrame,
    mapping: DataFrame,
) -> Marts:
    return {
        "mapping": mapping,
        "top_categories": seg.segment_top_categories(client_categories, categories, mapping),
        "labels": seg.centroids(segmentation, spark).select("segment_id", "label"),
    }


def recommendations(
    baskets: DataFrame,
    categories: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
) -> Marts:
    """The rule set is mined once, stored, and the other marts are views of it."""
    n_baskets = baskets.count()
    rules = materialize(
        assoc.association_rules(
            baskets, categories, min_support, min_confidence, min_lift, n_baskets
        ),
        "rules",
    )
    return {
        "rules": assoc.ordered_rules(rules),
        "top_rules": assoc.top_rules(rules),
        "category_index": assoc.nested_index(assoc.category_index(rules)),
        "category_support": assoc.category_support(baskets, categories, min_support, n_baskets),
        "metadata": assoc.rule_metadata(
            baskets, rules, min_support, min_confidence, min_lift, n_baskets
        ),
    }


def refresh(
    spark: SparkSession,
    baskets: DataFrame,
    categories: DataFrame,
    out_dir: str,
    fmt: str = "parquet",
    thresholds: tuple[float, float, float] = (
        fixed.MIN_SUPPORT,
        fixed.MIN_CONFIDENCE,
        fixed.MIN_LIFT,
    ),
    parallel_writes: int = 4,
    scratch: str | None = None,
    n_init: int = fixed.KMEANS_STARTS,
    max_iter: int = fixed.KMEANS_ITERATIONS,
) -> None:
    """Computes every mart of ``baskets`` into ``out_dir`` and records the run's totals.

    ``scratch`` is a folder all executors share, by default ``spark.checkpoint.dir``; the run uses a
    folder of its own there and removes it.

    Baskets, (client, category) pairs and client features are stored once in the
    shared folder; all marts scan those tables, most without any large shuffle.
    Small marts leave most of a cluster idle, so a few are written at a time.
    """
    tune(spark)
    with recorded_run(spark, out_dir) as run, run_folder(spark, scratch):
        _refresh(
            spark, baskets, categories, out_dir, fmt, thresholds, parallel_writes, n_init, max_iter
        )
        run.totals = read_totals(spark, out_dir, fmt)


def _refresh(
    spark, baskets, categories, out_dir, fmt, thresholds, parallel_writes, n_init, max_iter
) -> None:
    baskets = materialize(baskets, "baskets")
    txns = baskets.drop("items")
    lines = unnest(baskets)
    client_categories = materialize(client_items(lines), "client-categories")
    features = materialize(feats.features_of_baskets(baskets), "client-features")
    segmentation = seg.fit_segments(features, n_init=n_init, max_iter=max_iter)
    try:
        mapping = materialize(segmentation.mapping(), "segments")
        documents = {
            "executive_summary": executive_summary(lines, categories, txns),
            "time_series": time_series(txns),
            "boxplot_data": boxplot_data(
                distributions.category_units_of_baskets(baskets, categories), txns
            ),
            "heatmap_data": heatmap_data(spark, features),
            "clustering": clustering(spark, segmentation, features),
            "client_segments": client_segments(
                spark, segmentation, client_categories, categories, mapping
            ),
            "recommendations": recommendations(baskets, categories, *thresholds),
        }
        write_documents(documents, out_dir, fmt, parallel_writes)
    finally:
        segmentation.release()


def write_documents(
    documents: dict[str, Marts], out_dir: str, fmt: str = "parquet", parallel_writes: int = 4
) -> None:
    """Writes all marts of all documents, each with the time it was made, a few at a time."""
    spark = next(iter(next(iter(documents.values())).values())).sparkSession
    made = spark.range(1).select(F.lit(datetime.now()).alias("generated_at"))
    marts = [
        (df, f"{out_dir.rstrip('/')}/{document}/{name}")
        for document, parts in documents.items()
        for name, df in {**parts, "generated_at": made}.items()
    ]
    with ThreadPoolExecutor(parallel_writes) as pool:
        list(pool.map(lambda mart: write_mart(*mart, fmt), marts))


def read_totals(spark: SparkSession, out_dir: str, fmt: str = "parquet") -> dict:
    """The KPI row as last written, for the run's record."""
    return read_mart(spark, f"{out_dir.rstrip('/')}/executive_summary", "kpis", fmt).first().asDict()


@dataclass
class Run:
    """A run in progress; ``totals`` are set once the marts are written."""

    run_id: str
    totals: dict | None = None


@contextmanager
def recorded_run(spark: SparkSession, out_dir: str, run_id: str | None = None) -> Iterator[Run]:
    """Records how the run inside ends, with its duration and totals, or with its error, which is passed on."""
    run, path, started = Run(run_id or uuid.uuid4().hex), f"{out_dir.rstrip('/')}/runs", datetime.now()
    try:
        yield run
    except Exception as error:
        record_run(spark, path, run.run_id, started, error=f"{type(error).__name__}: {error}")
        raise
    record_run(spark, path, run.run_id, started, totals=run.totals)
