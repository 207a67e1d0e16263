"""The marts from mergeable state: a refresh that reads no basket older than the newest batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canasta import fixed
from canasta.operators import distributions, features as feats, kpis, rules as assoc, segmentation as seg, timeseries
from canasta.plans import marts
from canasta.session import materialize, run_folder, tune
from canasta.streaming.state import MASK, read_states

States = dict[str, DataFrame]


def overall(states: States) -> DataFrame:
    """The KPI row."""
    days, clients = states["days"], states["client_stores"]
    counts = {
        "total_clients": clients.select(F.countDistinct("client_id").alias("n")).scalar(),
        "total_categories": states["categories"].select(F.count("category_id").alias("n")).scalar(),
    }
    return days.agg(
        F.sum("units").alias("total_units"),
        F.coalesce(F.sum("visits"), F.lit(0)).alias("total_transactions"),
        F.countDistinct("store_id").alias("total_stores"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
    ).select(
        "total_units",
        "total_transactions",
        *[n.alias(name) for name, n in counts.items()],
        "total_stores",
        "date_start",
        "date_end",
    )


def client_categories(states: States) -> DataFrame:
    """Distinct (client_id, category_id), unfolded from the bit masks."""
    bits = F.expr(f"filter(sequence(0, {MASK - 1}), i -> shiftrightunsigned(categories, i) & 1 = 1)")
    each = states["client_categories"].select("client_id", "block", F.explode(bits).alias("bit"))
    return each.select("client_id", (F.col("block") * MASK + F.col("bit")).cast("int").alias("category_id"))


def client_features(states: States) -> DataFrame:
    """One row per client with the seven behaviour features; all three state tables are keyed by client."""
    visits = F.sum("visits").cast("double")
    behaviour = states["client_stores"].groupBy("client_id").agg(
        F.sum("visits").alias("purchase_frequency"),
        F.sum("units").alias("total_units"),
        (F.sum("units").cast("double") / visits).alias("avg_basket_size"),
        (F.sum("category_visits").cast("double") / visits).alias("avg_categories_per_txn"),
        F.count("store_id").alias("num_stores_visited"),
    )
    days = states["client_months"].groupBy("client_id").agg(
        F.sum(F.bit_count("days")).alias("active_days")
    )
    diversity = states["client_categories"].groupBy("client_id").agg(
        F.sum(F.bit_count("categories")).alias("category_diversity")
    )
    joined = behaviour.join(days, "client_id", "left").join(diversity, "client_id", "left")
    return joined.select("client_id", *fixed.FEATURES).na.fill(0, fixed.FEATURES)


def executive_summary(states: States, categories: DataFrame) -> marts.Marts:
    days = states["days"].withColumnRenamed("units", "basket_size")
    clients = states["client_stores"].withColumnRenamed("units", "basket_size")
    lines = states["categories"].withColumnRenamed("units", "quantity")
    return {
        "kpis": overall(states),
        "top_categories": kpis.top_categories(lines, categories),
        "top_clients": kpis.top_clients(clients, visits="visits"),
        "peak_days": kpis.peak_days(days, visits="visits"),
        "categories_by_volume": kpis.categories_by_volume(lines, categories),
        "sales_by_store": kpis.sales_by_store(clients, visits="visits"),
        "weekly_heatmap": kpis.weekly_heatmap(days, visits="visits"),
    }


def time_series(states: States) -> marts.Marts:
    days = states["days"].withColumnRenamed("units", "basket_size")
    return {
        "daily": timeseries.daily(days, "visits"),
        "weekly": timeseries.weekly(days, "visits"),
        "monthly": timeseries.monthly(days, "visits"),
        "by_store_daily": timeseries.store_daily(days, "visits"),
    }


def boxplot_data(states: States) -> marts.Marts:
    clients = states["client_stores"].withColumnRenamed("units", "basket_size")
    sizes = states["basket_sizes"]
    return {
        "basket_size_stats": distributions.basket_size_stats(sizes, "frequency"),
        "client_total_stats": distributions.client_total_stats(clients),
        "outlier_clients": distributions.outlier_clients(clients),
        "category_basket_stats": distributions.category_basket_stats(states["category_sizes"], "frequency"),
        "basket_size_histogram": distributions.basket_size_histogram(sizes, frequency="frequency"),
    }


def recommendations(
    states: States,
    categories: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
) -> marts.Marts:
    """The rule documents from the pair counts; the number of baskets is the one value the driver sees."""
    total = states["days"].agg(F.coalesce(F.sum("visits"), F.lit(0))).first()[0]
    pairs = states["pairs"]
    counts = pairs.where("x = y").select(F.col("x").alias("category_id"), F.col("num_baskets").alias("count"))
    thresholds = (min_support, min_confidence, min_lift)
    rules = materialize(assoc.rules_of_counts(assoc.mirrored(pairs), categories, total, *thresholds), "rules")
    return {
        "rules": assoc.ordered_rules(rules),
        "top_rules": assoc.top_rules(rules),
        "category_index": assoc.nested_index(assoc.category_index(rules)),
        "category_support": assoc.support_of_counts(counts, categories, min_support, total),
        "metadata": assoc.metadata_of_counts(counts, rules, total, *thresholds),
    }


def refresh_from_state(
    spark: SparkSession,
    state: str,
    categories: DataFrame,
    out_dir: str,
    fmt: str = "parquet",
    thresholds: tuple[float, float, float] = (fixed.MIN_SUPPORT, fixed.MIN_CONFIDENCE, fixed.MIN_LIFT),
    parallel_writes: int = 4,
    scratch: str | None = None,
    n_init: int = fixed.KMEANS_STARTS,
    max_iter: int = fixed.KMEANS_ITERATIONS,
) -> None:
    """Writes the same marts as :func:`canasta.plans.marts.refresh`, from the state that ingest keeps.

    The merged state tables and the client features are stored once in a folder of this run.
    """
    tune(spark)
    with marts.recorded_run(spark, out_dir) as run, run_folder(spark, scratch):
        states = {name: materialize(df, f"state-{name}") for name, df in read_states(spark, state).items()}
        features = materialize(client_features(states), "client-features")
        bought = client_categories(states)
        segmentation = seg.fit_segments(features, n_init=n_init, max_iter=max_iter)
        try:
            mapping = materialize(segmentation.mapping(), "segments")
            summary = executive_summary(states, categories)
            documents = {
                "executive_summary": summary,
                "time_series": time_series(states),
                "boxplot_data": boxplot_data(states),
                "heatmap_data": marts.heatmap_data(spark, features),
                "clustering": marts.clustering(spark, segmentation, features),
                "client_segments": marts.client_segments(spark, segmentation, bought, categories, mapping),
                "recommendations": recommendations(states, categories, *thresholds),
            }
            marts.write_documents(documents, out_dir, fmt, parallel_writes)
            run.totals = marts.read_totals(spark, out_dir, fmt)
        finally:
            segmentation.release()
