"""Client features, their correlations, standard scores and a reproducible sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta import fixed


def client_features(txns: DataFrame, client_categories: DataFrame) -> DataFrame:
    """One row per client with the seven behaviour features.

    ``client_categories`` are the distinct (client, category) pairs. All other
    features come from the transactions, reduced to (client, store, day) before
    the two distinct counts. Every grouping shrinks map-side, so a hot client
    costs no more than its stores, days and categories.
    """
    visits = txns.groupBy("client_id", "store_id", "date").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum("basket_size").alias("units"),
        F.sum("num_categories").alias("category_visits"),
    )
    behaviour = visits.groupBy("client_id").agg(
        F.sum("visits").alias("purchase_frequency"),
        F.sum("units").alias("total_units"),
        (F.sum("units").cast("double") / F.sum("visits").cast("double")).alias("avg_basket_size"),
        (F.sum("category_visits").cast("double") / F.sum("visits").cast("double")).alias(
            "avg_categories_per_txn"
        ),
        F.countDistinct("store_id").alias("num_stores_visited"),
        F.countDistinct("date").alias("active_days"),
    )
    diversity = client_categories.groupBy("client_id").agg(
        F.count("category_id").alias("category_diversity")
    )
    return (
        behaviour.join(diversity, "client_id", "left")
        .select("client_id", *fixed.FEATURES)
        .na.fill(0, fixed.FEATURES)
    )


def features_of_baskets(baskets: DataFrame) -> DataFrame:
    """The same features from baskets, which are read once and not stored.

    A basket gives a row for its store, with the sums, one for its day and one per category. Grouped by (client, kind,
    value), map-side as well, these are the client's distinct stores, days and categories, so the last grouping
    only counts rows.
    """
    none = F.lit(0).cast("bigint")

    def row(kind: int, value, visits=none, units=none, categories=none):
        names = ("kind", "value", "visits", "units", "category_visits")
        values = (F.lit(kind), value.cast("bigint"), visits, units, categories)
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    store = row(0, F.col("store_id"), F.lit(1).cast("bigint"), F.col("basket_size"), F.col("num_categories").cast("bigint"))
    items = F.transform("items", lambda i: row(2, i["category_id"]))
    rows = baskets.select("client_id", F.inline(F.concat(F.array(store, row(1, F.unix_date("date"))), items)))
    sums = ("visits", "units", "category_visits")
    pairs = rows.groupBy("client_id", "kind", "value").agg(*[F.sum(c).alias(c) for c in sums])
    distinct = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())
    per_visit = lambda c: F.sum(c).cast("double") / F.sum("visits").cast("double")
    return pairs.groupBy("client_id").agg(
        F.sum("visits").alias("purchase_frequency"),
        F.sum("units").alias("total_units"),
        per_visit("units").alias("avg_basket_size"),
        per_visit("category_visits").alias("avg_categories_per_txn"),
        distinct(2).alias("category_diversity"),
        distinct(0).alias("num_stores_visited"),
        distinct(1).alias("active_days"),
    ).select("client_id", *fixed.FEATURES)


def segment_features(features: DataFrame) -> DataFrame:
    """The five features the segmentation uses."""
    return features.select("client_id", *fixed.SEGMENT_FEATURES)


def correlation_matrix(
    features: DataFrame, columns: Sequence[str] = tuple(fixed.FEATURES)
) -> DataFrame:
    """Pearson correlations in long form, 4 decimals; null where a column is constant.

    One pass computes all moments; the cells are laid out from that single row.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    moments = features.agg(
        *[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs],
        *[F.stddev_pop(a).alias(f"std_{a}") for a in columns],
    )

    def cell(a: str, b: str) -> F.Column:
        first, second = (a, b) if (a, b) in pairs else (b, a)
        spread = F.col(f"std_{a}") * F.col(f"std_{b}")
        return F.struct(
            F.lit(a).alias("feature_x"),
            F.lit(b).alias("feature_y"),
            F.round(F.try_divide(F.col(f"cov_{first}_{second}"), spread), 4).alias("r"),
        )

    cells = F.array(*[cell(a, b) for a in columns for b in columns])
    return moments.select(F.inline(cells))


def feature_labels(spark) -> DataFrame:
    """Display label of every feature, in matrix order."""
    labels = list(zip(range(len(fixed.FEATURES)), fixed.FEATURES, fixed.FEATURE_LABELS_ES))
    return spark.createDataFrame(labels, "position INT, feature STRING, label STRING")


def zscores(
    features: DataFrame, columns: Sequence[str] = tuple(fixed.SEGMENT_FEATURES)
) -> DataFrame:
    """(x - mean) / population std per column; 0 where the column is constant."""
    columns = list(columns)
    moments = features.select(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        ).alias("moments")
    ).scalar()
    return features.select(
        "client_id",
        *[
            F.coalesce(
                F.try_divide(
                    F.col(c).cast("double") - moments[f"mean_{c}"], moments[f"std_{c}"]
                ),
                F.lit(0.0),
            ).alias(c)
            for c in columns
        ],
    )


def client_sample(df: DataFrame, n: int = fixed.FEATURE_SAMPLE, seed: int = fixed.SEED) -> DataFrame:
    """Exactly min(n, clients) rows, the same on every run and under any partitioning."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("client_id").cast("string")))
    return df.orderBy(key, "client_id").limit(n)


def client_count(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("client_features_count"))
