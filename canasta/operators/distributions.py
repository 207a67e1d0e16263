"""Basket-size, client-total and per-category distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions.columns import num_rows
from canasta.functions.distribution import describe_counts
from canasta.functions.ranking import top_k
from canasta.operators.enrich import names_are_unique, with_category_names
from canasta.operators.grain import unnest


def units_per_client(txns: DataFrame) -> DataFrame:
    return txns.groupBy("client_id").agg(F.sum("basket_size").alias("total_units"))


def category_units(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Units of each category name in each transaction, from the exploded fact."""
    return _per_name(with_category_names(lines, categories))


def category_units_of_baskets(baskets: DataFrame, categories: DataFrame) -> DataFrame:
    """The same from baskets: row-local, unless two categories share a name."""
    named = with_category_names(unnest(baskets), categories)
    if not names_are_unique(categories):
        return _per_name(named)
    return named.select("category_name", "transaction_id", F.col("quantity").alias("units"))


def _per_name(named_lines: DataFrame) -> DataFrame:
    return named_lines.groupBy("category_name", "transaction_id").agg(
        F.sum("quantity").alias("units")
    )


def _labelled(stats: DataFrame, label: str) -> DataFrame:
    return stats.select(F.lit(label).alias("label"), *stats.columns)


def basket_size_stats(txns: DataFrame, frequency: str | None = None) -> DataFrame:
    """Here and below ``frequency`` names the number of transactions of a row, where rows are counts already."""
    return _labelled(describe_counts(txns, "basket_size", frequency=frequency), fixed.BASKET_SIZE_LABEL)


def client_total_stats(txns: DataFrame) -> DataFrame:
    return _labelled(
        describe_counts(units_per_client(txns), "total_units"), fixed.CLIENT_TOTAL_LABEL
    )


def outlier_clients(txns: DataFrame, n: int = fixed.OUTLIER_TOP_N) -> DataFrame:
    """Clients above the upper box-plot fence, largest first."""
    totals = units_per_client(txns)
    fence = (
        describe_counts(totals, "total_units")
        .select(
            (F.col("q3") + F.lit(fixed.IQR_FACTOR) * (F.col("q3") - F.col("q1"))).alias("fence")
        )
        .scalar()
    )
    return top_k(
        totals.filter(F.col("total_units") > fence),
        [F.desc("total_units"), F.asc("client_id")],
        n,
        rank=None,
    )


def category_basket_stats(units: DataFrame, frequency: str | None = None) -> DataFrame:
    """Distribution of units per transaction for every category name."""
    return describe_counts(units, "units", ["category_name"], decimals=4, frequency=frequency).orderBy(
        F.desc("count"), "category_name"
    )


def most_frequent_categories(
    units: DataFrame, n: int = fixed.TOP_FREQUENT_CATEGORIES
) -> DataFrame:
    """Categories in the largest number of transactions."""
    counts = units.groupBy("category_name").agg(F.count(F.lit(1)).alias("num_transactions"))
    return top_k(counts, [F.desc("num_transactions"), F.asc("category_name")], n)


def basket_size_histogram(
    txns: DataFrame, max_size: int | None = None, frequency: str | None = None
) -> DataFrame:
    """Number of transactions per basket size; ``max_size`` None keeps every size."""
    sizes = txns.groupBy("basket_size").agg(num_rows(frequency).alias("frequency"))
    if max_size is not None:
        sizes = sizes.filter(F.col("basket_size") <= max_size)
    return sizes.orderBy("basket_size")


def histogram_head(histogram: DataFrame, n: int = fixed.HISTOGRAM_SHOWN) -> DataFrame:
    """The ``n`` smallest basket sizes that occur."""
    return top_k(histogram, [F.asc("basket_size")], n, rank=None)
