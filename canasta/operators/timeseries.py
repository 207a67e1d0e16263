"""Transactions and units over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.functions.columns import month_key, num_rows, week_start


def _series(txns: DataFrame, visits: str | None, *keys: Column) -> DataFrame:
    """Both metrics from one grouping; hot days or stores shrink map-side.

    Here and below ``visits`` names the number of transactions of a row, where rows are sums already.
    """
    return txns.groupBy(*keys).agg(
        num_rows(visits).alias("num_transactions"), F.sum("basket_size").alias("total_units")
    )


def daily(txns: DataFrame, visits: str | None = None) -> DataFrame:
    return _series(txns, visits, F.col("date")).orderBy("date")


def weekly(txns: DataFrame, visits: str | None = None) -> DataFrame:
    return _series(txns, visits, week_start(F.col("date")).alias("week_start")).orderBy("week_start")


def monthly(txns: DataFrame, visits: str | None = None) -> DataFrame:
    return _series(txns, visits, month_key(F.col("date")).alias("month")).orderBy("month")


def store_daily(txns: DataFrame, visits: str | None = None) -> DataFrame:
    return _series(txns, visits, F.col("date"), F.col("store_id")).orderBy("store_id", "date")


def store_columns(txns: DataFrame, stores: Sequence[int] | None = None) -> DataFrame:
    """One row per day, one column of transaction counts per store.

    Without ``stores`` Spark first looks up the store ids, one small job.
    """
    counts = txns.groupBy("date", "store_id").agg(F.count(F.lit(1)).alias("n"))
    pivot = counts.groupBy("date").pivot("store_id", list(stores) if stores else None)
    return pivot.agg(F.first("n")).orderBy("date")
