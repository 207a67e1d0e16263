"""Top-k, overall and per group, with a rank column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order_by: Sequence[Column], k: int, rank: str | None = "rank") -> DataFrame:
    """First ``k`` rows under a total order, ranked from 1.

    Each task keeps k rows (TakeOrderedAndProject); the window that numbers them
    only ever sees those k rows.
    """
    best = df.orderBy(*order_by).limit(k)
    if rank is None:
        return best
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order_by)))


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group, ranked from 1.

    The filter on row_number lets Spark cut each group to k rows before the
    shuffle (WindowGroupLimit), so a hot group sends k rows per task.
    """
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)
