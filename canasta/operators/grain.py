"""The grains reports start from.

lines         one row per (transaction, item): the exploded fact
baskets       one row per transaction with its items nested; grouping the fact
              costs two shuffles once, everything after that is row-local
transactions  the flat columns of baskets, for reports that need no items
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWNER = ["client_id", "store_id", "date"]


def transactions(lines: DataFrame) -> DataFrame:
    """One row per transaction: client, store, date, basket_size, num_categories.

    Client, store and date belong to the transaction, so they ride along as
    ``min`` instead of widening the grouping key, and Catalyst drops whichever
    columns the report does not use. From here on a count of transactions is a
    plain count, not a distinct one.
    """
    return lines.groupBy("transaction_id").agg(
        *[F.min(c).alias(c) for c in _OWNER],
        F.sum("quantity").alias("basket_size"),
        F.countDistinct("category_id").alias("num_categories"),
    )


def baskets(lines: DataFrame) -> DataFrame:
    """The columns of :func:`transactions` plus ``items``: (category_id, quantity) by category.

    The fact is first summed per (transaction, category), map-side as well, so a
    transaction of any number of rows brings at most one row per category into
    the array. Both groupings follow the transaction, so a fact that comes
    partitioned by it (from a shuffled join with its orders) is not moved again.
    """
    summed = lines.groupBy("transaction_id", "category_id").agg(
        *[F.min(c).alias(c) for c in _OWNER], F.sum("quantity").alias("quantity")
    )
    return summed.groupBy("transaction_id").agg(
        *[F.min(c).alias(c) for c in _OWNER],
        F.sum("quantity").alias("basket_size"),
        F.count(F.lit(1)).alias("num_categories"),
        F.sort_array(F.collect_list(F.struct("category_id", "quantity"))).alias("items"),
    )


def unnest(baskets: DataFrame) -> DataFrame:
    """The fact back from baskets, one row per (transaction, category) with its quantity."""
    return baskets.select(
        "transaction_id", "date", "store_id", "client_id", F.inline("items")
    )


def basket_items(lines: DataFrame) -> DataFrame:
    """Baskets as sets: distinct (transaction_id, category_id)."""
    return lines.select("transaction_id", "category_id").distinct()


def client_items(lines: DataFrame) -> DataFrame:
    """Distinct (client_id, category_id)."""
    return lines.select("client_id", "category_id").distinct()
