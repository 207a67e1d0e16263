"""KPIs of any stores and months from one mergeable table of bit maps.

A row holds, for a store and month, either its sums or a bit map of 32,768 client or category ids that occur
there. The table comes from one aggregation over baskets; tables of different baskets merge by the same grouping,
and distinct counts of any union of rows are exact: bit maps are or-ed and their bits counted. Ids that are spread
thinly over a wide range fill a bit map each; for such the sketches count clients approximately in bounded space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.functions.columns import month_key

KEYS = ["store_id", "month", "kind", "bucket"]
SUMS, CLIENTS, CATEGORIES = 0, 1, 2


def store_months(baskets: DataFrame) -> DataFrame:
    """KEYS, units, visits, first_day, last_day (of SUMS rows) and bits (of the others), one read of the baskets."""
    none = F.lit(None)
    sums = F.struct(F.lit(SUMS).alias("kind"), none.cast("bigint").alias("id"))
    client = F.struct(F.lit(CLIENTS).alias("kind"), F.col("client_id").cast("bigint").alias("id"))
    items = F.transform("items", lambda i: F.struct(F.lit(CATEGORIES).alias("kind"), i["category_id"].cast("bigint").alias("id")))
    rows = baskets.select(
        "store_id", "date", "basket_size", month_key(F.col("date")).alias("month"), F.inline(F.concat(F.array(sums, client), items))
    ).where((F.col("kind") == SUMS) | F.col("id").isNotNull())
    total = lambda c: F.when(F.col("kind") == SUMS, c)
    place = F.when(F.col("kind") != SUMS, F.bitmap_bit_position("id"))
    return rows.groupBy("store_id", "month", "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.sum(total(F.col("basket_size"))).alias("units"),
        F.sum(total(F.lit(1).cast("bigint"))).alias("visits"),
        F.min(total(F.col("date"))).alias("first_day"),
        F.max(total(F.col("date"))).alias("last_day"),
        F.bitmap_construct_agg(F.coalesce(place, F.lit(0).cast("bigint"))).alias("bits"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The table of all baskets from the tables of parts of them."""
    return parts.groupBy(*KEYS).agg(
        F.sum("units").alias("units"),
        F.sum("visits").alias("visits"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.bitmap_or_agg("bits").alias("bits"),
    )


def _chosen(table: DataFrame, first_month: str | None, last_month: str | None, stores: list[int] | None) -> DataFrame:
    if first_month is not None:
        table = table.where(F.col("month") >= first_month)
    if last_month is not None:
        table = table.where(F.col("month") <= last_month)
    return table if stores is None else table.where(F.col("store_id").isin(stores))


def kpis(
    table: DataFrame,
    first_month: str | None = None,
    last_month: str | None = None,
    stores: list[int] | None = None,
) -> DataFrame:
    """The KPI row of the stores and months asked for, with exact distinct counts."""
    rows = _chosen(table, first_month, last_month, stores)
    maps = rows.groupBy("kind", "bucket").agg(
        F.sum("units").alias("units"),
        F.sum("visits").alias("visits"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.collect_set(F.when(F.col("kind") == SUMS, F.col("store_id"))).alias("stores"),
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("ids"),
    )
    counted = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("ids"))), F.lit(0))
    return maps.agg(
        F.sum("units").alias("total_units"),
        F.coalesce(F.sum("visits"), F.lit(0)).alias("total_transactions"),
        counted(CLIENTS).alias("total_clients"),
        counted(CATEGORIES).alias("total_categories"),
        F.coalesce(F.sum(F.size("stores")), F.lit(0)).cast("bigint").alias("total_stores"),
        F.min("first_day").alias("date_start"),
        F.max("last_day").alias("date_end"),
    )


# ---- sketches ---------------------------------------------------------------


def client_sketches(txns: DataFrame, bits: int = 14) -> DataFrame:
    """store_id, month and a HyperLogLog sketch of the clients seen there; merges by ``hll_union_agg``."""
    return txns.groupBy("store_id", month_key(F.col("date")).alias("month")).agg(
        F.hll_sketch_agg("client_id", bits).alias("clients")
    )


def sketched_clients(
    sketches: DataFrame,
    first_month: str | None = None,
    last_month: str | None = None,
    stores: list[int] | None = None,
) -> DataFrame:
    """One row: about how many clients the stores and months asked for have."""
    union = F.hll_union_agg("clients")
    return _chosen(sketches, first_month, last_month, stores).agg(
        F.coalesce(F.hll_sketch_estimate(union), F.lit(0)).alias("clients")
    )
