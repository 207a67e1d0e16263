"""The basket fact read from a star schema (lineitem, orders, part, customer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category ids above this have no row in the dimension, so their generic name is used.
NAMED_CATEGORIES = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _brand_number() -> F.Column:
    return F.expr(r"try_cast(regexp_extract(p_brand, r'(\d+)', 1) AS INT)")


def lines(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    """One row per (transaction, item): transaction, date, store, client, category, quantity.

    ``weighted`` takes the line quantity instead of one unit per line. The join
    with orders comes last, so that on large inputs its output is already
    partitioned by transaction for the groupings that follow. Orders without
    lines do not appear. No broadcast is forced: all three tables grow with the
    data, Spark decides by their size.
    """
    item = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = (
        _table(spark, sf_dir, "part")
        .select("p_partkey", _brand_number().alias("category_id"))
        .filter(F.col("category_id").isNotNull())
    )
    order = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    quantity = F.col("l_quantity") if weighted else F.lit(1)
    return (
        item.join(part, item.l_partkey == part.p_partkey)
        .join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("transaction_id"),
            F.to_date("o_orderdate").alias("date"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("store_id"),
            F.col("o_custkey").alias("client_id"),
            "category_id",
            quantity.cast("bigint").alias("quantity"),
        )
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dimension: brand number and brand."""
    return (
        _table(spark, sf_dir, "part")
        .select(_brand_number().alias("category_id"), F.col("p_brand").alias("category_name"))
        .filter(F.col("category_id") <= NAMED_CATEGORIES)
        .distinct()
    )


def market_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given client segmentation: the customer's market segment."""
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_mktsegment").alias("segment_id")
    )


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item written the way a raw transaction line looks.

    Each becomes one small basket: the category, a second item code after a
    double blank and, for returned items, a token that is no number. Nothing is
    grouped, so this works for an order of any size.
    """
    item = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"
    )
    part = _table(spark, sf_dir, "part").select("p_partkey", _brand_number().alias("category"))
    order = _table(spark, sf_dir, "orders")
    return (
        item.join(part, item.l_partkey == part.p_partkey)
        .join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.substring("o_orderpriority", 1, 1).alias("store_id"),
            F.col("o_custkey").cast("string").alias("client_id"),
            F.concat(
                F.col("category").cast("string"),
                F.lit("  "),
                F.col("l_linenumber").cast("string"),
                F.when(F.col("l_returnflag") == "R", " x").otherwise(""),
            ).alias("items_str"),
        )
    )
