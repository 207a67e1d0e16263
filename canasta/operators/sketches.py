"""Opt-in box plots of any stores and months by merging sketches; the exact path stays the default.

A KLL sketch of whole numbers keeps a few hundred of them whatever their number, and merges with others. Quantiles
are values that occur, whose rank is off by at most about 1.33 % of the rows at the default size of 200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.functions.columns import month_key

#: Size of a sketch; larger ones are more exact.
SIZE = 200
#: Share of the rows by which a quantile's rank may be off, at that size (99 % confidence).
RANK_ERROR = 0.0133


def basket_size_sketches(txns: DataFrame, size: int = SIZE) -> DataFrame:
    """store_id, month, a sketch of basket sizes, and what merges exactly: count, sum, sum of squares, min and max."""
    value = F.col("basket_size").cast("bigint")
    return txns.groupBy("store_id", month_key(F.col("date")).alias("month")).agg(
        F.expr(f"kll_sketch_agg_bigint(CAST(basket_size AS BIGINT), {size})").alias("sketch"),
        F.count(value).alias("count"),
        F.sum(value).alias("total"),
        F.sum(value.cast("double") * value).alias("squares"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def sketched_stats(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, min, q1, median, q3, max, mean, std and count of the sketches of each group, merged."""
    merged = sketches.groupBy(*keys).agg(
        F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"),
        F.sum("count").alias("count"),
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    quantile = lambda q: F.expr(f"kll_sketch_get_quantile_bigint(sketch, {q}D)").cast("double")
    mean = F.col("total") / F.col("count")
    spread = F.greatest(F.lit(0.0), F.col("squares") - mean * F.col("total"))
    return merged.select(
        *keys,
        F.col("min").cast("double").alias("min"),
        quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("q3"),
        F.col("max").cast("double").alias("max"),
        mean.alias("mean"),
        F.sqrt(F.try_divide(spread, (F.col("count") - 1).cast("double"))).alias("std"),
        "count",
    )
