"""Exact distribution statistics that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.functions.columns import num_rows

QUARTILES = [0.25, 0.5, 0.75]


def describe_counts(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    decimals: int | None = None,
    frequency: str | None = None,
) -> DataFrame:
    """min, q1, median, q3, max, mean, std and count of a whole-number column.

    Rows are first reduced to (keys, value) frequencies with map-side partial
    aggregation, and all statistics come from those. The sum of d distinct
    positive whole numbers is at least d(d+1)/2, so a group with U units has at
    most sqrt(2 U) distinct values: the last step stays small at any row count
    and for any hot group. Quantiles interpolate linearly and std has n-1 in the
    denominator (null for a single value). ``frequency`` names the number of values that a row stands for.
    """
    keys = list(keys)
    histogram = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(num_rows(frequency).alias("_freq"))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    weighted = (F.col("_value") * F.col("_freq")).cast("double")
    histogram = histogram.withColumn(
        "_mean", F.sum(weighted).over(group) / F.sum("_freq").over(group)
    )
    squares = F.sum(F.col("_freq") * F.pow(F.col("_value") - F.col("_mean"), F.lit(2.0)))
    result = histogram.groupBy(*keys).agg(
        F.min("_value").cast("double").alias("min"),
        F.percentile("_value", F.array(*[F.lit(q) for q in QUARTILES]), F.col("_freq")).alias("_q"),
        F.max("_value").cast("double").alias("max"),
        F.max("_mean").alias("mean"),
        squares.alias("_squares"),
        F.sum("_freq").alias("count"),
    )
    std = F.sqrt(F.try_divide(F.col("_squares"), (F.col("count") - 1).cast("double")))
    numbers = {
        "min": F.col("min"),
        "q1": F.col("_q")[0],
        "median": F.col("_q")[1],
        "q3": F.col("_q")[2],
        "max": F.col("max"),
        "mean": F.col("mean"),
        "std": std,
    }
    if decimals is not None:
        numbers = {name: F.round(number, decimals) for name, number in numbers.items()}
    return result.select(
        *keys, *[number.alias(name) for name, number in numbers.items()], "count"
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probability: float = 0.5,
    accuracy: int = 10_000,
    few_groups: bool = False,
) -> DataFrame:
    """Exact, linearly interpolated quantile of numeric columns per group.

    Returns (keys, feature, n, quantile). ``percentile`` would keep every
    distinct value of a group in one task, which for ratios is one per client.
    Here the sketch of ``percentile_approx`` brackets the wanted rank first: its
    rank error is at most n / accuracy, so the values two errors below and above
    enclose it. Then everything outside the bracket collapses to two counts
    and only the bracket, about 4 n / accuracy values, is ranked.

    ``few_groups`` states that the caller counted the groups and found them few;
    the brackets (one row per group and column) are then broadcast, so that the
    groups, which are hot keys by nature, are never shuffled whole.
    """
    keys = list(keys)
    margin = 2.0 / accuracy
    low, high = max(0.0, probability - margin), min(1.0, probability + margin)

    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ).alias("_pair"),
    ).select(*keys, "_pair.feature", "_pair.value")
    long = long.filter(F.col("value").isNotNull())

    brackets = long.groupBy(*keys, "feature").agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", [low, high], accuracy).alias("_bounds"),
    )
    side = (
        F.when(F.col("value") < F.col("_bounds")[0], -1)
        .when(F.col("value") > F.col("_bounds")[1], 1)
        .otherwise(0)
    )
    # Below the bracket only the largest value can matter, above it only the smallest.
    collapsed = (
        long.join(F.broadcast(brackets) if few_groups else brackets, [*keys, "feature"])
        .withColumn("_side", side)
        .groupBy(
            *keys, "feature", "_side", F.when(F.col("_side") == 0, F.col("value")).alias("_inside")
        )
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max("n").alias("n"),
            F.when(F.first("_side") < 0, F.max("value")).otherwise(F.min("value")).alias("value"),
        )
    )
    ranked = collapsed.withColumn(
        "_through",
        F.sum("_rows").over(
            Window.partitionBy(*keys, "feature")
            .orderBy("_side", "value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    position = F.lit(probability) * (F.col("n") - 1)
    below = F.floor(position)
    fraction = position - below
    return (
        ranked.withColumn("_below", below)
        .withColumn("_fraction", fraction)
        .groupBy(*keys, "feature", "n", "_fraction")
        .agg(
            F.min(F.when(F.col("_through") > F.col("_below"), F.col("value"))).alias("_lo"),
            F.min(F.when(F.col("_through") > F.col("_below") + 1, F.col("value"))).alias("_hi"),
        )
        .select(
            *keys,
            "feature",
            "n",
            (
                F.col("_lo") + F.col("_fraction") * (F.coalesce("_hi", "_lo") - F.col("_lo"))
            ).alias("quantile"),
        )
    )
