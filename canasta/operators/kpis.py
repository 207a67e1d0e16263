"""Executive summary: totals, rankings, store sales and the calendar heat map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions.columns import month_key, num_rows, percent_of, weekday_index, weekday_label, weekday_name
from canasta.functions.ranking import top_k
from canasta.operators.enrich import name_categories


def kpis(lines: DataFrame, txns: DataFrame, approximate: bool = False) -> DataFrame:
    """One row with the overall totals.

    Transactions are reduced to (client, store) first, so the distinct counts run
    on that much smaller set. ``approximate`` counts clients with a sketch.
    """
    visits = txns.groupBy("client_id", "store_id").agg(
        F.sum("basket_size").alias("units"),
        F.count(F.lit(1)).alias("visits"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    category_count = lines.select(F.countDistinct("category_id").alias("n")).scalar()
    return visits.agg(
        F.sum("units").alias("total_units"),
        F.sum("visits").alias("total_transactions"),
        distinct("client_id").alias("total_clients"),
        F.countDistinct("store_id").alias("total_stores"),
        F.min("first_day").alias("date_start"),
        F.max("last_day").alias("date_end"),
    ).select(
        "total_units",
        F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
        "total_clients",
        category_count.alias("total_categories"),
        "total_stores",
        "date_start",
        "date_end",
    )


def units_per_category(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """category_id, category_name, total_units; names are added after the grouping."""
    units = lines.groupBy("category_id").agg(F.sum("quantity").alias("total_units"))
    return name_categories(units, categories).select("category_id", "category_name", "total_units")


def _by_units() -> list[Column]:
    return [F.desc("total_units"), F.asc("category_id"), F.asc("category_name")]


def top_categories(lines: DataFrame, categories: DataFrame, n: int = fixed.TOP_N) -> DataFrame:
    return top_k(units_per_category(lines, categories), _by_units(), n)


def categories_by_volume(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with its units and its share of all units in percent."""
    volume = units_per_category(lines, categories)
    total = volume.select(F.sum("total_units").alias("total")).scalar()
    return volume.withColumn("percentage", percent_of(F.col("total_units"), total)).orderBy(
        *_by_units()
    )


def categories_with_remainder(
    lines: DataFrame, categories: DataFrame, slices: int = fixed.PIE_SLICES
) -> DataFrame:
    """The largest categories and, when there are more, one row with the sum of the others."""
    volume = units_per_category(lines, categories)
    top = top_k(volume, _by_units(), slices, rank="slice").select(
        "slice", F.col("category_name").alias("name"), "total_units"
    )
    shown = top.select(F.sum("total_units").alias("shown")).scalar()
    rest = (
        volume.agg(F.sum("total_units").alias("all_units"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > slices)
        .select(
            F.lit(slices + 1).alias("slice"),
            F.lit(fixed.REMAINDER_LABEL).alias("name"),
            (F.col("all_units") - shown).alias("total_units"),
        )
    )
    return top.unionByName(rest).orderBy("slice")


def top_clients(txns: DataFrame, n: int = fixed.TOP_N, visits: str | None = None) -> DataFrame:
    """Clients with the most transactions, with their units.

    Here and below ``visits`` names the number of transactions of a row, where rows are sums already.
    """
    clients = txns.groupBy("client_id").agg(
        num_rows(visits).alias("num_transactions"), F.sum("basket_size").alias("total_units")
    )
    return top_k(clients, [F.desc("num_transactions"), F.asc("client_id")], n)


def peak_days(txns: DataFrame, n: int = fixed.TOP_N, visits: str | None = None) -> DataFrame:
    """Days with the most transactions."""
    days = txns.groupBy("date").agg(
        num_rows(visits).alias("num_transactions"), F.sum("basket_size").alias("total_units")
    )
    best = top_k(days, [F.desc("num_transactions"), F.asc("date")], n)
    return best.select(
        "date",
        "num_transactions",
        "total_units",
        weekday_name(F.col("date")).alias("day_of_week"),
        "rank",
    )


def sales_by_store(txns: DataFrame, visits: str | None = None) -> DataFrame:
    """Units, transactions and clients per store, largest first.

    Grouping by (store, client) first makes the client count a plain count and
    spreads a hot store over its clients.
    """
    return (
        txns.groupBy("store_id", "client_id")
        .agg(F.sum("basket_size").alias("units"), num_rows(visits).alias("_visits"))
        .groupBy("store_id")
        .agg(
            F.sum("units").alias("total_units"),
            F.sum("_visits").alias("num_transactions"),
            F.count("client_id").alias("num_clients"),
        )
        .orderBy(F.desc("total_units"), "store_id")
    )


def weekly_heatmap(txns: DataFrame, visits: str | None = None) -> DataFrame:
    """Transactions per month and weekday, zero-filled over observed months and weekdays.

    One grouping per month with a conditional count per weekday already holds the
    zeros; weekdays never observed in any month are left out.
    """
    day = weekday_index(F.col("date"))
    per_month = txns.groupBy(month_key(F.col("date")).alias("month")).agg(
        *[F.sum(F.when(day == i, F.col(visits) if visits else 1).otherwise(0)).alias(f"d{i}") for i in range(7)]
    )
    cells = per_month.select(
        "month",
        F.posexplode(F.array(*[F.col(f"d{i}") for i in range(7)])).alias("day_of_week", "count"),
    )
    observed = Window.partitionBy("day_of_week")
    return (
        cells.withColumn("_seen", F.sum("count").over(observed))
        .filter(F.col("_seen") > 0)
        .select(
            "month",
            "day_of_week",
            weekday_label(F.col("day_of_week")).alias("day_name"),
            "count",
        )
        .orderBy("day_of_week", "month")
    )


def heatmap_wide(txns: DataFrame) -> DataFrame:
    """Months as rows, weekdays as short-labelled columns."""
    day = weekday_index(F.col("date"))
    return (
        txns.groupBy(month_key(F.col("date")).alias("month"))
        .agg(
            *[F.count_if(day == i).alias(label) for i, label in enumerate(fixed.WEEKDAYS_ES_SHORT)]
        )
        .orderBy("month")
    )


def heatmap_intensity(txns: DataFrame) -> DataFrame:
    """Heat map cells relative to the fullest one."""
    cells = weekly_heatmap(txns)
    fullest = cells.select(F.max("count").alias("fullest")).scalar()
    return cells.withColumn(
        "intensity",
        F.coalesce(F.try_divide(F.col("count").cast("double"), fullest.cast("double")), F.lit(0.0)),
    )
