"""Category names on facts and on aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions.columns import category_display_name
from canasta.session import broadcast_if_small


def with_category_names(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """The fact with ``category_name``; ids missing from the dimension get a generic name.

    The dimension is broadcast when it is counted to be small enough.
    """
    return name_categories(lines, broadcast_if_small(categories))


def name_categories(
    df: DataFrame,
    categories: DataFrame,
    id_column: str = "category_id",
    name_column: str = "category_name",
) -> DataFrame:
    """Adds the name of ``id_column`` as ``name_column``.

    Used directly on aggregates with one row per category or rule, where Spark
    picks the join itself: names are looked up after the grouping on ids, not on
    every fact row.
    """
    names = categories.select(
        F.col("category_id").alias("_category"), F.col("category_name").alias("_name")
    )
    joined = df.join(names, df[id_column] == F.col("_category"), "left")
    return joined.select(
        *[df[c] for c in df.columns],
        category_display_name(F.col("_name"), df[id_column]).alias(name_column),
    )


def names_are_unique(categories: DataFrame) -> bool:
    """Whether no two category ids can end up with the same name.

    A dimension name of the generic form could meet that of an unknown id.
    """
    doubtful = categories.groupBy("category_name").agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1)
        | F.col("category_name").isNull()
        | F.col("category_name").rlike(f"^{fixed.UNKNOWN_CATEGORY_PREFIX}-?[0-9]+$")
    )
    return doubtful.isEmpty()
