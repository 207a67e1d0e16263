"""Lookups on the rule index: by category, by segment and by client."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions.ranking import top_k_per_group
from canasta.operators.rules import (
    category_support,
    drop_non_finite,
    rule_metadata,
    top_rules,
)
from canasta.operators.segmentation import has_few_segments

_SUGGESTION = ["rank", "consequent_id", "consequent", "confidence", "lift", "support"]


def recommend_by_category(index: DataFrame, name: str) -> DataFrame:
    """Suggestions for a category name in rank order; empty when it has no rules."""
    return index.filter(F.col("antecedent") == name).select(*_SUGGESTION).orderBy("rank")


def recommend_by_category_id(index: DataFrame, category_id: int) -> DataFrame:
    return index.filter(F.col("antecedent_id") == category_id).select(*_SUGGESTION).orderBy("rank")


def categories_with_rules(index: DataFrame) -> DataFrame:
    return index.select(F.col("antecedent").alias("category_name")).distinct().orderBy(
        "category_name"
    )


def overview(
    baskets: DataFrame,
    categories: DataFrame,
    mined: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
    n: int = fixed.OVERVIEW_ROWS,
) -> dict[str, DataFrame]:
    """Rule metadata, the categories that have rules, and the first supports and rules."""
    supports = category_support(baskets, categories, min_support)
    return {
        "metadata": rule_metadata(baskets, mined, min_support, min_confidence, min_lift),
        "categories_with_rules": categories_with_rules(mined),
        "category_support": supports.limit(n),
        "top_rules": top_rules(mined, n),
    }


def search_categories(
    index: DataFrame, text: str, n: int = fixed.SUGGESTIONS_SHOWN
) -> DataFrame:
    """First ``n`` categories with rules whose name contains the text in any case."""
    names = index.select(F.col("antecedent").alias("category_name")).distinct()
    return (
        names.filter(F.lower("category_name").contains(text.lower()))
        .orderBy("category_name")
        .limit(n)
    )


def recommend_by_segment(
    top_categories: DataFrame,
    index: DataFrame,
    n: int = fixed.RECOMMENDATIONS_PER_CLIENT,
    per_category: int | None = None,
) -> DataFrame:
    """Suggestions per segment from the rules of its top categories.

    ``index`` ranks the rules of every antecedent, best uncut; ``per_category`` looks at so many of each
    category (the published lookup: ``fixed.INDEX_PER_CATEGORY``), None at all.

    Top categories are walked in rank order and their rules in rule order; a
    consequent is taken where it first appears, unless it is a top category
    itself. What remains is ordered by lift, ties in the order found.
    """
    top = top_categories.select(
        "segment_id", F.col("category_name").alias("from_category"), F.col("rank").alias("_category_rank")
    )
    rules = drop_non_finite(index, ["lift", "confidence"]).withColumnRenamed("rank", "_rule_rank")
    if per_category is not None:
        rules = rules.filter(F.col("_rule_rank") <= per_category)
    found = top.join(rules, top.from_category == rules.antecedent)
    own = top.select("segment_id", F.col("from_category").alias("consequent"))
    fresh = found.join(own, ["segment_id", "consequent"], "left_anti")
    seen = Window.partitionBy("segment_id", "consequent").orderBy("_category_rank", "_rule_rank")
    first_seen = fresh.withColumn("_seen", F.row_number().over(seen)).filter(F.col("_seen") == 1)
    return top_k_per_group(
        first_seen,
        ["segment_id"],
        [F.desc("lift"), F.asc("_category_rank"), F.asc("_rule_rank")],
        n,
    ).select(
        "segment_id",
        "rank",
        "from_category",
        F.col("consequent").alias("recommendation"),
        "confidence",
        "lift",
        "support",
    )


def recommend_for_clients(
    segments: DataFrame, segment_recommendations: DataFrame, client_id: int | None = None
) -> DataFrame:
    """Every client with the suggestions of its segment, or those of one client.

    An unknown client gives an empty result. The suggestions are broadcast when
    the segments are counted to be few (each has a bounded list); otherwise Spark
    shuffles and splits hot segments.
    """
    few = has_few_segments(segments)
    clients = segments if client_id is None else segments.filter(F.col("client_id") == client_id)
    suggestions = F.broadcast(segment_recommendations) if few else segment_recommendations
    return clients.join(suggestions, "segment_id").select(
        "client_id",
        "segment_id",
        "rank",
        "from_category",
        "recommendation",
        "confidence",
        "lift",
        "support",
    )


def client_answer(
    segments: DataFrame,
    labels: DataFrame,
    top_categories: DataFrame,
    segment_recommendations: DataFrame,
    client_id: int | None = None,
) -> DataFrame:
    """The suggestions of :func:`recommend_for_clients` with the segment's label and top categories.

    ``top_categories`` is an array in rank order, one short list per segment.
    """
    ranked = F.sort_array(F.collect_list(F.struct("rank", "category_name")))
    lists = top_categories.groupBy("segment_id").agg(ranked.alias("_ranked"))
    lists = lists.select("segment_id", F.col("_ranked.category_name").alias("top_categories"))
    described = lists.join(labels.withColumnRenamed("label", "segment_label"), "segment_id", "left")
    if has_few_segments(segments):
        described = F.broadcast(described)
    return recommend_for_clients(segments, segment_recommendations, client_id).join(
        described, "segment_id"
    )
