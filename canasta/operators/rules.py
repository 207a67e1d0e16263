"""Association rules between categories.

Everything here starts from baskets (one row per transaction with nested items)
and stays row-local up to the final counts: a category bought twice in one
transaction counts once, and only frequent categories enter the pair stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions.columns import is_finite
from canasta.functions.ranking import top_k, top_k_per_group
from canasta.operators.enrich import name_categories
from canasta.session import broadcast_if_small

RULE_COLUMNS = [
    "antecedent_id",
    "antecedent",
    "consequent_id",
    "consequent",
    "support",
    "confidence",
    "lift",
]


# ---- baskets ----------------------------------------------------------------


def basket_sets(baskets: DataFrame) -> DataFrame:
    """transaction_id and ``items`` as the ascending array of distinct category ids."""
    return baskets.select("transaction_id", F.col("items.category_id").alias("items"))


def sample_baskets(baskets: DataFrame, fraction: float, seed: int = fixed.SEED) -> DataFrame:
    """Whole transactions chosen by a hash of their id; optional, nothing here needs it."""
    slots = 1_000_000
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("transaction_id").cast("string")))
    slot = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % slots
    return baskets.filter(slot < int(round(fraction * slots)))


# ---- supports and co-occurrence ---------------------------------------------


def category_counts(baskets: DataFrame) -> DataFrame:
    """Baskets containing each category; a task ships one row per category."""
    return (
        basket_sets(baskets)
        .select(F.explode("items").alias("category_id"))
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _with_support(baskets: DataFrame, min_support: float, n_baskets: int) -> DataFrame:
    support = F.col("count").cast("double") / F.lit(float(n_baskets))
    counted = category_counts(baskets).withColumn("support", support)
    return counted.filter(F.col("support") >= min_support)


def category_support(
    baskets: DataFrame,
    categories: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    n_baskets: int | None = None,
) -> DataFrame:
    """Baskets containing each category, for those that reach the support."""
    total = baskets.count() if n_baskets is None else n_baskets
    return support_of_counts(category_counts(baskets), categories, min_support, total)


def support_of_counts(counts: DataFrame, categories: DataFrame, min_support: float, n_baskets: int) -> DataFrame:
    """The same from counts (category_id, count)."""
    support = F.col("count").cast("double") / F.lit(float(n_baskets))
    frequent = counts.withColumn("support", support).filter(F.col("support") >= min_support)
    return (
        name_categories(frequent, categories)
        .select("category_id", "category_name", "count", F.round("support", 4).alias("support"))
        .orderBy(F.desc("support"), "category_id")
    )


def frequent_categories(
    baskets: DataFrame, min_support: float, n_baskets: int | None = None
) -> list[int]:
    """Ids of the categories that reach the support.

    Each fills min_support of all baskets, so there are at most
    (mean distinct categories per basket) / min_support of them: a short list
    whatever the size of the data or of the catalogue.
    """
    total = baskets.count() if n_baskets is None else n_baskets
    ids = _with_support(baskets, min_support, total).select("category_id")
    return sorted(row.category_id for row in ids.toLocalIterator())


def pair_counts(baskets: DataFrame, frequent: Sequence[int]) -> DataFrame:
    """Baskets holding both categories, for every ordered pair including (x, x).

    A basket keeps its frequent categories only (see there for the bound on
    their number) and lists each unordered pair once; pairs are counted map-side,
    so a task ships at most one row per pair of frequent categories. Both orders
    come from mirroring the counts.
    """
    kept = F.filter("items", lambda category: category.isin(list(frequent)))
    rest = F.slice("items", F.col("_pos") + 1, F.size("items"))
    half = (
        basket_sets(baskets)
        .select(kept.alias("items"))
        .select("items", F.posexplode("items").alias("_pos", "x"))
        .select("x", F.explode(rest).alias("y"))
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("num_baskets"))
    )
    return mirrored(half)


# ---- rules ------------------------------------------------------------------


def _rule_order() -> list[Column]:
    return [F.desc("lift"), F.desc("confidence"), F.asc("antecedent_id"), F.asc("consequent_id")]


def association_rules(
    baskets: DataFrame,
    categories: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
    n_baskets: int | None = None,
) -> DataFrame:
    """All rules antecedent -> consequent that pass the three (unrounded) thresholds.

    ``baskets`` is scanned twice (three times without ``n_baskets``), so it is
    best a stored table.
    """
    total = baskets.count() if n_baskets is None else n_baskets
    pairs = pair_counts(baskets, frequent_categories(baskets, min_support, total))
    return rules_of_counts(pairs, categories, total, min_support, min_confidence, min_lift)


def mirrored(half: DataFrame) -> DataFrame:
    """Counts (x, y, num_baskets) of unordered pairs, for both orders."""
    as_is = F.struct("x", "y")
    swapped = F.struct(F.col("y").alias("x"), F.col("x").alias("y"))
    orders = F.when(F.col("x") == F.col("y"), F.array(as_is)).otherwise(F.array(as_is, swapped))
    return half.select(F.inline(orders), "num_baskets")


def rules_of_counts(
    pairs: DataFrame,
    categories: DataFrame,
    total: int,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
) -> DataFrame:
    """The rules that pass the thresholds, from the counts of all ordered pairs, (x, x) included, of frequent categories.

    Pairs of other categories may be there too: no rule of theirs reaches the support.
    """
    # The (x, x) row of the pair table holds the count of x itself.
    own_count = F.when(F.col("x") == F.col("y"), F.col("num_baskets"))
    n = F.lit(float(total))
    together = F.col("num_baskets").cast("double")
    n_x, n_y = F.col("_n_x").cast("double"), F.col("_n_y").cast("double")
    rules = (
        pairs.withColumn("_n_x", F.max(own_count).over(Window.partitionBy("x")))
        .withColumn("_n_y", F.max(own_count).over(Window.partitionBy("y")))
        .filter(F.col("x") != F.col("y"))
        .select(
            F.col("x").alias("antecedent_id"),
            F.col("y").alias("consequent_id"),
            (together / n).alias("support"),
            (together / n_x).alias("confidence"),
            ((together / n) / ((n_x / n) * (n_y / n))).alias("lift"),
        )
        .filter(
            (F.col("support") >= min_support)
            & (F.col("confidence") >= min_confidence)
            & (F.col("lift") >= min_lift)
        )
    )
    return finish_rules(rules, categories)


def finish_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Names on both sides, metrics to 4 decimals, rules with non-finite metrics dropped."""
    finite = drop_non_finite(rules, ["support", "confidence", "lift"])
    named = name_categories(finite, categories, "antecedent_id", "antecedent")
    named = name_categories(named, categories, "consequent_id", "consequent")
    metrics = {c: F.round(F.col(c), 4) for c in ("support", "confidence", "lift")}
    return named.withColumns(metrics).select(*RULE_COLUMNS)


def drop_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for column in columns:
        df = df.filter(is_finite(F.col(column)))
    return df


def ordered_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(*_rule_order())


def top_rules(rules: DataFrame, n: int = fixed.MAX_RULES) -> DataFrame:
    return top_k(rules, _rule_order(), n)


def category_index(rules: DataFrame, n: int | None = fixed.INDEX_PER_CATEGORY) -> DataFrame:
    """The best ``n`` suggestions of every antecedent, in rule order; all of them with None."""
    if n is None:
        order = Window.partitionBy("antecedent").orderBy(*_rule_order())
        return rules.select(*RULE_COLUMNS).withColumn("rank", F.row_number().over(order))
    return top_k_per_group(rules, ["antecedent"], _rule_order(), n).select(*RULE_COLUMNS, "rank")


def nested_index(index: DataFrame) -> DataFrame:
    """One row per antecedent with its suggestions as an ordered array, for document output."""
    suggestion = F.struct(
        "rank",
        F.col("consequent").alias("recommendation"),
        "confidence",
        "lift",
        "support",
    )
    return (
        index.groupBy("antecedent")
        .agg(F.sort_array(F.collect_list(suggestion)).alias("recommendations"))
        .orderBy("antecedent")
    )


def rule_metadata(
    baskets: DataFrame,
    rules: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
    n_baskets: int | None = None,
) -> DataFrame:
    """One row: baskets, categories, thresholds and the number of rules."""
    total = baskets.count() if n_baskets is None else n_baskets
    return metadata_of_counts(category_counts(baskets), rules, total, min_support, min_confidence, min_lift)


def metadata_of_counts(
    counts: DataFrame, rules: DataFrame, total: int, min_support: float, min_confidence: float, min_lift: float
) -> DataFrame:
    """The same from counts (category_id, count)."""
    category_count = counts.select(F.count(F.lit(1)).alias("n")).scalar()
    return rules.agg(F.count(F.lit(1)).alias("total_rules")).select(
        F.lit(total).cast("bigint").alias("n_transactions"),
        category_count.alias("n_categories"),
        F.lit(float(min_support)).alias("min_support"),
        F.lit(float(min_confidence)).alias("min_confidence"),
        F.lit(float(min_lift)).alias("min_lift"),
        "total_rules",
    )


# ---- FP-Growth --------------------------------------------------------------


def fit_fpgrowth(
    baskets: DataFrame,
    min_support: float = fixed.MIN_SUPPORT,
    min_confidence: float = fixed.MIN_CONFIDENCE,
) -> FPGrowthModel:
    return FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(basket_sets(baskets))


def fpgrowth_rules(
    model: FPGrowthModel, categories: DataFrame, min_lift: float = fixed.MIN_LIFT
) -> DataFrame:
    """The model's one-to-one rules in the same form as :func:`association_rules`."""
    single = model.associationRules.filter(
        (F.size("antecedent") == 1) & (F.size("consequent") == 1)
    ).select(
        F.col("antecedent")[0].alias("antecedent_id"),
        F.col("consequent")[0].alias("consequent_id"),
        "support",
        "confidence",
        "lift",
    )
    return finish_rules(single.filter(F.col("lift") >= min_lift), categories)


def suggest_for_baskets(rules: DataFrame, baskets: DataFrame) -> DataFrame:
    """transaction_id and num_suggestions: categories that one-to-one rules suggest and the basket lacks.

    A join of basket items with rules; baskets without a suggestion have 0.
    """
    sets = basket_sets(baskets)
    items = sets.select("transaction_id", "items", F.explode("items").alias("antecedent_id"))
    met = items.join(
        broadcast_if_small(rules.select("antecedent_id", "consequent_id").distinct()), "antecedent_id", "left"
    )
    fresh = F.when(~F.array_contains("items", F.col("consequent_id")), F.col("consequent_id"))
    return met.groupBy("transaction_id").agg(F.countDistinct(fresh).alias("num_suggestions"))
