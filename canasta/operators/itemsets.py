"""Frequent sets of more than two categories, and rules with several antecedents.

Sets grow level by level. Candidates of k categories are joined from frequent sets of k - 1 that share all but
their last one, and dropped unless all their subsets are frequent. A level is one scan of the baskets: a
task turns each batch of baskets into a bit map per category (vertical form), ands the maps of a candidate's
categories and counts bits, so it ships one number per candidate. Candidates go to the tasks in blocks of at most
``BLOCK``, a scan each; frequent sets and rules stay tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta import fixed
from canasta.operators.rules import basket_sets, category_counts, drop_non_finite
from canasta.session import materialize

#: Candidates that tasks hold at once: some MB.
BLOCK = 200_000


def _counted(baskets: DataFrame, candidates: list[tuple[int, ...]], least: int) -> DataFrame:
    """items and count of the candidates, which have one size, that ``least`` baskets hold. The task's code is its own."""
    spark = baskets.sparkSession
    wanted = np.array(candidates, np.int64)
    known, rows = np.unique(wanted, return_inverse=True)
    shared = spark.sparkContext.broadcast((known, rows.reshape(wanted.shape)))

    def count(batches):
        known, rows = shared.value
        total = np.zeros(len(rows), np.int64)
        ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)
        for batch in batches:
            lists = batch.column(0)
            basket = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, items), len(known) - 1)
            hit = known[at] == items
            held = np.zeros((len(known), -(-len(lists) // 8) * 8), bool)
            held[at[hit], basket[hit]] = True
            maps = np.packbits(held, axis=1)
            for start in range(0, len(rows), 4096):
                some = rows[start : start + 4096]
                both = maps[some[:, 0]]
                for j in range(1, some.shape[1]):
                    both = both & maps[some[:, j]]
                total[start : start + 4096] += ones[both].sum(axis=1, dtype=np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["candidate", "count"])

    counts = basket_sets(baskets).select("items").mapInArrow(count, "candidate long, count long")
    counts = counts.groupBy("candidate").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    named = spark.createDataFrame([(i, list(map(int, c))) for i, c in enumerate(candidates)], "candidate long, items array<int>")
    return counts.join(named, "candidate").select("items", "count")


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` categories all of whose subsets of one less are frequent."""
    head, tail = F.slice("items", 1, size - 2), F.element_at("items", -1)
    ends = frequent.groupBy(head.alias("head")).agg(F.array_sort(F.collect_list(tail)).alias("ends"))
    after = F.slice("ends", F.col("at") + 2, F.size("ends"))
    pairs = ends.select("head", "ends", F.posexplode("ends").alias("at", "x")).select("head", "x", F.explode(after).alias("y"))
    grown = pairs.select(F.concat("head", F.array("x", "y")).alias("items"))
    for left_out in range(size - 2):  # the two subsets that the join was made from are frequent
        rest = F.concat(F.slice("items", 1, left_out), F.slice("items", left_out + 2, size))
        grown = grown.withColumn("rest", rest).join(frequent.select(F.col("items").alias("rest")), "rest", "left_semi").drop("rest")
    return grown


def frequent_itemsets(
    baskets: DataFrame, min_support: float = fixed.MIN_SUPPORT, max_size: int = 3, n_baskets: int | None = None
) -> DataFrame:
    """items (ascending category ids), count and support of all frequent sets of at most ``max_size`` categories.

    ``baskets`` is scanned once per level, so it is best a stored table.
    """
    total = baskets.count() if n_baskets is None else n_baskets
    least = _least_count(min_support, total)
    single = category_counts(baskets).where(F.col("count") >= least)
    level = materialize(single.select(F.array("category_id").alias("items"), "count"), "itemsets")
    levels = [level]
    for size in range(2, max_size + 1):
        found, block = [], []
        for row in _candidates(level, size).toLocalIterator():
            block.append(tuple(row["items"]))
            if len(block) == BLOCK:
                found.append(materialize(_counted(baskets, block, least), "itemsets"))
                block = []
        if block:
            found.append(materialize(_counted(baskets, block, least), "itemsets"))
        if not found:
            break
        level = reduce(DataFrame.union, found)
        levels.append(level)
    every = reduce(DataFrame.union, levels)
    return every.withColumn("support", F.col("count").cast("double") / F.lit(float(max(total, 1))))


def _least_count(min_support: float, total: int) -> int:
    """The least count whose share, as a double, reaches the support; 1 at least."""
    least = max(1, int(min_support * total))
    while least / max(total, 1) < min_support:
        least += 1
    while least > 1 and (least - 1) / total >= min_support:
        least -= 1
    return least


def itemset_rules(
    itemsets: DataFrame,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    min_lift: float = fixed.MIN_LIFT,
) -> DataFrame:
    """antecedent_ids, consequent_id, support, confidence and lift (4 decimals) of rules with one consequent.

    Every set gives a rule per member: the others imply it. Thresholds apply before rounding.
    """
    sets = itemsets.where(F.size("items") > 1)
    rules = sets.select("items", "support", F.explode("items").alias("consequent_id")).withColumn(
        "antecedent_ids", F.array_remove("items", F.col("consequent_id"))
    )
    left = itemsets.select(F.col("items").alias("antecedent_ids"), F.col("support").alias("left_support"))
    right = itemsets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("consequent_id"), F.col("support").alias("right_support")
    )
    confidence = F.col("support") / F.col("left_support")
    scored = rules.join(left, "antecedent_ids").join(right, "consequent_id").select(
        "antecedent_ids",
        "consequent_id",
        "support",
        confidence.alias("confidence"),
        (F.col("support") / (F.col("left_support") * F.col("right_support"))).alias("lift"),
    )
    kept = scored.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    metrics = {c: F.round(F.col(c), 4) for c in ("support", "confidence", "lift")}
    return drop_non_finite(kept, list(metrics)).withColumns(metrics)
