"""Rules, recommendations and segmentation: brute force and invariants."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canasta import fixed
from canasta.operators import recommend, rules, segmentation as seg
from canasta.operators.grain import baskets

CATEGORY = "category_id INT, category_name STRING"


@pytest.fixture(scope="module")
def market(spark):
    """400 transactions over 90 categories (some rare), one basket with every category."""
    rng = np.random.default_rng(5)
    sets = [set(rng.geometric(0.08, rng.integers(1, 12)).clip(1, 90).tolist()) for _ in range(400)]
    sets.append(set(range(1, 91)))
    rows = [(t, int(c)) for t, s in enumerate(sets) for c in s for _ in range(1 + (c % 2))]
    lines = spark.createDataFrame(rows, "transaction_id BIGINT, category_id INT").selectExpr(
        "*", "1L AS client_id", "1 AS store_id", "DATE'2024-01-01' AS date", "1L AS quantity"
    )
    categories = spark.createDataFrame([(i, f"c{i:02d}") for i in range(1, 80)], CATEGORY)
    return sets, baskets(lines).cache(), categories


@pytest.mark.parametrize("support, confidence, lift", [(0.05, 0.3, 1.0), (0.02, 0.1, 1.2), (0.0, 0.0, 0.0)])
def test_rules_against_brute_force(market, support, confidence, lift):
    sets, nested, categories = market
    n = len(sets)
    single = Counter(c for s in sets for c in s)
    pairs = Counter(p for s in sets for p in permutations(s, 2))
    want = {}
    for (a, b), count in pairs.items():
        s, f = count / n, count / single[a]
        x = s / ((single[a] / n) * (single[b] / n))
        if s >= support and f >= confidence and x >= lift:
            want[a, b] = (s, f, x)
    got = rules.association_rules(nested, categories, support, confidence, lift).collect()
    assert len(got) == len(want) > 0
    for r in got:
        expected = want[r.antecedent_id, r.consequent_id]
        assert (r.support, r.confidence, r.lift) == pytest.approx(expected, abs=5.1e-5)
    values = {(r.antecedent_id, r.consequent_id): r for r in got}
    for (a, b), r in values.items():
        if (b, a) in values:
            assert (r.lift, r.support) == (values[b, a].lift, values[b, a].support)


def test_fpgrowth_agrees_with_pair_counting(market):
    _, nested, categories = market
    pair_rules = rules.association_rules(nested, categories, 0.05, 0.3, 1.0)
    grown = rules.fpgrowth_rules(rules.fit_fpgrowth(nested, 0.05, 0.3), categories, 1.0)
    key = lambda df: {(r.antecedent_id, r.consequent_id, r.support, r.confidence) for r in df.collect()}
    assert key(pair_rules) == key(grown)


def test_support_index_and_metadata(market):
    sets, nested, categories = market
    mined = rules.association_rules(nested, categories).cache()
    meta = rules.rule_metadata(nested, mined).first()
    assert (meta.n_transactions, meta.n_categories) == (len(sets), 90)
    assert meta.total_rules == mined.count()
    support = rules.category_support(nested, categories).collect()
    assert [r.support for r in support] == sorted((r.support for r in support), reverse=True)
    assert all(r["count"] / len(sets) >= fixed.MIN_SUPPORT for r in support)
    index = rules.category_index(mined, 3)
    nested_index = rules.nested_index(index).collect()
    assert max(len(r.recommendations) for r in nested_index) == 3
    for r in nested_index:
        assert [s["rank"] for s in r.recommendations] == list(range(1, len(r.recommendations) + 1))


def test_no_frequent_category_gives_no_rules(market):
    _, nested, categories = market
    assert rules.association_rules(nested, categories, min_support=0.999).count() == 0


def test_sampled_baskets_are_whole(market):
    _, nested, _ = market
    part = rules.sample_baskets(nested, 0.5)
    assert 0 < part.count() < nested.count()
    assert part.exceptAll(nested).count() == 0
    assert rules.sample_baskets(nested, 1.0).count() == nested.count()


# ---- recommendations ----------------------------------------------------------


@pytest.fixture(scope="module")
def lookup(spark):
    index = spark.createDataFrame(
        [
            (1, "A", 3, "C", 0.1, 0.5, 1.2, 1),
            (1, "A", 2, "B", 0.1, 0.5, 1.1, 2),
            (1, "A", 9, "N", 0.1, 0.5, float("nan"), 3),
            (2, "B", 3, "C", 0.1, 0.5, 9.0, 1),
            (2, "B", 4, "D", 0.1, 0.5, 1.2, 2),
        ],
        "antecedent_id INT, antecedent STRING, consequent_id INT, consequent STRING, "
        "support DOUBLE, confidence DOUBLE, lift DOUBLE, rank INT",
    )
    top = spark.createDataFrame(
        [(0, "A", 1), (0, "B", 2), (1, "Z", 1)],
        "segment_id INT, category_name STRING, rank INT",
    )
    return index, top


def test_segment_recommendations_keep_the_first_source(lookup):
    index, top = lookup
    got = recommend.recommend_by_segment(top, index).collect()
    found = [(r.segment_id, r["rank"], r.from_category, r.recommendation, r.lift) for r in got]
    # C is taken from A although B has the higher lift; B itself is a top category;
    # the rule with NaN is dropped; segment 1 has no rules at all.
    assert found == [(0, 1, "A", "C", 1.2), (0, 2, "B", "D", 1.2)]


def test_client_recommendations(spark, lookup):
    index, top = lookup
    segments = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "client_id BIGINT, segment_id INT")
    suggestions = recommend.recommend_by_segment(top, index)
    everyone = recommend.recommend_for_clients(segments, suggestions)
    assert sorted((r.client_id, r.recommendation) for r in everyone.collect()) == [
        (1, "C"), (1, "D"), (2, "C"), (2, "D"),
    ]
    one = recommend.recommend_for_clients(segments, suggestions, client_id=2)
    assert one.count() == 2
    assert recommend.recommend_for_clients(segments, suggestions, client_id=99).count() == 0


def test_category_lookups(lookup):
    index, _ = lookup
    assert [r.consequent for r in recommend.recommend_by_category(index, "A").collect()] == ["C", "B", "N"]
    assert recommend.recommend_by_category(index, "nothing").count() == 0
    assert recommend.recommend_by_category_id(index, 2).count() == 2
    assert [r[0] for r in recommend.categories_with_rules(index).collect()] == ["A", "B"]
    assert [r[0] for r in recommend.search_categories(index, "b").collect()] == ["B"]


# ---- segmentation ---------------------------------------------------------------


@pytest.fixture(scope="module")
def clients(spark):
    rng = np.random.default_rng(2)
    level = np.repeat([3.0, 12.0, 40.0], [300, 150, 50])
    rows = [
        (i, int(v), int(v * 6 + e), 6.0 + e / 10, int(v / 2) + 1, int(v))
        for i, (v, e) in enumerate(zip(level, rng.normal(0, 1, level.size).tolist()))
    ]
    schema = (
        "client_id BIGINT, purchase_frequency BIGINT, total_units BIGINT, avg_basket_size DOUBLE, "
        "category_diversity BIGINT, active_days BIGINT"
    )
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def segmentation(clients):
    return seg.fit_segments(clients)


def test_sweep_and_choice(spark, segmentation):
    sweep = segmentation.elbow(spark).collect()
    assert [r.k for r in sweep] == fixed.K_VALUES
    best = max(sweep, key=lambda r: r.silhouette)
    assert (segmentation.k, round(segmentation.silhouette, 4)) == (best.k, best.silhouette)


def test_segments_are_ordered_by_size(spark, clients, segmentation):
    mapping = segmentation.mapping()
    assert mapping.count() == clients.count() == mapping.select("client_id").distinct().count()
    sizes = [r["count"] for r in mapping.groupBy("segment_id").count().orderBy("segment_id").collect()]
    assert sizes == sorted(sizes, reverse=True)
    summary = seg.segment_summary(clients, mapping).collect()
    assert [r.segment_id for r in summary] == list(range(segmentation.k))
    assert sum(r.size for r in summary) == 500
    assert sum(r.percentage for r in summary) == pytest.approx(100, abs=0.1 * segmentation.k)
    # A converged centre is the mean of its members.
    for center, means in zip(seg.centroids(segmentation, spark).orderBy("segment_id").collect(), summary):
        assert center.total_units == pytest.approx(means.total_units, rel=0.02)
        assert center.label == means.label


def test_segments_do_not_depend_on_partitioning(clients, segmentation):
    again = seg.fit_segments(clients.repartition(11))
    for one, other in zip(again.sweep, segmentation.sweep):
        assert one == pytest.approx(other)
    assert again.mapping().exceptAll(segmentation.mapping()).count() == 0


def test_stats_match_pandas(clients, segmentation):
    mapping = segmentation.mapping()
    pdf = clients.join(mapping, "client_id").toPandas()
    for r in seg.segment_stats(clients, mapping).collect():
        values = pdf[pdf.segment_id == r.segment_id][r.feature]
        want = [values.mean(), values.median(), values.std(), values.min(), values.max()]
        assert [r["mean"], r["median"], r["std"], r["min"], r["max"]] == pytest.approx(want, abs=0.0051)


def test_renumbering_moves_clients_along(spark):
    given = spark.createDataFrame(
        [(1, "x"), (2, "y"), (3, "y"), (4, "z")], "client_id BIGINT, segment_id STRING"
    )
    got = {r.client_id: r.segment_id for r in seg.renumber_segments(given).collect()}
    assert got == {2: 0, 3: 0, 1: 1, 4: 2}


def test_radar_with_an_all_zero_feature(spark):
    summary = spark.createDataFrame(
        [(0, 10.0, 5.0, 0.0, 2.0, 1.0), (1, 5.0, 1.25, 0.0, 1.0, 1.0)],
        "segment_id INT, " + ", ".join(f"{c} DOUBLE" for c in fixed.SEGMENT_FEATURES),
    )
    got = {(r.feature, r.segment_id): r.value for r in seg.radar(summary).collect()}
    assert got["purchase_frequency", 1] == 50 and got["total_units", 1] == 25
    assert got["avg_basket_size", 0] == got["avg_basket_size", 1] == 0


def test_segment_sample(segmentation):
    sample = seg.segment_sample(segmentation.clients, 100).collect()
    assert len(sample) == 100
    assert [r.segment_id for r in sample] == sorted(r.segment_id for r in sample)


def test_top_categories_per_segment(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (3, 6)], "client_id BIGINT, category_id INT")
    categories = spark.createDataFrame([(5, "five")], CATEGORY)
    segments = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "client_id BIGINT, segment_id INT")
    got = seg.segment_top_categories(pairs, categories, segments)
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, "Categoría 6", 1, 2), (0, "five", 2, 1), (1, "Categoría 6", 1, 1),
    ]


def test_short_segment_list_walks_all_rules(spark):
    import __spark_entry__ as entry

    tables, sf_dir = entry.queries(), "/root/testdata/sf0.01"
    rows = lambda df: sorted(map(tuple, df.collect()))
    full = tables["recommend_by_segment"](spark, sf_dir)
    assert rows(tables["recommend_by_segment_short"](spark, sf_dir)) == rows(full.where("rank <= 5"))
