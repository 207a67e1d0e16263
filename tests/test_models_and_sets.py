"""k-means in shared scans, silhouettes, itemsets, KPI bit maps and sketches against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from canasta import fixed
from canasta.operators import bitmaps, itemsets, kmeans, kpis, segmentation as seg, sketches
from canasta.operators.grain import baskets, transactions, unnest
from canasta.session import materialize
from canasta.sources import star

SF = "/root/testdata/sf0.001"
SCHEMA = "client_id long, " + ", ".join(f"{c} double" for c in fixed.SEGMENT_FEATURES)


@pytest.fixture(scope="module")
def clients(spark):
    rng = np.random.default_rng(4)
    groups = [(40, (2, 9, 3, 2, 2)), (90, (8, 40, 5, 9, 7)), (25, (30, 300, 10, 30, 25))]
    rows = [tuple(map(float, rng.normal(mean, 1.0 + 0.2 * np.array(mean)))) for n, mean in groups for _ in range(n)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).cache()


def matrix(df):
    x = np.array([r[1:6] for r in df.orderBy("client_id").collect()], float)
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def distances(x, squared):
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return far if squared else np.sqrt(far)


def silhouette(x, label, squared):
    far, out = distances(x, squared), []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][label == other].mean() for other in set(label) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


@pytest.fixture(scope="module")
def fitted(clients):
    return seg.fit_segments(clients)


def test_model_is_a_fixed_point_and_its_scores_are_right(clients, fitted):
    x = matrix(clients)
    label = np.array([r.segment_id for r in fitted.clients.orderBy("client_id").collect()])
    centers = np.array(fitted.scaled_centers)
    assert (((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1) == label).all()
    means = np.stack([x[label == i].mean(axis=0) for i in range(fitted.k)])
    assert np.abs(means - centers).max() < 1e-5
    assert fitted.silhouette == pytest.approx(silhouette(x, label, True).mean(), abs=1e-5)
    inertia = {k: cost for k, cost, _ in fitted.sweep}[fitted.k]
    n = len(x)
    assert inertia == pytest.approx(((x - centers[label]) ** 2).sum() * n / (n - 1), rel=1e-5)


def test_silhouette_equals_that_of_mllib(clients, fitted):
    vectors, _, _ = seg.scaled_vectors(clients)
    told = vectors.join(fitted.mapping(), "client_id").withColumn("segment_id", F.col("segment_id").cast("double"))
    score = ClusteringEvaluator(featuresCol="scaled", predictionCol="segment_id").evaluate(told)
    assert fitted.silhouette == pytest.approx(score, abs=1e-5)


def test_one_scan_for_all_models(spark, clients):
    """A round over many models runs as many Spark jobs as one over a single model."""
    x = matrix(clients)
    points = kmeans.to_points(clients, fixed.SEGMENT_FEATURES, [0.0] * 5, [1.0] * 5).cache()
    points.count()
    rng = np.random.default_rng(1)
    models = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 4, 5, 6) for _ in range(8)]

    def jobs(action):
        tracker, group = spark.sparkContext.statusTracker(), f"g{rng.integers(1 << 30)}"
        spark.sparkContext.setJobGroup(group, "")
        action()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(lambda: kmeans.scan(points, models)) == jobs(lambda: kmeans.scan(points, models[:1]))


def test_scan_equals_numpy(clients):
    points = kmeans.to_points(clients, fixed.SEGMENT_FEATURES, [0.0] * 5, [1.0] * 5)
    x = np.array([r[1:6] for r in clients.orderBy("client_id").collect()], float)
    models = [x[:3], x[5:7], x[[1, 1, 2]]]
    for m, found in zip(models, kmeans.scan(points.repartition(5), models), strict=True):
        far = ((x[:, None] - m) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        assert found.n.tolist() == np.bincount(near, minlength=len(m)).tolist()
        assert found.cost == pytest.approx(far.min(axis=1).sum(), rel=1e-4)
        assert found.means()[0] == pytest.approx(x[near == 0].mean(axis=0), abs=1e-5)


def test_hot_and_constant_clients(spark):
    rows = [(i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(300)] + [(300 + i, float(i), 9.0, 1.0, 2.0, 3.0) for i in range(5)]
    fitted = seg.fit_segments(spark.createDataFrame(rows, SCHEMA))
    assert fitted.clients.count() == 305
    assert [k for k, _, _ in fitted.sweep] == fixed.K_VALUES


@pytest.mark.parametrize("within", [False, True])
def test_euclidean_silhouettes(spark, clients, fitted, within):
    x, label = matrix(clients), np.array([r.segment_id for r in fitted.clients.orderBy("client_id").collect()])
    want = silhouette(x, label, False)
    got = {r.client_id: r.silhouette for r in seg.silhouettes(clients, fitted.mapping(), within_sample=within).collect()}
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-6)
    few = {r.client_id: r.silhouette for r in seg.silhouettes(clients, fitted.mapping(), n=20).collect()}
    assert len(few) == 20 and few == pytest.approx({i: want[i] for i in few}, abs=1e-6)


def test_silhouettes_of_a_lone_client_and_named_segments(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0), (2, 9.0, 0.0, 0.0, 0.0, 0.0)]
    segments = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "client_id long, segment_id string")
    got = {r.client_id: r.silhouette for r in seg.silhouettes(spark.createDataFrame(rows, SCHEMA), segments).collect()}
    assert got == pytest.approx({0: 1 - 1 / 9, 1: 1 - 1 / 8, 2: 0.0})
    many = spark.range(70).select(F.col("id").alias("client_id"), F.col("id").alias("segment_id"))
    wide = many.select("client_id", *[F.col("client_id").cast("double").alias(c) for c in fixed.SEGMENT_FEATURES])
    with pytest.raises(ValueError, match="segments"):
        seg.silhouettes(wide, many)


# ---- itemsets ---------------------------------------------------------------


def test_itemsets_and_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "BLOCK", 7)  # several scans of a level
    rng = random.Random(3)
    rows = [(t, sorted({rng.choice([1, 2, 3, 5, 8, -4, 70_000]) for _ in range(rng.randint(1, 6))})) for t in range(300)]
    table = spark.createDataFrame(rows, "transaction_id long, ids array<int>").select(
        "transaction_id", F.transform("ids", lambda i: F.struct(i.alias("category_id"), F.lit(1).alias("quantity"))).alias("items")
    )
    sets = [set(r[1]) for r in rows]
    stock = sorted(set().union(*sets))
    want = {}
    for size in range(1, 5):
        for c in combinations(stock, size):
            n = sum(set(c) <= s for s in sets)
            if n / 300 >= 0.02:
                want[c] = n
    found = itemsets.frequent_itemsets(table, 0.02, 4)
    got = {tuple(r["items"]): r["count"] for r in found.collect()}
    assert got == want and max(map(len, want)) == 4

    rules = {
        (c[:i] + c[i + 1 :], c[i]): (want[c] / 300, want[c] / want[c[:i] + c[i + 1 :]])
        for c in want if len(c) > 1 for i in range(len(c))
    }
    kept = {k: v for k, v in rules.items() if v[1] >= 0.5 and v[1] / (want[(k[1],)] / 300) >= 1.0}
    told = {(tuple(r.antecedent_ids), r.consequent_id): (r.support, r.confidence) for r in itemsets.itemset_rules(found, 0.5, 1.0).collect()}
    assert told.keys() == kept.keys()
    assert all(told[k] == pytest.approx(kept[k], abs=6e-5) for k in kept)


def test_itemsets_equal_those_of_fpgrowth(spark):
    table = materialize(baskets(star.lines(spark, SF)).select("transaction_id", "items"), "items")
    got = {tuple(r["items"]): r["count"] for r in itemsets.frequent_itemsets(table, 0.004, 3).collect()}
    model = FPGrowth(minSupport=0.004).fit(table.select(F.col("items.category_id").alias("items")))
    want = {tuple(sorted(r["items"])): r["freq"] for r in model.freqItemsets.where("size(items) <= 3").collect()}
    assert got == want and any(len(k) == 3 for k in want)


def test_no_itemsets(spark):
    none = baskets(star.lines(spark, SF)).limit(0)
    assert itemsets.frequent_itemsets(none).count() == 0


# ---- KPI bit maps and sketches ----------------------------------------------


def test_bit_maps_equal_exact_kpis(spark):
    table = materialize(baskets(star.lines(spark, SF)), "baskets")
    halves = [bitmaps.store_months(table.where(F.col("transaction_id") % 2 == i)) for i in (0, 1)]
    merged = materialize(bitmaps.merged(halves[0].union(halves[1])), "maps")
    whole = kpis.kpis(unnest(table), table.drop("items"))
    assert bitmaps.kpis(merged).collect() == whole.select(bitmaps.kpis(merged).columns).collect()
    part = table.where((F.col("store_id") == 2) & F.col("date").between("1994-02-01", "1994-06-30"))
    want = kpis.kpis(unnest(part), part.drop("items")).first().asDict()
    assert bitmaps.kpis(merged, "1994-02", "1994-06", [2]).first().asDict() == want


def test_bit_maps_of_wide_and_negative_ids(spark):
    ids = [-(1 << 40), -32768, -1, 0, 1, 32768, 32769, 1 << 50]
    rows = spark.createDataFrame([(i, 1, "2024-01-05", 1) for i in ids + ids], "client_id long, store_id int, day string, basket_size long")
    rows = rows.select("*", F.to_date("day").alias("date"), F.expr("array(named_struct('category_id', 3, 'quantity', 1L))").alias("items"))
    row = bitmaps.kpis(bitmaps.store_months(rows)).first()
    assert (row.total_clients, row.total_categories, row.total_transactions, row.total_stores) == (8, 1, 16, 1)
    none = bitmaps.kpis(bitmaps.store_months(rows.limit(0))).first()
    assert (none.total_clients, none.total_units, none.total_transactions) == (0, None, 0)


def test_sketched_box_plots(spark):
    """Ranks of sketched quantiles are within the stated error; the other numbers are exact."""
    rows = spark.range(60_000).select(
        (F.col("id") % 4).cast("int").alias("store_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 360).cast("int")).alias("date"),
        (1 + F.pmod(F.xxhash64("id"), F.lit(97)) * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(13))).alias("basket_size"),
    )
    stored = materialize(sketches.basket_size_sketches(rows), "sketches")
    for where in ("true", "store_id = 2", "month BETWEEN '2023-03' AND '2023-05'"):
        own = rows.withColumn("month", F.date_format("date", "yyyy-MM")).where(where)
        values = np.sort([r[0] for r in own.select("basket_size").collect()])
        got = sketches.sketched_stats(stored.where(where)).first()
        assert (got["min"], got["max"], got["count"]) == (values[0], values[-1], len(values))
        assert (got["mean"], got["std"]) == pytest.approx((values.mean(), values.std(ddof=1)))
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            low = np.searchsorted(values, got[name], "left") / len(values)
            high = np.searchsorted(values, got[name], "right") / len(values)
            assert low - 2 * sketches.RANK_ERROR <= q <= high + 2 * sketches.RANK_ERROR


def test_client_sketches(spark):
    txns = transactions(star.lines(spark, SF))
    about = bitmaps.sketched_clients(bitmaps.client_sketches(txns), "1994-01", "1995-12").first()[0]
    exact = txns.where(F.year("date").between(1994, 1995)).select("client_id").distinct().count()
    assert about == pytest.approx(exact, rel=0.03)


def test_features_of_baskets_equal_those_of_transactions(spark):
    from canasta.operators.features import client_features, features_of_baskets
    from canasta.operators.grain import client_items

    lines = star.lines(spark, SF)
    want = client_features(transactions(lines), client_items(lines))
    got = features_of_baskets(baskets(lines))
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    odd = spark.sql(
        "SELECT 1L transaction_id, 5L client_id, CAST(NULL AS INT) store_id, CAST(NULL AS DATE) date, 2L basket_size, "
        "1L num_categories, array(named_struct('category_id', 3, 'quantity', 2L)) items"
    )
    row = features_of_baskets(odd).first()
    assert (row.num_stores_visited, row.active_days, row.category_diversity, row.total_units) == (0, 0, 1, 2)
