"""Distribution helpers against brute force, including hot values and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions.columns import lift_band, sanitize_floats, segment_label
from canasta.functions.distribution import describe_counts, exact_quantiles
from canasta.functions.ranking import top_k, top_k_per_group
from canasta.operators import distributions, features, kpis
from canasta.operators.grain import baskets, client_items, transactions, unnest


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
@pytest.mark.parametrize("probability", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, accuracy, probability):
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(4000) < 0.34, 1.5, rng.normal(size=4000))
    groups = np.where(rng.random(4000) < 0.8, "big", "small")
    pdf = pd.DataFrame({"g": groups, "v": hot, "w": rng.integers(0, 9, 4000)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["one"], "v": [2.5], "w": [3]})])
    df = spark.createDataFrame(pdf).repartition(5)
    for few in (True, False):
        got = exact_quantiles(df, ["g"], ["v", "w"], probability, accuracy, few_groups=few)
        result = {(r.g, r.feature): (r.n, r.quantile) for r in got.collect()}
        for (group, part) in pdf.groupby("g"):
            for column in ("v", "w"):
                n, quantile = result[(group, column)]
                assert n == len(part)
                assert quantile == pytest.approx(part[column].quantile(probability), abs=1e-12)


def test_describe_counts(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(list("aab"), 3000), "v": rng.poisson(6, 3000)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["c"], "v": [4]})])
    for row in describe_counts(spark.createDataFrame(pdf), "v", ["k"]).collect():
        want = pdf[pdf.k == row.k].v.describe()
        assert [row["min"], row["q1"], row["median"], row["q3"], row["max"], row["mean"]] == (
            pytest.approx(want[["min", "25%", "50%", "75%", "max", "mean"]].tolist())
        )
        assert row["count"] == want["count"]
        assert row["std"] is None if row.k == "c" else row["std"] == pytest.approx(want["std"])


def test_hot_client_store_and_transaction_are_counted_whole(spark):
    """A third of the rows on one client, one store and one transaction."""
    rng = np.random.default_rng(11)
    n = 6000
    txn = rng.integers(1, 900, n)
    txn[: n // 3] = 0
    pdf = pd.DataFrame({"transaction_id": txn, "category_id": rng.integers(1, 15, n)})
    pdf["client_id"] = pdf.transaction_id % 70
    pdf["store_id"] = (pdf.transaction_id % 3).astype("int32")
    pdf["date"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.transaction_id % 40, "D")
    pdf["date"] = pdf.date.dt.date
    pdf["quantity"] = 1
    lines = spark.createDataFrame(pdf).withColumn("category_id", F.col("category_id").cast("int"))
    txns = transactions(lines)

    want = pdf.groupby("store_id").agg(
        u=("quantity", "sum"), t=("transaction_id", "nunique"), c=("client_id", "nunique")
    )
    got = {r.store_id: tuple(r)[1:] for r in kpis.sales_by_store(txns).collect()}
    assert got == {s: tuple(r) for s, r in zip(want.index, want.values.tolist())}

    nested = baskets(lines)
    assert unnest(nested).agg(F.sum("quantity")).first()[0] == n
    flat = nested.select(*txns.columns)
    assert flat.exceptAll(txns).count() == 0 and flat.count() == pdf.transaction_id.nunique()

    table = features.client_features(txns, client_items(lines)).toPandas()
    table = table.set_index("client_id").sort_index()
    by_client = pdf.groupby("client_id")
    assert (table.total_units == by_client.quantity.sum()).all()
    assert (table.purchase_frequency == by_client.transaction_id.nunique()).all()
    assert (table.category_diversity == by_client.category_id.nunique()).all()
    assert (table.active_days == by_client.date.nunique()).all()
    mean = by_client.quantity.sum() / by_client.transaction_id.nunique()
    assert np.allclose(table.avg_basket_size, mean)
    fence = distributions.outlier_clients(txns).collect()
    assert fence[0].client_id == 0


def test_category_units_when_names_collide(spark):
    categories = spark.createDataFrame(
        [(1, "A"), (2, "A"), (3, "Categoría 9")], "category_id INT, category_name STRING"
    )
    lines = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 3), (1, 9), (2, 1)], "transaction_id BIGINT, category_id INT"
    ).selectExpr(
        "*", "1L AS client_id", "1 AS store_id", "DATE'2024-01-01' AS date", "1L AS quantity"
    )
    want = {("A", 1, 2), ("Categoría 9", 1, 2), ("A", 2, 1)}
    general = distributions.category_units(lines, categories)
    nested = distributions.category_units_of_baskets(baskets(lines), categories)
    assert {tuple(r) for r in general.collect()} == want
    assert {tuple(r) for r in nested.select(*general.columns).collect()} == want


def test_correlation_and_zscore_of_a_constant_column(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5, 2.0), (2, 2.0, 5, 1.0), (3, 3.0, 5, 0.0)],
        "client_id BIGINT, a DOUBLE, b INT, c DOUBLE",
    )
    r = {(x.feature_x, x.feature_y): x.r for x in features.correlation_matrix(df, "abc").collect()}
    assert len(r) == 9
    assert r["a", "c"] == r["c", "a"] == -1.0 and r["a", "a"] == 1.0
    assert r["a", "b"] is None and r["b", "b"] is None
    scores = features.zscores(df, ["a", "b"]).orderBy("client_id").collect()
    assert [x.b for x in scores] == [0.0, 0.0, 0.0]
    assert scores[0].a == pytest.approx(-(1.5**0.5))


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "client_id")
    first = {r.client_id for r in features.client_sample(df).collect()}
    assert len(first) == fixed.FEATURE_SAMPLE
    assert first == {r.client_id for r in features.client_sample(df.repartition(9)).collect()}
    assert features.client_sample(df, 5000).count() == 2000


@pytest.mark.parametrize(
    "frequency, units, diversity, label",
    [
        (4, 25, 1, fixed.SPORADIC),
        (4, 25.5, 1, fixed.OCCASIONAL),
        (5, 25, 1, fixed.OCCASIONAL),
        (10, 80, 50, fixed.OCCASIONAL),
        (10.5, 80, 39, fixed.REGULAR),
        (11, 200, 40, fixed.DIVERSIFIED),
        (11, 199, 40, fixed.REGULAR),
        (11, 500, 40, fixed.DIVERSIFIED),
        (11, 300, 39, fixed.VIP),
        (11, 299, 39, fixed.REGULAR),
    ],
)
def test_segment_label_boundaries(spark, frequency, units, diversity, label):
    row = spark.range(1).select(
        segment_label(F.lit(float(frequency)), F.lit(float(units)), F.lit(float(diversity)))
    )
    assert row.first()[0] == label


def test_lift_bands(spark):
    df = spark.createDataFrame([(3.0,), (2.99,), (2.0,), (1.5,), (1.49,)], "lift DOUBLE")
    bands = [r[0] for r in df.select(lift_band(F.col("lift"))).collect()]
    assert bands == [">=3", ">=2", ">=2", ">=1.5", "<1.5"]


def test_sanitize_reaches_nested_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, nan, [1.0, inf], (nan, "x")), (2, 2.0, None, None)],
        "id INT, a DOUBLE, b ARRAY<DOUBLE>, c STRUCT<v: DOUBLE, s: STRING>",
    )
    first, second = sanitize_floats(df).orderBy("id").collect()
    assert (first.a, first.b, first.c.v, first.c.s) == (None, [1.0, None], None, "x")
    assert (second.a, second.b, second.c) == (2.0, None, None)


def test_top_k_breaks_ties_by_the_given_order(spark):
    df = spark.createDataFrame([(g, i, i % 2) for g in "ab" for i in range(6)], "g STRING, i INT, v INT")
    best = top_k(df, [F.desc("v"), F.asc("i"), F.asc("g")], 3).collect()
    assert [(r.g, r.i, r["rank"]) for r in best] == [("a", 1, 1), ("b", 1, 2), ("a", 3, 3)]
    per_group = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("i")], 2).collect()
    assert sorted((r.g, r.i, r["rank"]) for r in per_group) == [
        ("a", 1, 1), ("a", 3, 2), ("b", 1, 1), ("b", 3, 2),
    ]
