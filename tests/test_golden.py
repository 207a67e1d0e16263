"""The six-line text fixture with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from canasta.operators import distributions, features, kpis, rules, timeseries
from canasta.operators.grain import baskets, client_items, transactions, unnest
from canasta.sources import text

FILES = {
    "102_Tran.csv": "2013-01-01|102|1|1 2 3\n2013-01-01|102|2|1 2\n2013-01-07|102|1|1 1 99\n",
    "103_Tran.csv": "2013-01-08|103|2|2  3\n2013-02-01|103|3|\n2013-02-02|103|3|3 x\n",
    "notes.txt": "ignored",
}
CATEGORIES = "1|GRUPO FRUVER-EXCEPCIONES\n2|CONCESIONARIOS\n3|VERDURAS DE FRUTOS\n"


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    (base / "Transactions").mkdir()
    (base / "Products").mkdir()
    for name, content in FILES.items():
        (base / "Transactions" / name).write_text(content, encoding="utf-8")
    (base / "Products" / "Categories.csv").write_text(CATEGORIES, encoding="utf-8")
    (base / "Products" / "ProductCategory.csv").write_text(
        "v.Code_pr|v.code\n10|1\n11|x\n12|\n13|3.0\n", encoding="utf-8"
    )
    return str(base)


@pytest.fixture(scope="module")
def fact(spark, data_dir):
    lines, categories = text.load_all(spark, data_dir)
    return lines.cache(), categories, transactions(lines).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fact(fact):
    lines, _, _ = fact
    assert lines.count() == 11
    assert {r.category_name for r in lines.filter("category_id = 99").collect()} == {"Categoría 99"}
    assert dict(lines.dtypes) == {
        "transaction_id": "bigint",
        "date": "date",
        "store_id": "int",
        "client_id": "bigint",
        "category_id": "int",
        "quantity": "bigint",
        "category_name": "string",
    }


def test_rows_per_file_and_missing_files(spark, data_dir, tmp_path):
    raw = text.read_raw_transactions(spark, f"{data_dir}/Transactions")
    assert sorted(rows(text.rows_per_file(raw))) == [("102_Tran.csv", 3), ("103_Tran.csv", 3)]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        text.read_transactions(spark, str(tmp_path))


def test_dimensions(spark, data_dir):
    categories = text.read_categories(spark, f"{data_dir}/Products/Categories.csv")
    assert rows(text.category_catalogue(categories))[1] == (2, "CONCESIONARIOS")
    bridge = text.read_product_categories(spark, f"{data_dir}/Products/ProductCategory.csv")
    assert sorted(rows(bridge)) == [(10, 1), (13, 3)]


def test_kpis(fact):
    lines, _, txns = fact
    assert rows(kpis.kpis(lines, txns)) == [
        (11, 5, 3, 4, 2, dt.date(2013, 1, 1), dt.date(2013, 2, 2))
    ]


def test_categories(fact):
    lines, categories, _ = fact
    volume = rows(kpis.categories_by_volume(lines, categories))
    assert [(r[0], r[2], r[3]) for r in volume] == [
        (1, 4, 36.36),
        (2, 3, 27.27),
        (3, 3, 27.27),
        (99, 1, 9.09),
    ]
    top = rows(kpis.top_categories(lines, categories, 2))
    assert [(r[0], r[3]) for r in top] == [(1, 1), (2, 2)]
    pie = rows(kpis.categories_with_remainder(lines, categories, 2))
    assert [r[1:] for r in pie][-1] == ("Otros", 4)


def test_rankings(fact):
    _, _, txns = fact
    assert rows(kpis.sales_by_store(txns)) == [(102, 8, 3, 2), (103, 3, 2, 2)]
    assert rows(kpis.top_clients(txns)) == [(1, 2, 6, 1), (2, 2, 4, 2), (3, 1, 1, 3)]
    assert rows(kpis.peak_days(txns, 1)) == [(dt.date(2013, 1, 1), 2, 5, "Tuesday", 1)]


def test_calendar(fact):
    _, _, txns = fact
    assert rows(timeseries.weekly(txns)) == [
        (dt.date(2012, 12, 31), 2, 5),
        (dt.date(2013, 1, 7), 2, 5),
        (dt.date(2013, 1, 28), 1, 1),
    ]
    assert rows(timeseries.monthly(txns)) == [("2013-01", 4, 10), ("2013-02", 1, 1)]
    heat = rows(kpis.weekly_heatmap(txns))
    assert heat == [
        ("2013-01", 0, "Lunes", 1),
        ("2013-02", 0, "Lunes", 0),
        ("2013-01", 1, "Martes", 3),
        ("2013-02", 1, "Martes", 0),
        ("2013-01", 5, "Sábado", 0),
        ("2013-02", 5, "Sábado", 1),
    ]
    assert [r[-1] for r in rows(kpis.heatmap_intensity(txns))][2] == 1.0
    wide = timeseries.store_columns(txns)
    assert wide.columns == ["date", "102", "103"]
    assert wide.count() == 4


def test_distributions(fact):
    _, _, txns = fact
    stats = distributions.basket_size_stats(txns).first()
    assert (stats.min, stats.q1, stats.median, stats.q3, stats.max) == (1, 2, 2, 3, 3)
    assert stats["count"] == 5
    assert (round(stats["mean"], 5), round(stats["std"], 5)) == (2.2, 0.83666)
    totals = distributions.client_total_stats(txns).first()
    assert (totals.q1, totals.q3) == (2.5, 5.0)
    assert rows(distributions.outlier_clients(txns)) == []
    assert rows(distributions.basket_size_histogram(txns)) == [(1, 1), (2, 2), (3, 2)]


def test_single_transaction_category_has_no_std(fact):
    lines, categories, _ = fact
    units = distributions.category_units(lines.drop("category_name"), categories)
    stats = {r.category_name: r for r in distributions.category_basket_stats(units).collect()}
    assert stats["Categoría 99"]["std"] is None
    assert stats["GRUPO FRUVER-EXCEPCIONES"]["max"] == 2


def test_features(fact):
    lines, _, txns = fact
    table = sorted(rows(features.client_features(txns, client_items(lines))))
    assert table == [
        (1, 2, 6, 3.0, 2.5, 4, 1, 2),
        (2, 2, 4, 2.0, 2.0, 3, 2, 2),
        (3, 1, 1, 1.0, 1.0, 1, 1, 1),
    ]


def test_rules(fact):
    lines, categories, _ = fact
    found = rules.ordered_rules(rules.association_rules(baskets(lines), categories))
    got = [(r[0], r[2], r[4], r[5], r[6]) for r in rows(found)]
    assert got == [
        (99, 1, 0.2, 1.0, 1.6667),
        (1, 99, 0.2, 0.3333, 1.6667),
        (1, 2, 0.4, 0.6667, 1.1111),
        (2, 1, 0.4, 0.6667, 1.1111),
        (2, 3, 0.4, 0.6667, 1.1111),
        (3, 2, 0.4, 0.6667, 1.1111),
    ]
    unfiltered = rules.association_rules(baskets(lines), categories, min_lift=0.0)
    assert {(r[0], r[2]) for r in rows(unfiltered)} - {(r[0], r[1]) for r in got} == {(1, 3), (3, 1)}


def test_lenient_load_keeps_going(spark, tmp_path):
    (tmp_path / "1_Tran.csv").write_text("bad|1|1|5\n2013-01-01|x|1|6 \t7\n2013-01-01|1|1\n")
    lines = text.read_transactions(spark, str(tmp_path), strict=False)
    assert sorted((str(r.date), r.store_id, r.category_id) for r in lines.collect()) == [
        ("2013-01-01", None, 6),
        ("2013-01-01", None, 7),
        ("None", 1, 5),
    ]
    with pytest.raises(Exception):
        text.read_transactions(spark, str(tmp_path)).collect()


def test_ids_are_stable_and_copies_stay_apart(spark, data_dir):
    raw = text.read_raw_transactions(spark, f"{data_dir}/Transactions")
    hot = raw.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(250_001)))).drop("n")
    raw = raw.unionByName(hot)
    once = text.number_rows(raw)
    again = text.number_rows(raw.repartition(7))
    assert once.select("transaction_id").distinct().count() == raw.count()
    assert once.exceptAll(again).count() == 0
    other = text.number_rows(raw, batch=3)
    assert once.select("transaction_id").intersect(other.select("transaction_id")).count() == 0


def test_baskets_from_text_equal_baskets_from_fact(spark, data_dir, fact):
    direct = text.read_baskets(spark, f"{data_dir}/Transactions")
    grouped = baskets(fact[0])
    assert dict(direct.dtypes) == dict(grouped.dtypes)
    assert sorted(rows(direct)) == sorted(rows(grouped.select(*direct.columns)))
    assert unnest(direct).agg(F.sum("quantity")).first()[0] == 11


def test_command_line_refresh(spark, data_dir, tmp_path):
    from canasta.__main__ import main
    from canasta.sources.marts import read_mart

    # Six more baskets of six more clients.
    extra = tmp_path / "data"
    (extra / "Transactions").mkdir(parents=True)
    (extra / "Products").mkdir()
    lines = [f"2013-03-0{i}|107|{i + 10}|{'1 ' * i}2" for i in range(1, 7)]
    content = "".join(v for k, v in FILES.items() if k.endswith("_Tran.csv"))
    (extra / "Transactions" / "1_Tran.csv").write_text(content + "\n".join(lines) + "\n")
    (extra / "Products" / "Categories.csv").write_text(CATEGORIES, encoding="utf-8")
    out = str(tmp_path / "out")
    main([str(extra), out, "--format", "json", "--n-init", "1"])
    totals = read_mart(spark, out, "executive_summary/kpis", "json").first()
    assert (totals.total_units, totals.total_transactions, totals.total_clients) == (38, 11, 9)
    segments = read_mart(spark, out, "clustering/segments", "json")
    assert segments.agg(F.sum("size")).first()[0] == 9
    assert set(read_mart(spark, out, "client_segments/labels", "json").columns) == {
        "segment_id",
        "label",
    }


def test_command_line_refresh_of_three_clients(spark, data_dir, tmp_path):
    from canasta.__main__ import main
    from canasta.session import SCRATCH, use_scratch
    from canasta.sources.marts import read_mart

    out, scratch = str(tmp_path / "out"), tmp_path / "scratch"
    main([data_dir, out, "--n-init", "1", "--scratch", str(scratch)])
    use_scratch(spark, None)
    assert spark.conf.get(SCRATCH, None) is None and not list(scratch.iterdir())
    assert read_mart(spark, out, "executive_summary/kpis").first().total_clients == 3
    assert read_mart(spark, out, "clustering/summary").first().total_clients == 3
    assert read_mart(spark, out, "client_segments/mapping").count() == 3
    assert read_mart(spark, out, "recommendations/rules").count() == 6
