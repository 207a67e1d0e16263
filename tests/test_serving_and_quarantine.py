"""SQL table functions over stored marts, and what a load sets aside."""

import pytest

from canasta.operators import recommend, rules
from canasta.plans import serving
from canasta.sources import marts, text

RULES = (
    "antecedent_id INT, antecedent STRING, consequent_id INT, consequent STRING, support DOUBLE, confidence DOUBLE, lift DOUBLE"
)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    found = spark.createDataFrame(
        [(1, "Pan", 2, "Queso", 0.1, 0.5, 1.5), (1, "Pan", 3, "Leche", 0.1, 0.5, 2.5), (2, "Queso", 4, "Vino", 0.2, 0.4, 3.0)], RULES
    )
    top = spark.createDataFrame([(0, "Pan", 9, 1), (0, "Queso", 8, 2), (1, "Vino", 5, 1)], "segment_id INT, category_name STRING, num_clients BIGINT, rank INT")
    mapping = spark.createDataFrame([(10, 0), (11, 1), (12, 0)], "client_id BIGINT, segment_id INT")
    marts.write_marts({"rules": found}, f"{out}/recommendations")
    marts.write_marts({"top_categories": top, "mapping": mapping}, f"{out}/client_segments")
    serving.register(spark, out)
    return found, top, mapping


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_functions_equal_the_lookups(spark, stored):
    found, top, mapping = stored
    index = rules.category_index(found, None)
    assert rows(spark.sql("SELECT * FROM recommend_by_category('Pan')")) == rows(recommend.recommend_by_category(index, "Pan"))
    assert rows(spark.sql("SELECT * FROM recommend_by_category_id(2)")) == rows(recommend.recommend_by_category_id(index, 2))
    segments = recommend.recommend_by_segment(top, index)
    want = rows(segments.where("segment_id = 0").drop("segment_id"))
    assert want and rows(spark.sql("SELECT * FROM recommend_by_segment(0)")) == want
    one = recommend.recommend_for_clients(mapping, segments, 12).drop("client_id")
    assert rows(spark.sql("SELECT * FROM recommend_for_client(12)")) == rows(one)
    assert [r[0] for r in spark.sql("SELECT * FROM search_categories('QU')").collect()] == ["Queso"]


def test_functions_take_columns_and_unknown_values(spark, stored):
    assert spark.sql("SELECT * FROM recommend_by_category('no such')").count() == 0
    assert spark.sql("SELECT * FROM recommend_for_client(99)").count() == 0
    joined = spark.sql("SELECT n, r.consequent FROM VALUES ('Pan'), ('Queso') AS t(n), LATERAL recommend_by_category(n) r")
    assert rows(joined) == [("Pan", "Leche"), ("Pan", "Queso"), ("Queso", "Vino")]


def test_no_marts_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="refresh"):
        serving.register(spark, str(tmp_path))


LINES = [
    "2024-01-01|102|7|1 2 2",
    "2024-13-01|102|7|1",
    "2024-01-01|x|7|1 y 2.5 z",
    "2024-01-01|102",
    "2024-01-01|102|8|3|more",
    "2024-01-01|102|9|",
    "||| ",
]


def test_quarantine_holds_every_fault(spark, tmp_path):
    (tmp_path / "102_Tran.csv").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    (tmp_path / "103_Tran.csv").write_text("2024-01-05|103|1|4 5\n", encoding="utf-8")
    checked = text.read_checked_transactions(spark, str(tmp_path))
    found = sorted((r.reason, r.value or "") for r in text.quarantine(checked).collect())
    assert found == sorted(
        [
            ("date", "2024-13-01"), ("store_id", "x"), ("item", "y"), ("item", "z"),
            ("fields", LINES[3]), ("client_id", ""), ("fields", LINES[4]),
            ("date", ""), ("store_id", ""), ("client_id", ""),
        ]
    )
    report = {r.file_name: r.asDict() for r in text.load_report(checked).collect()}
    assert report["103_Tran.csv"] == {
        "file_name": "103_Tran.csv", "num_rows": 1, "faulty_rows": 0, "empty_baskets": 0,
        "bad_fields": 0, "bad_date": 0, "bad_store_id": 0, "bad_client_id": 0, "bad_item": 0,
    }
    first = report["102_Tran.csv"]
    assert (first["num_rows"], first["faulty_rows"], first["empty_baskets"]) == (7, 5, 3)
    assert (first["bad_fields"], first["bad_date"], first["bad_store_id"], first["bad_client_id"], first["bad_item"]) == (2, 2, 2, 2, 2)
