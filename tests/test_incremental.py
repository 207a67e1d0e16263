"""Mergeable state: old plus new equals all, repeats and failures change nothing, old baskets are not read."""

import pytest
from pyspark.sql import functions as F

from canasta.__main__ import main
from canasta.operators.grain import baskets, client_items, unnest
from canasta.plans import incremental, marts as documents
from canasta.session import materialize
from canasta.sources import marts, star, text
from canasta.streaming import ingest, state

SF = "/root/testdata/sf0.001"
LIMITS = (0.02, 0.14, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    return materialize(baskets(star.lines(spark, SF)), "all-baskets")


@pytest.fixture(scope="module")
def categories(spark):
    return materialize(star.categories(spark, SF), "all-categories")


def part(table, i, of=3):
    return table.where(F.pmod(F.xxhash64("transaction_id"), F.lit(of)) == i)


def same(one, other):
    return sorted(one.columns) == sorted(other.columns) and not (
        one.select(other.columns).exceptAll(other).count() or other.exceptAll(one.select(other.columns)).count()
    )


@pytest.fixture(scope="module")
def merged(spark, table, categories, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state"))
    for batch in (0, 1, 1):
        state.add_batch(part(table, batch), categories, path, batch)
    state.compact(spark, path)
    assert state.snapshot(spark, path) == 1 and state.committed(spark, path) == []
    for batch in (0, 1, 2, 2):  # those in the snapshot are left alone
        state.add_batch(part(table, batch), categories, path, batch)
    assert state.committed(spark, path) == [2]
    return path


@pytest.mark.parametrize("name", list(state.TABLES))
def test_merged_tables_equal_those_of_all_baskets(spark, table, categories, merged, name):
    one = state.TABLES[name]
    assert same(state.read_state(spark, merged, name), one.merged(one.rows(table, categories)))


def test_documents_equal_those_of_all_baskets(spark, table, categories, merged):
    states = state.read_states(spark, merged)
    txns, lines = table.drop("items"), unnest(table)
    units = documents.distributions.category_units_of_baskets(table, categories)
    pairs = [
        (incremental.executive_summary(states, categories), documents.executive_summary(lines, categories, txns)),
        (incremental.time_series(states), documents.time_series(txns)),
        (incremental.boxplot_data(states), documents.boxplot_data(units, txns)),
        (incremental.recommendations(states, categories, *LIMITS), documents.recommendations(table, categories, *LIMITS)),
    ]
    for got, want in pairs:
        assert list(got) == list(want)
        for name in want:
            assert same(got[name], want[name]), name
    features = documents.feats.client_features(txns, client_items(lines))
    assert same(incremental.client_features(states), features)
    assert same(incremental.client_categories(states), client_items(lines))


def test_no_old_basket_is_read(spark, table, categories, tmp_path):
    """All files that the marts scan are the state's."""
    path = str(tmp_path / "state")
    state.add_batch(part(table, 0), categories, path, 0)
    state.compact(spark, path)
    state.add_batch(part(table, 1), categories, path, 1)
    states = state.read_states(spark, path)
    frames = [*states.values(), incremental.client_features(states), incremental.client_categories(states)]
    frames += list(incremental.executive_summary(states, categories).values())
    known = set(categories.inputFiles())
    for frame in frames:
        files = set(frame.inputFiles()) - known
        assert files and all(f"{path}/" in f for f in files)


def test_a_batch_that_failed_half_way_is_not_seen(spark, table, categories, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    state.add_batch(part(table, 0), categories, path, 0)
    before = state.read_state(spark, path, "days").agg(F.sum("visits")).first()[0]
    broken = state.Table(["x"], ["y"], [], "x INT, y INT", lambda *_: 1 / 0)
    with monkeypatch.context() as patch:
        patch.setitem(state.TABLES, "pairs", broken)
        with pytest.raises(ZeroDivisionError):
            state.add_batch(part(table, 1), categories, path, 1)
    assert state.committed(spark, path) == [0]
    assert state.read_state(spark, path, "days").agg(F.sum("visits")).first()[0] == before
    state.add_batch(part(table, 1), categories, path, 1)
    assert state.read_state(spark, path, "days").agg(F.sum("visits")).first()[0] == part(table, 0).count() + part(table, 1).count()


def test_an_unfinished_snapshot_is_not_used(spark, table, categories, tmp_path):
    path = str(tmp_path / "state")
    state.add_batch(part(table, 0), categories, path, 0)
    state.read_state(spark, path, "days").limit(1).write.parquet(f"{path}/snapshots/0/days")
    assert state.snapshot(spark, path) is None
    assert state.read_state(spark, path, "days").agg(F.sum("visits")).first()[0] == part(table, 0).count()
    state.compact(spark, path)
    assert state.snapshot(spark, path) == 0


def test_masks_of_odd_category_ids(spark, tmp_path):
    ids = [-65, -64, -1, 0, 63, 64, 449, 2_000_000_000]
    items = ", ".join(f"named_struct('category_id', {i}, 'quantity', 1L)" for i in ids)
    one = spark.sql(
        f"SELECT 1L transaction_id, 7L client_id, 1 store_id, DATE'2024-01-31' date, 8L basket_size, 8L num_categories, array({items}) items"
    )
    names = spark.createDataFrame([], "category_id INT, category_name STRING")
    state.add_batch(one, names, str(tmp_path), 0)
    states = state.read_states(spark, str(tmp_path))
    assert sorted(r.category_id for r in incremental.client_categories(states).collect()) == ids
    features = incremental.client_features(states).first()
    assert (features.category_diversity, features.active_days) == (8, 1)


def test_no_state_yet(spark, tmp_path, categories):
    states = state.read_states(spark, str(tmp_path))
    assert all(df.count() == 0 for df in states.values())
    assert incremental.overall(states).first()["total_transactions"] == 0


def write_store(base, name, lines):
    (base / "Transactions").mkdir(parents=True, exist_ok=True)
    (base / "Products").mkdir(exist_ok=True)
    (base / "Products" / "Categories.csv").write_text("1|A\n2|B\n3|C\n", encoding="utf-8")
    (base / "Transactions" / f"{name}_Tran.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_command_line_update_equals_a_full_refresh(spark, tmp_path):
    """New files are taken in, twice; each time the marts equal those of a refresh of all files."""
    data, store = tmp_path / "data", str(tmp_path / "store")
    write_store(data, "102", [f"2024-01-{i % 28 + 1:02d}|102|{i % 7}|1 {i % 3 + 1} {i % 2 + 1}" for i in range(40)])
    options = ["--n-init", "2", "--max-iter", "20"]
    for day in range(3):
        if day == 1:
            write_store(data, "103", [f"2024-02-{i % 28 + 1:02d}|103|{i % 11}|{i % 4 + 1} 2" for i in range(60)])
        extra = ["--compact"] if day == 2 else []
        main([str(data), str(tmp_path / "new"), "--store", store, *extra, *options])
        main([str(data), str(tmp_path / f"full{day}"), *options])
        for name in ("kpis", "top_clients", "sales_by_store", "weekly_heatmap"):
            got, want = (marts.read_mart(spark, f"{tmp_path}/{d}/executive_summary", name) for d in ("new", f"full{day}"))
            assert same(got, want), name
        for document, name in (
            ("time_series", "daily"), ("boxplot_data", "category_basket_stats"), ("heatmap_data", "correlation_matrix"),
            ("clustering", "segments"), ("client_segments", "mapping"), ("recommendations", "rules"),
        ):
            got, want = (marts.read_mart(spark, f"{tmp_path}/{d}/{document}", name) for d in ("new", f"full{day}"))
            assert same(got, want), name
    assert marts.read_runs(spark, f"{tmp_path}/new/runs").count() == 3


def test_state_of_a_table_ingested_without(spark, tmp_path):
    data, table, check, path = tmp_path / "data", str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "s")
    write_store(data, "102", ["2024-01-01|102|1|1 2", "2024-01-02|102|2|3"])
    names = text.read_categories(spark, f"{data}/Products/Categories.csv")
    ingest.append_new_files(spark, f"{data}/Transactions", table, check).awaitTermination()
    write_store(data, "103", ["2024-01-03|103|1|1"])
    with pytest.raises(ValueError, match="rebuild_state"):
        ingest.append_new_files(spark, f"{data}/Transactions", table, check, state=path, categories=names)
    with pytest.raises(ValueError, match="dimension"):
        ingest.append_new_files(spark, f"{data}/Transactions", table, check, state=path)
    ingest.rebuild_state(spark, table, path, names)
    ingest.append_new_files(spark, f"{data}/Transactions", table, check, state=path, categories=names).awaitTermination()
    assert state.read_state(spark, path, "days").agg(F.sum("visits")).first()[0] == 3
