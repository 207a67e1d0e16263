"""Incremental ingest, stored marts, run history, full refresh and plan shapes."""

import datetime as dt
import inspect
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from canasta.operators import distributions, kpis, recommend, rules, segmentation as seg, timeseries
from canasta.operators.enrich import with_category_names
from canasta.operators.grain import baskets, transactions, unnest
from canasta.plans.marts import refresh
from canasta.session import broadcast_if_small, scratch_path, shared_dir
from canasta.sources import marts, star, text
from canasta.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


# ---- ingest -----------------------------------------------------------------


def test_ingest_takes_only_new_files(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "baskets"), str(tmp_path / "state")
    source.mkdir()

    def run():
        ingest.append_new_files(spark, str(source), table, state).awaitTermination()
        return ingest.read_ingested(spark, table)

    (source / "1_Tran.csv").write_text("2024-01-01|1|1|5 5 x 6\n2024-01-01|1|1|5 5 x 6\n")
    (source / "readme.csv").write_text("not a transaction file\n")
    first = run()
    assert first.count() == 2 and first.select("transaction_id").distinct().count() == 2
    before = sorted(map(tuple, unnest(first).collect()))
    (source / "2_Tran.csv").write_text("2024-01-02|2|7|8\n2024-01-02|2|8|\n")
    second = run()
    assert second.count() == 3
    assert set(before) < set(map(tuple, unnest(second).collect()))
    assert run().count() == 3
    assert unnest(second).agg(F.sum("quantity")).first()[0] == 7


def test_repeated_batch_gives_the_same_rows(spark, tmp_path):
    (tmp_path / "1_Tran.csv").write_text("".join(f"2024-01-01|1|{i % 3}|{i % 2} 4\n" for i in range(50)))
    raw = text.read_raw_transactions(spark, str(tmp_path))
    batch = lambda rows: text.nest_items(text.parse_rows(text.number_rows(rows, 5)))
    assert batch(raw).exceptAll(batch(raw.repartition(6))).count() == 0


# ---- stored marts -----------------------------------------------------------


def test_missing_mart_is_none(spark, tmp_path):
    assert marts.read_mart(spark, str(tmp_path), "nothing") is None


def test_json_mart_has_iso_dates_and_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), float("nan"))], "d DATE, v DOUBLE")
    marts.write_marts({"m": df}, str(tmp_path), "json")
    stored = spark.read.schema("d STRING, v DOUBLE").json(f"{tmp_path}/m")
    assert tuple(stored.first()) == ("2024-01-02", None)


def test_run_history_is_newest_first(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert marts.read_runs(spark, path).count() == 0
    for day in (2, 3, 1, 3):  # a run that is recorded again is replaced
        start = dt.datetime(2024, 1, day)
        marts.record_run(spark, path, f"r{day}", start, {"total_units": day}, finished=start + dt.timedelta(seconds=5))
    runs = marts.read_runs(spark, path)
    assert runs.count() == 3
    assert [r.run_at.day for r in marts.run_history(runs, 2).collect()] == [3, 2]
    last = marts.latest_run(runs).first()
    assert (last.run_at.day, last.status, last.duration_sec, last.total_units) == (3, "completed", 5.0, 3)


def test_a_failed_run_is_recorded_with_its_error(spark, tmp_path):
    out = str(tmp_path / "out")
    empty = baskets(star.lines(spark, SF)).limit(0)
    with pytest.raises(ValueError, match="no clients"):
        refresh(spark, empty, star.categories(spark, SF), out)
    run = marts.read_runs(spark, f"{out}/runs").first()
    assert (run.status, run.total_units) == ("failed", None) and "no clients" in run.error


def test_refresh_writes_every_mart(spark, tmp_path):
    out = str(tmp_path / "out")
    lines, categories = star.lines(spark, SF), star.categories(spark, SF)
    refresh(spark, baskets(lines), categories, out, thresholds=(0.02, 0.14, 1.0))
    sizes = {
        name: marts.read_mart(spark, out, name).count()
        for name in (
            "executive_summary/kpis",
            "executive_summary/categories_by_volume",
            "time_series/daily",
            "boxplot_data/category_basket_stats",
            "heatmap_data/correlation_matrix",
            "clustering/elbow",
            "clustering/segment_stats",
            "client_segments/mapping",
            "recommendations/rules",
            "recommendations/category_support",
        )
    }
    runs = marts.read_runs(spark, f"{out}/runs").collect()
    assert [(r.status, r.error) for r in runs] == [("completed", None)] and runs[0].duration_sec > 0
    assert runs[0].total_units == lines.count()
    clients = lines.select("client_id").distinct().count()
    assert sizes["executive_summary/kpis"] == 1
    assert marts.read_mart(spark, out, "recommendations/generated_at").count() == 1
    assert sizes["heatmap_data/correlation_matrix"] == 49
    assert sizes["clustering/elbow"] == 4
    assert sizes["client_segments/mapping"] == clients
    assert sizes["recommendations/rules"] == 139
    stored = marts.read_mart(spark, out, "time_series/daily")
    assert stored.exceptAll(timeseries.daily(transactions(lines))).count() == 0


# ---- sizes and plans --------------------------------------------------------


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_broadcast_depends_on_the_counted_size(spark):
    df, dim = spark.range(1000), spark.range(50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(df.join(broadcast_if_small(dim), "id"))
        assert "BroadcastHashJoin" not in plan(df.join(broadcast_if_small(dim, 49), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_enrichment_broadcasts_the_dimension(spark):
    named = with_category_names(star.lines(spark, SF), star.categories(spark, SF))
    assert "BroadcastHashJoin LeftOuter BuildRight" in plan(named)


def test_scan_reads_only_the_columns_used(spark):
    scan = plan(timeseries.daily(transactions(star.lines(spark, SF))))
    for column in ("l_quantity", "l_extendedprice", "o_custkey", "o_totalprice", "o_orderpriority"):
        assert column not in scan


def test_top_k_plans(spark):
    txns = transactions(star.lines(spark, SF))
    assert "TakeOrderedAndProject" in plan(kpis.top_clients(txns))
    index = rules.category_index(spark.createDataFrame(
        [], "antecedent_id INT, antecedent STRING, consequent_id INT, consequent STRING, "
        "support DOUBLE, confidence DOUBLE, lift DOUBLE").union(
        spark.read.schema("a INT, b STRING, c INT, d STRING, e DOUBLE, f DOUBLE, g DOUBLE")
        .csv(SF)))
    assert "WindowGroupLimit" in plan(index)


def test_transactions_reuse_the_partitioning_of_the_order_join(spark):
    """Grouping by transaction right after a shuffled join with orders adds no exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [plan(grain(star.lines(spark, SF))) for grain in (transactions, baskets)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text_plan in plans:
        tree = text_plan.split("\n\n")[0]
        assert tree.count("Exchange") == 4  # lineitem and part by part, then with orders by order


def test_hot_order_is_split_although_its_rows_are_grouped_next(spark, tmp_path):
    """A third of all lines on one order: the join splits it and the result is whole."""
    item = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("l_orderkey"),
        (F.col("id") % 50).alias("l_partkey"),
        F.lit(1.0).alias("l_quantity"),
    )
    item.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") + 1).alias("p_brand")
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(300_000).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 1000).alias("o_custkey"),
        F.expr("TIMESTAMP_NTZ'2024-01-01'").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = transactions(star.lines(spark, str(tmp_path)))
        hot = [r for r in df.collect() if r.transaction_id == 7]
        executed = plan(df)
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(hot) == 1 and hot[0].basket_size == 100_001 and hot[0].num_categories == 50
    assert "skew" in executed.lower()


def test_library_has_no_python_udf_and_no_cross_join(spark):
    import canasta.functions.columns as columns
    import canasta.functions.distribution as distribution
    import canasta.operators.features as features
    import canasta.operators.grain as grain

    for module in (columns, distribution, distributions, features, grain, kpis, recommend, rules, seg, star, text, timeseries, ingest):
        source = inspect.getsource(module)
        for word in ("udf(", "applyInPandas", "mapInPandas", "crossJoin", "toPandas", "localCheckpoint"):
            assert word not in source, (module.__name__, word)
    units = distributions.category_units_of_baskets(
        baskets(star.lines(spark, SF)), star.categories(spark, SF)
    )
    assert "EvalPython" not in plan(units)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_stored_category_marts(spark, tmp_path, fmt):
    volume = kpis.categories_by_volume(star.lines(spark, SF), star.categories(spark, SF))
    marts.write_marts({"volume": volume}, str(tmp_path), fmt)
    stored = marts.read_mart(spark, str(tmp_path), "volume", fmt).select(*volume.columns)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, volume.collect()))
