"""Bucketed client tables: no exchange in joins and groupings by client, one file for one client."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from canasta.sources import clients


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("clients")
    one = spark.range(5000).select(F.col("id").alias("client_id"), (F.col("id") % 97).alias("units"))
    two = spark.range(0, 5000, 3).select(F.col("id").alias("client_id"), (F.col("id") % 5).cast("int").alias("segment_id"))
    buckets = clients.write_clients(one, "t_features", f"{base}/features", 8)
    assert clients.write_clients(two, "t_segments", f"{base}/segments", buckets) == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield one, two
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in ("t_features", "t_segments"):
        spark.sql(f"DROP TABLE {name}")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_joins_and_groupings_by_client_move_nothing(spark, tables):
    one, two = tables
    joined = clients.read_clients(spark, "t_features").join(clients.read_clients(spark, "t_segments"), "client_id")
    grouped = joined.groupBy("client_id").agg(F.sum("units").alias("units"))
    assert "Exchange" not in plan(joined) and "Exchange" not in plan(grouped)
    assert "Exchange" in plan(one.join(two, "client_id"))
    assert joined.exceptAll(one.join(two, "client_id")).count() == 0 and joined.count() == two.count()


def test_one_client_is_read_from_one_file(spark, tables):
    found = clients.one_client(spark, "t_features", 4711)
    assert "SelectedBucketsCount: 1 out of 8" in plan(found)
    assert [tuple(r) for r in found.collect()] == [(4711, 4711 % 97)]
    files = {r[0] for r in found.select(F.input_file_name()).collect()}
    assert len(files) == 1 and len(clients.read_clients(spark, "t_features").inputFiles()) == 8
    both = found.join(clients.one_client(spark, "t_segments", 4711), "client_id")
    assert both.count() == (4711 % 3 == 0) and clients.one_client(spark, "t_features", -1).count() == 0
