"""Scratch folders, marts with nulls, and segmentation of few or uniform clients."""

import os

import pytest
from pyspark.sql import functions as F

from canasta import fixed, session
from canasta.operators import segmentation as seg
from canasta.sources import marts


def features(spark, vectors):
    rows = [(i, *map(float, v)) for i, v in enumerate(vectors)]
    schema = "client_id long, " + ", ".join(f"{c} double" for c in fixed.SEGMENT_FEATURES)
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("distinct", [1, 2, 3, 4])
def test_segments_of_few_distinct_clients(spark, distinct):
    table = features(spark, [(i % distinct, i % distinct, 1, 1, 1) for i in range(12)])
    fitted = seg.fit_segments(table, n_init=1)
    try:
        assert fitted.clients.count() == 12
        assert 1 <= fitted.k <= distinct and len(fitted.centers) == fitted.k
        assert (fitted.silhouette is None) == (fitted.k == 1)
        assert sum(fitted.clients.groupBy("segment_id").count().toPandas()["count"]) == 12
        assert fitted.summary(spark).first()["total_clients"] == 12
        assert seg.centroids(fitted, spark).count() == fitted.k
    finally:
        fitted.release()


def test_three_clients(spark):
    fitted = seg.fit_segments(features(spark, [(1, 2, 3, 4, 5), (9, 9, 9, 9, 9), (0, 0, 0, 0, 0)]))
    assert fitted.clients.count() == 3
    fitted.release()


def test_every_client_is_nearest_to_its_own_centre(spark):
    table = features(spark, [(i % 5 * 10 + i % 2, i, i % 3, 1, i % 7) for i in range(60)])
    fitted = seg.fit_segments(table, n_init=2, max_iter=50)
    scale = {c: table.agg(F.stddev_samp(c)).first()[0] or 1.0 for c in fixed.SEGMENT_FEATURES}
    for row in fitted.clients.collect():
        far = [
            sum(((row[c] - x) / scale[c]) ** 2 for c, x in zip(fixed.SEGMENT_FEATURES, center))
            for center in fitted.centers
        ]
        assert far[row["segment_id"]] <= min(far) + 1e-6
    best = max(s for _, _, s in fitted.sweep)
    assert fitted.silhouette == best
    fitted.release()


def test_scratch_is_named_and_removed(spark, tmp_path):
    base = str(tmp_path / "scratch")
    with pytest.raises(ZeroDivisionError), session.run_folder(spark, base) as folder:
        session.materialize(spark.range(3).toDF("x"), "numbers")
        assert os.listdir(folder)
        raise ZeroDivisionError
    assert not os.path.exists(folder)
    assert spark.conf.get(session.SCRATCH, None) is None


def test_no_folder_is_an_error(spark):
    class Unset:
        def get(self, key, default=None):
            return default

    class Plain:
        conf = Unset()

    with pytest.raises(ValueError, match="scratch"):
        session.shared_dir(Plain())


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_marts_keep_null_and_empty_columns(spark, tmp_path, fmt):
    full = spark.createDataFrame([(1, None, None), (2, None, 0.5)], "a int, b string, c double")
    for name, df in {"nulls": full, "empty": full.limit(0)}.items():
        marts.write_mart(df, f"{tmp_path}/{name}", fmt)
        stored = marts.read_mart(spark, str(tmp_path), name, fmt)
        assert stored.dtypes == df.dtypes
        assert sorted(stored.collect()) == sorted(df.collect())
    assert marts.read_mart(spark, str(tmp_path), "absent", fmt) is None
