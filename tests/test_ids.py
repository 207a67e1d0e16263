"""Id ranges of loads and ingest batches, and the guards of the ingest."""

import pytest
from pyspark.sql import functions as F

from canasta.sources import text
from canasta.streaming import ingest


def raw(spark):
    rows = [("2013-01-01", "102", str(i % 3), "1 2", "a_Tran.csv") for i in range(20)]
    return spark.createDataFrame(rows, text.RAW_SCHEMA + ", file_name STRING")


def test_batches_have_ranges_of_their_own(spark):
    ids = [set(r[0] for r in text.number_rows(raw(spark), b).select("transaction_id").collect()) for b in (0, 1, 2**20, text.MAX_BATCH - 1)]
    assert all(len(i) == 20 and min(i) >= 0 for i in ids) and not set.intersection(*ids)
    for a, b in zip(ids, ids[1:]):
        assert max(a) < min(b)
    with pytest.raises(OverflowError):
        text.number_rows(raw(spark), text.MAX_BATCH)


def test_positions_beyond_a_bucket_are_errors(spark):
    checked = text.checked_position(F.col("id"), 2).alias("p")
    assert sorted(r.p for r in spark.range(4).select(checked).collect()) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="id space"):
        spark.range(5).select(checked).collect()


def test_ingest_before_the_first_file_and_without_its_checkpoint(spark, tmp_path):
    table = f"{tmp_path}/table"
    assert ingest.read_ingested(spark, table).count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "102_Tran.csv").write_text("2013-01-01|102|1|1 2 3\n")
    ingest.append_new_files(spark, f"{tmp_path}/in", table, f"{tmp_path}/checkpoint").awaitTermination()
    assert ingest.read_ingested(spark, table).count() == 1
    with pytest.raises(ValueError, match="checkpoint"):
        ingest.append_new_files(spark, f"{tmp_path}/in", table, f"{tmp_path}/other")
