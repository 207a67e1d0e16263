"""Writing marts, reading them back, and the table of run totals."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canasta import fixed
from canasta.functions.columns import iso_dates, month_key, sanitize_floats
from canasta.functions.ranking import top_k


def write_mart(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrites one mart. Text formats get ISO dates and no NaN or infinity."""
    if fmt == "json":
        df = iso_dates(df)
    df = sanitize_floats(df)
    df.write.mode("overwrite").format(fmt).option("ignoreNullFields", "false").save(path)
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value STRING")
    schema.coalesce(1).write.mode("overwrite").text(_schema_path(path))


def _schema_path(path: str) -> str:
    """Beside the mart's own folder, so that listing the mart finds its data alone."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_schemas/{name}"


def write_marts(marts: Mapping[str, DataFrame], directory: str, fmt: str = "parquet") -> None:
    for name, df in marts.items():
        write_mart(df, f"{directory.rstrip('/')}/{name}", fmt)


def read_mart(
    spark: SparkSession, directory: str, name: str, fmt: str = "parquet"
) -> DataFrame | None:
    """The mart as last written, or None when it was never written.

    Its stored schema is used, so that null columns and empty marts keep their columns.
    """
    path = f"{directory.rstrip('/')}/{name}"
    stored = _load(spark.read.format("text"), _schema_path(path))
    reader = spark.read.format(fmt)
    if stored is not None:
        reader = reader.schema(StructType.fromJson(json.loads(stored.first()[0])))
    return _load(reader, path)


def _load(reader: DataFrameReader, path: str) -> DataFrame | None:
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_fact(lines: DataFrame, path: str) -> None:
    """The fact as a Parquet table partitioned by month.

    ``rebalance`` lets adaptive execution cut a large month into several files
    and join small ones.
    """
    by_month = lines.withColumn("month", month_key(F.col("date")))
    by_month.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- run totals -------------------------------------------------------------

#: A run's record. Totals are null if it failed.
RUN_SCHEMA = (
    "run_at TIMESTAMP, finished_at TIMESTAMP, duration_sec DOUBLE, status STRING, error STRING, "
    "total_units BIGINT, total_transactions BIGINT, total_clients BIGINT, total_categories BIGINT, "
    "total_stores BIGINT, date_start STRING, date_end STRING"
)
DONE, FAILED = "completed", "failed"


def record_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    started: datetime,
    totals: Mapping | None = None,
    error: str | None = None,
    finished: datetime | None = None,
) -> None:
    """Writes the record of one run; recording the same run again replaces it."""
    finished = finished or datetime.now()
    row = {
        "run_at": started,
        "finished_at": finished,
        "duration_sec": (finished - started).total_seconds(),
        "status": FAILED if error is not None else DONE,
        "error": error,
    }
    for name, value in (totals or {}).items():
        row[name] = value.isoformat() if isinstance(value, date) else value
    columns = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    record = spark.createDataFrame([[row.get(c) for c in columns]], RUN_SCHEMA)
    record.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All recorded runs; an empty table before the first."""
    runs = _load(spark.read.schema(f"{RUN_SCHEMA}, run_id STRING").format("parquet"), path)
    return spark.createDataFrame([], f"{RUN_SCHEMA}, run_id STRING") if runs is None else runs


def run_history(runs: DataFrame, n: int = fixed.RUN_HISTORY) -> DataFrame:
    """The last ``n`` runs, newest first."""
    return top_k(runs, [F.desc("run_at")], n)


def latest_run(runs: DataFrame) -> DataFrame:
    return top_k(runs, [F.desc("run_at")], 1, rank=None)
