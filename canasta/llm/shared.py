"""Helpers of the operators: tables, written intermediates, numbering in two levels."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Documents per Arrow batch in Python stages; bounds a worker's memory.
BATCH_ROWS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Prepares a session for Python stages: small Arrow batches, as one document may be very long, and
    this package on all executors, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if not any(path.endswith("/canasta.zip") for path in context.listFiles):
        context.addPyFile(_packed(folder(spark, "package")))


def _packed(path: str) -> str:
    """The package as a zip file in the shared folder."""
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/canasta.zip") as sink:
        sink.write(packed.getvalue())
    return f"{path}/canasta.zip"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder: ``spark.checkpoint.dir``, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage for good."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list,
    rank: str,
    size: str | None = None,
    start: str | None = None,
) -> DataFrame:
    """Gapless row numbers from 0 within ``group``, without bringing a group together.

    Rows are numbered inside (group, bucket); a bucket's offset is the count of the
    buckets before it, so ``bucket`` must grow with ``order``'s leading part. With
    ``size`` the running sum of that column before each row becomes ``start``.
    ``df`` is read twice: give a narrow, written table.
    """
    parts = df.withColumn("_bucket", bucket)
    sums = [F.count(F.lit(1)).alias("_n")]
    if size:
        sums.append(F.sum(size).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*group, "_bucket").agg(*sums)
    offsets = totals.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        *([F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_size_before")] if size else []),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    out = parts.join(offsets, [*group, "_bucket"]).withColumn(
        rank, F.col("_rows_before") + F.row_number().over(inside) - 1
    )
    if size:
        running = F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(start, F.col("_size_before") + running - F.col(size)).drop("_size_before")
    return out.drop("_bucket", "_rows_before")


def unit(*key) -> Column:
    """A hash of ``key`` in the open interval (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
