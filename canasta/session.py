"""Session-level helpers: settings, shared scratch folder, size-checked broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffled bytes that a task takes. Rows compress to about a tenth of what their sorts and hash tables hold.
TASK_BYTES = 8 << 20
#: Bytes of input for which a shuffle gets a partition of its own.
PARTITION_BYTES = 4 << 20
#: Rows up to which a dimension may be broadcast. Dimension rows here are an id
#: and a short name, so the limit is a few tens of MB on each executor.
BROADCAST_MAX_ROWS = 500_000


def tune(spark: SparkSession, *inputs: str) -> SparkSession:
    """Runtime settings every plan of this library relies on.

    The number of shuffle partitions grows with the bytes of ``inputs``, and adaptive execution joins them up to
    ``TASK_BYTES`` only, so that the memory of a task does not grow with the input.

    The skew-join rule normally gives up when splitting a hot key would cost an
    extra exchange (a join followed by a grouping on the same key). One key may
    hold a large part of the data here, so the exchange is the cheaper choice;
    without skew nothing changes. Bucketed tables are always read by bucket, as only then does a
    filter on their key leave buckets out. The settings stay in the caller's session.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    if inputs:
        partitions = sum(_bytes(spark, path) for path in inputs) // PARTITION_BYTES + 1
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(partitions, least)))
    return spark


def _bytes(spark: SparkSession, name: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getContentSummary(path).getLength() if store.exists(path) else 0


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counting stops right after."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint when ``df`` is counted to be small, else ``df`` unchanged.

    An oversized side falls back to a shuffled join, where adaptive execution
    splits hot keys.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


#: Runtime setting that names the folder for intermediate tables.
SCRATCH = "canasta.scratch"


def use_scratch(spark: SparkSession, path: str | None) -> None:
    """Names the session's folder for intermediate tables; None goes back to the configured one."""
    if path:
        spark.conf.set(SCRATCH, path)
    else:
        spark.conf.unset(SCRATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: that of :func:`use_scratch`, else ``spark.checkpoint.dir``.

    There is no local fallback: executors could not see each other's files there.
    """
    folder = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError(
            "no folder for intermediate tables: set spark.checkpoint.dir, or give a scratch path "
            "that all executors share"
        )
    return folder.rstrip("/")


@contextmanager
def run_folder(spark: SparkSession, scratch: str | None = None) -> Iterator[str]:
    """A folder of this run for all intermediate tables, removed at the end, also on failure."""
    before = spark.conf.get(SCRATCH, None)
    use_scratch(spark, scratch or before)
    folder = scratch_path(spark, "run")
    use_scratch(spark, folder)
    try:
        yield folder
    finally:
        use_scratch(spark, before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives lost executors, unlike a cached block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
