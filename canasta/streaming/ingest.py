"""Incremental ingest: only transaction files not seen before are parsed and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canasta import fixed
from canasta.sources.text import RAW_SCHEMA, nest_items, number_rows, parse_rows
from canasta.streaming.state import add_batch, clear_state, has_state


def new_transaction_rows(
    spark: SparkSession,
    directory: str,
    max_files_per_batch: int | None = None,
    pattern: str = fixed.TRANSACTION_FILES,
) -> DataFrame:
    """Stream of raw lines of the transaction files that appear in a directory."""
    reader = (
        spark.readStream.schema(RAW_SCHEMA)
        .option("sep", fixed.FIELD_SEPARATOR)
        .option("header", False)
        .option("pathGlobFilter", pattern)
    )
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.csv(directory).select(
        *fixed.RAW_COLUMNS, F.col("_metadata.file_name").alias("file_name")
    )


def append_new_files(
    spark: SparkSession,
    directory: str,
    baskets_path: str,
    checkpoint_path: str,
    strict: bool = True,
    max_files_per_batch: int | None = None,
    pattern: str = fixed.TRANSACTION_FILES,
    state: str | None = None,
    categories: DataFrame | None = None,
) -> StreamingQuery:
    """Processes all files not yet ingested, then stops.

    With ``state`` each batch also adds its part to the marts' state there (:mod:`canasta.streaming.state`), from the
    batch's own baskets; ``categories`` is the dimension whose names it uses.

    The checkpoint remembers the files. A batch may run twice after a failure, so
    each writes its own partition of the basket table with overwrite, and its transaction
    ids depend only on its content and number: a repeat leaves the same rows.
    Both paths must be on storage every executor reaches. A fresh checkpoint would number batches from 0
    again, over those of an existing table, and is refused.
    """
    if state and categories is None:
        raise ValueError("the marts' state needs the category dimension")
    if state and _exists(spark, baskets_path) and not has_state(spark, state):
        raise ValueError(f"{baskets_path} has batches that {state} lacks: call rebuild_state first")
    if not _exists(spark, checkpoint_path) and _exists(spark, baskets_path):
        raise ValueError(f"{baskets_path} has batches, but the checkpoint {checkpoint_path} is missing")

    def write_batch(rows: DataFrame, batch_id: int) -> None:
        baskets = nest_items(parse_rows(number_rows(rows, batch_id), strict))
        path = f"{baskets_path}/batch_id={batch_id}"
        baskets.write.mode("overwrite").parquet(path)
        if state:
            stored = rows.sparkSession.read.schema(baskets.schema).parquet(path)
            add_batch(stored, categories, state, batch_id)

    return (
        new_transaction_rows(spark, directory, max_files_per_batch, pattern)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def rebuild_state(spark: SparkSession, baskets_path: str, state: str, categories: DataFrame) -> None:
    """The marts' state of an ingested table, batch by batch; needed once for a table that was ingested without."""
    clear_state(spark, state)
    if _exists(spark, baskets_path):
        stored = spark.read.parquet(baskets_path)
        for row in stored.select("batch_id").distinct().orderBy("batch_id").toLocalIterator():
            part = stored.where(F.col("batch_id") == row["batch_id"]).drop("batch_id")
            add_batch(part, categories, state, row["batch_id"])


def read_ingested(spark: SparkSession, baskets_path: str) -> DataFrame:
    """The baskets of all batches so far; an empty table before the first file."""
    if not _exists(spark, baskets_path):
        raw = spark.createDataFrame([], RAW_SCHEMA + ", file_name STRING")
        return nest_items(parse_rows(number_rows(raw, 0)))
    return spark.read.parquet(baskets_path).drop("batch_id")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
