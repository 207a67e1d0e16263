"""Pipe-separated transaction files and dimension files.

A transaction line is ``date|store|client|codes``: the codes are blank-separated
category ids, one per unit bought. A line is one transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canasta import fixed
from canasta.operators.enrich import with_category_names

#: Identical lines are numbered in runs of at most this length per row.
COPY_RUN = 100_000

#: Buckets of the id space; a bucket holds about rows / 2^18 lines.
_BUCKET_BITS = 18
ID_BUCKETS = 1 << _BUCKET_BITS
#: Bits of a line's position in its bucket: all that are left in a load, fewer in an ingest batch,
#: whose number takes the 25 bits above. Positions and batch numbers beyond them are errors.
_LOAD_BITS = 62 - _BUCKET_BITS
_BATCH_ROW_BITS = 20
MAX_BATCH = 1 << (63 - _BUCKET_BITS - _BATCH_ROW_BITS)

RAW_SCHEMA = ", ".join(f"{name} STRING" for name in fixed.RAW_COLUMNS)


# ---- scans ------------------------------------------------------------------


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``id|name`` file."""
    return (
        spark.read.schema(fixed.CATEGORY_SCHEMA)
        .option("sep", fixed.FIELD_SEPARATOR)
        .option("header", False)
        .csv(path)
    )


def category_catalogue(categories: DataFrame) -> DataFrame:
    return categories.select("category_id", "category_name").orderBy("category_id")


def read_product_categories(spark: SparkSession, path: str) -> DataFrame:
    """Product to category bridge with a header; rows that are not two numbers are dropped."""
    raw = (
        spark.read.option("sep", fixed.FIELD_SEPARATOR)
        .option("header", True)
        .csv(path)
        .toDF(*fixed.PRODUCT_CATEGORY_COLUMNS)
    )
    return clean_product_categories(raw)


def clean_product_categories(raw: DataFrame) -> DataFrame:
    return raw.select(
        *[to_whole_number(F.col(c), "bigint").alias(c) for c in fixed.PRODUCT_CATEGORY_COLUMNS]
    ).na.drop()


def read_raw_transactions(spark: SparkSession, directory: str) -> DataFrame:
    """All transaction files of a directory, as text columns plus the file name.

    Spark lists and splits the files; a directory without any raises the
    reader's path-not-found error.
    """
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("sep", fixed.FIELD_SEPARATOR)
        .option("header", False)
        .csv(f"{directory.rstrip('/')}/{fixed.TRANSACTION_FILES}")
        .select(*fixed.RAW_COLUMNS, F.col("_metadata.file_name").alias("file_name"))
    )


def rows_per_file(raw: DataFrame) -> DataFrame:
    return raw.groupBy("file_name").agg(F.count(F.lit(1)).alias("num_rows"))


# ---- quarantine -------------------------------------------------------------

_CORRUPT = "_corrupt_record"


def read_checked_transactions(spark: SparkSession, directory: str) -> DataFrame:
    """As :func:`read_raw_transactions`, with the whole line where it has not exactly four fields, else null.

    Missing fields are null and further ones are left out.
    """
    return (
        spark.read.schema(f"{RAW_SCHEMA}, {_CORRUPT} STRING")
        .option("sep", fixed.FIELD_SEPARATOR)
        .option("header", False)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(f"{directory.rstrip('/')}/{fixed.TRANSACTION_FILES}")
        .select(*fixed.RAW_COLUMNS, _CORRUPT, F.col("_metadata.file_name").alias("file_name"))
    )


def faults(checked: DataFrame) -> DataFrame:
    """file_name, the four fields and ``faults``, an array of (reason, value): all that a lenient load drops or nulls.

    Row-local; reasons are ``fields``, ``date``, ``store_id``, ``client_id`` and, for each unreadable item code, ``item``.
    """
    fault = lambda reason, value: F.struct(F.lit(reason).alias("reason"), value.alias("value"))
    bad = {
        "date": F.try_to_date("date", fixed.DATE_PATTERN).isNull(),
        "store_id": F.col("store_id").try_cast("int").isNull(),
        "client_id": F.col("client_id").try_cast("bigint").isNull(),
    }
    whole = F.array(
        F.when(F.col(_CORRUPT).isNotNull(), fault("fields", F.col(_CORRUPT))),
        *[F.when(test, fault(name, F.col(name))) for name, test in bad.items()],
    )
    unread = F.filter(tokens(F.col("items_str")), lambda token: to_whole_number(token).isNull())
    items = F.coalesce(F.transform(unread, lambda token: fault("item", token)), F.array())
    every = F.concat(F.array_compact(whole), items)
    return checked.select("file_name", *fixed.RAW_COLUMNS, every.alias("faults"))


def quarantine(checked: DataFrame) -> DataFrame:
    """One row per fault, to be kept as a table: file_name, the line's fields, reason and value."""
    return faults(checked).select("file_name", *fixed.RAW_COLUMNS, F.inline("faults"))


def load_report(checked: DataFrame) -> DataFrame:
    """Per file: rows, rows with any fault, rows without a readable item, and faults by reason. One scan."""
    found = faults(checked)
    readable = F.size(category_ids(F.col("items_str"))) > 0
    of = lambda reason: F.size(F.filter("faults", lambda f: f["reason"] == reason))
    return found.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(F.size("faults") > 0).alias("faulty_rows"),
        F.count_if(~F.coalesce(readable, F.lit(False))).alias("empty_baskets"),
        *[F.sum(of(r)).alias(f"bad_{r}") for r in ("fields", "date", "store_id", "client_id", "item")],
    )


# ---- row-level steps --------------------------------------------------------


def to_whole_number(text: Column, dtype: str = "int") -> Column:
    """Whole number of a numeric text; null when it is none or does not fit."""
    return text.try_cast("double").try_cast(dtype)


def tokens(items: Column) -> Column:
    """Non-empty tokens between runs of any white space."""
    return F.filter(F.split(F.trim(items), r"\s+"), lambda token: token != "")


def category_ids(items: Column) -> Column:
    """Category ids of an item text in order, repeats kept, unreadable tokens left out."""
    return F.filter(
        F.transform(tokens(items), lambda token: to_whole_number(token)),
        lambda category: category.isNotNull(),
    )


def parse_rows(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed date, store and client. ``strict`` fails on bad values, else they become null."""
    date, store, client = F.col("date"), F.col("store_id"), F.col("client_id")
    if strict:
        typed = {
            "date": F.to_date(date, fixed.DATE_PATTERN),
            "store_id": store.cast("int"),
            "client_id": client.cast("bigint"),
        }
    else:
        typed = {
            "date": F.try_to_date(date, fixed.DATE_PATTERN),
            "store_id": store.try_cast("int"),
            "client_id": client.try_cast("bigint"),
        }
    return raw.withColumns(typed)


def explode_items(rows: DataFrame) -> DataFrame:
    """One row per unit bought. A basket without any readable item yields none."""
    return rows.select(
        "transaction_id",
        "date",
        "store_id",
        "client_id",
        F.explode(category_ids(F.col("items_str"))).alias("category_id"),
        F.lit(1).cast("bigint").alias("quantity"),
    )


def nest_items(rows: DataFrame) -> DataFrame:
    """Baskets straight from lines, without any shuffle: a line is a transaction.

    Same columns as the baskets grouped from an exploded fact.
    """
    ids = F.col("_ids")
    items = F.transform(
        F.array_distinct(ids),
        lambda category: F.struct(
            category.alias("category_id"),
            F.size(F.filter(ids, lambda other: other == category))
            .cast("bigint")
            .alias("quantity"),
        ),
    )
    return (
        rows.withColumn("_ids", category_ids(F.col("items_str")))
        .filter(F.size(ids) > 0)
        .select(
            "transaction_id",
            "client_id",
            "store_id",
            "date",
            F.size(ids).cast("bigint").alias("basket_size"),
            F.size(F.array_distinct(ids)).cast("bigint").alias("num_categories"),
            F.sort_array(items).alias("items"),
        )
    )


# ---- transaction ids --------------------------------------------------------


def number_rows(raw: DataFrame, batch: int | None = None) -> DataFrame:
    """Adds ``transaction_id``: unique, and the same however the files are split.

    Identical lines of a file are interchangeable, so it is enough to count them
    (map-side partial aggregation absorbs a hot line) and to number the copies;
    runs longer than COPY_RUN are cut and spread before they are expanded. The
    lines are then numbered inside hash buckets of (line, copy), which is even
    for hot lines as well. ``batch`` selects a disjoint id range per ingest
    batch, so a repeated batch gets the same ids again.
    """
    if batch is not None and not 0 <= batch < MAX_BATCH:
        raise OverflowError(f"batch {batch} has no id range: there are {MAX_BATCH}")
    line = ["file_name", *fixed.RAW_COLUMNS]
    copies = raw.groupBy(*line).agg(F.count(F.lit(1)).alias("_copies"))
    short = copies.filter(F.col("_copies") <= COPY_RUN).select(
        *line, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")
    )
    long = (
        copies.filter(F.col("_copies") > COPY_RUN)
        .select(
            *line,
            "_copies",
            F.explode(
                F.sequence(
                    F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(COPY_RUN).cast("bigint")
                )
            ).alias("_start"),
        )
        .repartition("_start", *line)
        .select(
            *line,
            F.explode(
                F.sequence(
                    F.col("_start") + 1, F.least(F.col("_start") + COPY_RUN, F.col("_copies"))
                )
            ).alias("_copy"),
        )
    )
    numbered = short.unionByName(long).withColumn(
        "_bucket", F.pmod(F.xxhash64(*line, "_copy"), F.lit(ID_BUCKETS))
    )
    bits = _LOAD_BITS if batch is None else _BATCH_ROW_BITS
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(*line, "_copy"))
    start = (batch or 0) << (_BUCKET_BITS + _BATCH_ROW_BITS)
    return numbered.withColumn("_position", checked_position(position, bits)).select(
        (
            F.lit(start).cast("bigint")
            + F.col("_bucket").cast("bigint") * F.lit(1 << bits).cast("bigint")
            + F.col("_position")
        ).alias("transaction_id"),
        *line,
    )


def checked_position(position: Column, bits: int) -> Column:
    """``position`` as a long, or an error where it would run into the next bucket's ids."""
    beyond = F.raise_error(F.lit(f"more than {1 << bits} lines in a bucket of the id space"))
    return F.when(position < (1 << bits), position.cast("bigint")).otherwise(beyond.cast("bigint"))


def number_rows_by_position(raw: DataFrame) -> DataFrame:
    """Adds ``transaction_id`` from the row's position in the scan.

    No shuffle, unique at any size, but the values depend on how the files are
    split. Meant for a load that is written once and read from there.
    """
    return raw.withColumn("transaction_id", F.monotonically_increasing_id())


# ---- loads ------------------------------------------------------------------


def read_transactions(
    spark: SparkSession, directory: str, strict: bool = True, stable_ids: bool = True
) -> DataFrame:
    """The exploded fact of all transaction files, without category names."""
    return explode_items(_numbered_rows(spark, directory, strict, stable_ids))


def read_baskets(
    spark: SparkSession, directory: str, strict: bool = True, stable_ids: bool = True
) -> DataFrame:
    """The baskets of all transaction files."""
    return nest_items(_numbered_rows(spark, directory, strict, stable_ids))


def _numbered_rows(
    spark: SparkSession, directory: str, strict: bool, stable_ids: bool
) -> DataFrame:
    raw = read_raw_transactions(spark, directory)
    numbered = number_rows(raw) if stable_ids else number_rows_by_position(raw)
    return parse_rows(numbered, strict)


def load_all(
    spark: SparkSession, data_dir: str, strict: bool = True, stable_ids: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(fact with category names, category dimension) of a data directory."""
    base = data_dir.rstrip("/")
    categories = read_categories(spark, f"{base}/Products/Categories.csv")
    lines = read_transactions(spark, f"{base}/Transactions", strict, stable_ids)
    return with_category_names(lines, categories), categories
