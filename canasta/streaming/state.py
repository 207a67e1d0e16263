"""Mergeable state of the marts: small tables per ingest batch that add up to the same tables of all baskets.

Every state table is a grouping whose aggregates merge: counts and sums are added, sets of days and categories are
bit masks that are or-ed. A batch writes its own part of each table, computed from that batch's baskets alone, and is
then committed by a marker; readers merge the newest snapshot with the committed batches after it. So a refresh
reads no old basket, a repeated batch overwrites its own part, and a batch that failed half-way is not seen.
:func:`compact` folds the committed batches into a new snapshot, which counts once its own marker is there.

Layout below the state's folder, on storage all executors reach:

deltas/<table>/batch_id=<n>     the part of batch n
committed/<n>                   marker of batch n
snapshots/<n>/<table>           all batches up to n
snapshots/<n>/complete          marker of that snapshot
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canasta.functions.columns import month_key
from canasta.operators.distributions import category_units_of_baskets
from canasta.operators.grain import unnest

#: Categories per bit mask.
MASK = 64


@dataclass(frozen=True)
class Table:
    """A state table: ``rows`` makes its part from (baskets, category dimension), before merging."""

    keys: list[str]
    sums: list[str]
    masks: list[str]
    schema: str
    rows: Callable[[DataFrame, DataFrame], DataFrame]

    def merged(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(
            *[F.sum(c).alias(c) for c in self.sums], *[F.bit_or(c).alias(c) for c in self.masks]
        )


def _ones(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(1).cast("bigint"))


def _days(baskets, categories):
    return _ones(baskets.select("date", "store_id", F.col("basket_size").alias("units")), "visits")


def _client_stores(baskets, categories):
    rows = baskets.select(
        "client_id", "store_id", F.col("basket_size").alias("units"), F.col("num_categories").alias("category_visits")
    )
    return _ones(rows, "visits")


def _client_months(baskets, categories):
    return baskets.select(
        "client_id", month_key(F.col("date")).alias("month"), F.expr("shiftleft(1L, dayofmonth(date) - 1)").alias("days")
    )


def _client_categories(baskets, categories):
    items = baskets.select("client_id", F.explode("items.category_id").alias("category_id"))
    return items.select(
        "client_id",
        F.floor(F.col("category_id") / MASK).alias("block"),
        F.expr(f"shiftleft(1L, pmod(category_id, {MASK}))").alias("categories"),
    )


def _categories(baskets, categories):
    return unnest(baskets).select("category_id", F.col("quantity").alias("units"))


def _basket_sizes(baskets, categories):
    return _ones(baskets.select("basket_size"), "frequency")


def _category_sizes(baskets, categories):
    return _ones(category_units_of_baskets(baskets, categories).select("category_name", "units"), "frequency")


def _pairs(baskets, categories):
    items = baskets.select(F.col("items.category_id").alias("items"))
    rest = F.slice("items", F.col("_pos") + 1, F.size("items"))
    first = items.select("items", F.posexplode("items").alias("_pos", "x"))
    return _ones(first.select("x", F.explode(rest).alias("y")), "num_baskets")


#: All state tables. Pairs are kept for every pair that occurs, as supports may rise later.
TABLES = {
    "days": Table(["date", "store_id"], ["visits", "units"], [], "date DATE, store_id INT, visits BIGINT, units BIGINT", _days),
    "client_stores": Table(
        ["client_id", "store_id"], ["visits", "units", "category_visits"], [],
        "client_id BIGINT, store_id INT, visits BIGINT, units BIGINT, category_visits BIGINT", _client_stores,
    ),
    "client_months": Table(["client_id", "month"], [], ["days"], "client_id BIGINT, month STRING, days BIGINT", _client_months),
    "client_categories": Table(
        ["client_id", "block"], [], ["categories"], "client_id BIGINT, block BIGINT, categories BIGINT", _client_categories
    ),
    "categories": Table(["category_id"], ["units"], [], "category_id INT, units BIGINT", _categories),
    "basket_sizes": Table(["basket_size"], ["frequency"], [], "basket_size BIGINT, frequency BIGINT", _basket_sizes),
    "category_sizes": Table(
        ["category_name", "units"], ["frequency"], [], "category_name STRING, units BIGINT, frequency BIGINT", _category_sizes
    ),
    "pairs": Table(["x", "y"], ["num_baskets"], [], "x INT, y INT, num_baskets BIGINT", _pairs),
}


# ---- files ------------------------------------------------------------------


def _store(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _mark(spark: SparkSession, path: str) -> None:
    found, store = _store(spark, path)
    store.create(found, True).close()


def _delete(spark: SparkSession, path: str) -> None:
    found, store = _store(spark, path)
    store.delete(found, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    found, store = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(found)] if store.exists(found) else []


def _exists(spark: SparkSession, path: str) -> bool:
    found, store = _store(spark, path)
    return store.exists(found)


def committed(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the committed batches that have not been compacted away."""
    return sorted(int(n) for n in _names(spark, f"{state}/committed"))


def snapshot(spark: SparkSession, state: str) -> int | None:
    """The last batch of the newest complete snapshot."""
    found = [int(n) for n in _names(spark, f"{state}/snapshots")]
    return max((n for n in found if _exists(spark, f"{state}/snapshots/{n}/complete")), default=None)


def has_state(spark: SparkSession, state: str) -> bool:
    return bool(committed(spark, state)) or snapshot(spark, state) is not None


def clear_state(spark: SparkSession, state: str) -> None:
    """Removes the state's own folders."""
    for name in ("committed", "snapshots", "deltas"):
        _delete(spark, f"{state}/{name}")


# ---- writing and reading ----------------------------------------------------


def add_batch(
    baskets: DataFrame, categories: DataFrame, state: str, batch_id: int, parallel_writes: int = 4
) -> None:
    """Adds the part of one batch, or replaces it if the batch is repeated.

    ``baskets`` are that batch's alone, best a stored table, as every state table scans them once. A batch
    that a snapshot holds already is left alone. Category names enter one table: after a change of the
    dimension's names the state has to be built anew from all baskets.
    """
    spark = baskets.sparkSession
    done = snapshot(spark, state)
    if done is not None and batch_id <= done:
        return
    _delete(spark, f"{state}/committed/{batch_id}")

    def write(name: str) -> None:
        table = TABLES[name]
        part = table.merged(table.rows(baskets, categories))
        part.write.mode("overwrite").parquet(f"{state}/deltas/{name}/batch_id={batch_id}")

    with ThreadPoolExecutor(parallel_writes) as pool:
        list(pool.map(write, TABLES))
    _mark(spark, f"{state}/committed/{batch_id}")


def read_state(spark: SparkSession, state: str, name: str) -> DataFrame:
    """One state table over the snapshot and all committed batches after it, merged."""
    table = TABLES[name]
    done = snapshot(spark, state)
    fresh = [n for n in committed(spark, state) if done is None or n > done]
    paths = [f"{state}/deltas/{name}/batch_id={n}" for n in fresh]
    if done is not None:
        paths.append(f"{state}/snapshots/{done}/{name}")
    if not paths:
        return spark.createDataFrame([], table.schema)
    parts = spark.read.schema(table.schema).parquet(*paths)
    return table.merged(parts) if len(paths) > 1 else parts


def read_states(spark: SparkSession, state: str) -> dict[str, DataFrame]:
    return {name: read_state(spark, state, name) for name in TABLES}


def compact(spark: SparkSession, state: str) -> None:
    """Folds all committed batches into a new snapshot, then removes their parts and the older snapshot.

    Until the snapshot is complete readers use the old parts. Run it when no refresh reads the state.
    """
    done, batches = snapshot(spark, state), committed(spark, state)
    fresh = [n for n in batches if done is None or n > done]
    if not fresh:
        return
    target = f"{state}/snapshots/{fresh[-1]}"
    _delete(spark, target)
    for name in TABLES:
        read_state(spark, state, name).write.parquet(f"{target}/{name}")
    _mark(spark, f"{target}/complete")
    for n in batches:
        for name in TABLES:
            _delete(spark, f"{state}/deltas/{name}/batch_id={n}")
        _delete(spark, f"{state}/committed/{n}")
    if done is not None:
        _delete(spark, f"{state}/snapshots/{done}")
