"""Client tables bucketed by client: joins between them move no row, and one client's row is in one file.

Each table has one sorted file per bucket of the client id's hash. Spark knows this from the catalog: two such tables
with as many buckets are joined and grouped by client where they lie, and an equality filter on the id reads one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "client_id"
#: Clients of a bucket, unless the number of buckets is given.
BUCKET_CLIENTS = 500_000


def write_clients(df: DataFrame, table: str, path: str, buckets: int | None = None) -> int:
    """Stores ``df`` as catalog table ``table`` with its files at ``path``; returns the number of buckets.

    Tables that are to be joined need the same number: pass on the first one's.
    """
    buckets = buckets or df.count() // BUCKET_CLIENTS + 1
    # the same hash places rows in tasks and in buckets, so a task writes one file
    placed = df.repartition(buckets, KEY)
    placed.write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(table)
    return buckets


def read_clients(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def one_client(spark: SparkSession, table: str, client_id: int) -> DataFrame:
    """The rows of one client; reads its bucket alone."""
    return spark.table(table).where(F.col(KEY) == F.lit(client_id).cast("bigint"))
