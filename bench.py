"""Times the headline queries and one full refresh; prints one JSON line.

BENCH_SF_DIR  table directory (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_COPIES  the full refresh also runs on this many copies of the baskets (default 18,
              over 10 million fact rows at sf0.1; 0 leaves it out)
"""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from canasta.operators.grain import baskets  # noqa: E402
from canasta.plans.marts import refresh  # noqa: E402
from canasta.plans.queries import registered  # noqa: E402
from canasta.sources import star  # noqa: E402

HEADLINE = [
    "overall_kpis",
    "top_categories",
    "categories_by_volume",
    "top_clients",
    "peak_days",
    "sales_by_store",
    "weekly_heatmap",
    "daily_series",
    "store_daily_series",
    "basket_size_stats",
    "outlier_clients",
    "category_basket_stats",
    "client_features",
    "feature_correlation",
    "segment_sweep",
    "given_segment_stats",
    "given_segment_top_categories",
    "category_support",
    "association_rules",
    "fpgrowth_rules",
    "recommend_for_clients",
    "text_transactions",
    "incremental_ingest",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def copied_fact(spark, sf_dir, copies, path):
    """The fact of the given tables ``copies`` times, with ids of their own, as Parquet.

    Clients are spread over about 131,000 ids, as many as the published runs had.
    """
    lines = star.lines(spark, sf_dir)
    shift = F.col("copy").cast("bigint")
    many = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    many.withColumn("transaction_id", F.col("transaction_id") * copies + shift).withColumn(
        "client_id", F.col("client_id") * 9 + shift % 9
    ).drop("copy").write.parquet(path)
    return spark.read.parquet(path)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    copies = int(os.environ.get("BENCH_COPIES", "18"))
    spark = session(cpus)
    queries = registered()
    queries["sales_by_store"](spark, sf_dir).collect()  # starts the JVM's code paths

    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    categories = star.categories(spark, sf_dir)
    total = round(sum(seconds.values()), 3)
    if copies:
        fact = copied_fact(spark, sf_dir, copies, f"{base}/fact")
        rows = fact.count()
        seconds[f"full_refresh_{rows // 1_000_000}m_rows"] = timed(
            lambda: refresh(
                spark, baskets(fact), categories, f"{base}/marts", thresholds=(0.02, 0.14, 1.0)
            )
        )
    print(
        json.dumps(
            {
                "metric": "sum of headline query times",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
