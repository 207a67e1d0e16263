"""The number of shuffle partitions follows the input, so that a task's memory does not."""

from canasta.operators import grain
from canasta.plans.queries import registered
from canasta.sources import star

SF_DIR = "/root/testdata/sf0.1"


def test_partitions_grow_with_the_input(spark):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        registered()["client_features"](spark, SF_DIR)  # plans only
        baskets = grain.baskets(star.lines(spark, SF_DIR))
        assert baskets.rdd.getNumPartitions() >= 3  # 10.8 MB of Parquet
        registered()["client_features"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(initial)) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(initial)
