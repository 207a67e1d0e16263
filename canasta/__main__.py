"""Refreshes all marts from a data directory: ``python -m canasta DATA_DIR OUT_DIR``.

Also runs with spark-submit. DATA_DIR holds ``Transactions/*_Tran.csv`` and
``Products/Categories.csv``.

With ``--store PATH`` only files that were not seen before are parsed: their baskets are appended to a table under
PATH, their counts to the marts' state beside it, and all marts are made from that state. The first such run
takes in all files. ``--compact`` first folds the state of all batches so far into one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from canasta import fixed
from canasta.plans.incremental import refresh_from_state
from canasta.plans.marts import refresh
from canasta.session import use_scratch
from canasta.sources import text
from canasta.streaming import ingest, state


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="canasta", description=__doc__)
    parser.add_argument("data_dir")
    parser.add_argument("out_dir")
    parser.add_argument("--format", choices=["parquet", "json"], default="parquet")
    parser.add_argument("--lenient", action="store_true", help="null for unreadable values")
    parser.add_argument("--position-ids", action="store_true", help="ids without any shuffle")
    parser.add_argument("--scratch", help="shared folder for intermediate tables")
    parser.add_argument("--store", help="shared folder of ingested baskets and state; take in new files only")
    parser.add_argument("--compact", action="store_true", help="with --store: fold the state of earlier batches")
    parser.add_argument("--n-init", type=int, default=fixed.KMEANS_STARTS)
    parser.add_argument("--max-iter", type=int, default=fixed.KMEANS_ITERATIONS)
    parser.add_argument("--min-support", type=float, default=fixed.MIN_SUPPORT)
    parser.add_argument("--min-confidence", type=float, default=fixed.MIN_CONFIDENCE)
    parser.add_argument("--min-lift", type=float, default=fixed.MIN_LIFT)
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("canasta").getOrCreate()
    use_scratch(spark, options.scratch)
    base = options.data_dir.rstrip("/")
    categories = text.read_categories(spark, f"{base}/Products/Categories.csv")
    common = dict(
        fmt=options.format,
        thresholds=(options.min_support, options.min_confidence, options.min_lift),
        scratch=options.scratch,
        n_init=options.n_init,
        max_iter=options.max_iter,
    )
    if options.store:
        _update(spark, options, f"{base}/Transactions", categories, common)
        return
    baskets = text.read_baskets(
        spark,
        f"{base}/Transactions",
        strict=not options.lenient,
        stable_ids=not options.position_ids,
    )
    refresh(spark, baskets, categories, options.out_dir, **common)


def _update(spark, options, transactions, categories, common) -> None:
    """Takes in new files, then makes all marts from the state."""
    store = options.store.rstrip("/")
    if options.compact:
        state.compact(spark, f"{store}/state")
    query = ingest.append_new_files(
        spark,
        transactions,
        f"{store}/baskets",
        f"{store}/checkpoint",
        strict=not options.lenient,
        state=f"{store}/state",
        categories=categories,
    )
    query.awaitTermination()
    refresh_from_state(spark, f"{store}/state", categories, options.out_dir, **common)


if __name__ == "__main__":
    main()
