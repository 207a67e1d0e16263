"""Every report of the library as a query over the star-schema tables of a directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canasta import fixed
from canasta.functions import columns as c
from canasta.functions.columns import iso_dates, sanitize_floats
from canasta.operators import (
    bitmaps,
    distributions,
    features as feats,
    grain,
    itemsets,
    kpis,
    recommend,
    rules,
    segmentation as seg,
    timeseries,
)
from canasta.operators.enrich import with_category_names
from canasta.plans import incremental, marts as documents, serving
from canasta.session import materialize, scratch_path, tune
from canasta.sources import clients, marts, star, text
from canasta.streaming import ingest, state

Query = Callable[[SparkSession, str], DataFrame]

#: The 25 categories of the test tables are bought evenly: their rules are weak, so
#: the rule queries use lower thresholds than the library's defaults.
SUPPORT, CONFIDENCE, LIFT = 0.02, 0.14, 1.0
#: Categories of the queries on fine categories, and their support.
FINE_CATEGORIES, FINE_SUPPORT = 449, 0.0003
#: Support of sets of up to three categories.
SET_SUPPORT = 0.0015

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    """Registers a query under its name; dates come out as ISO text."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return iso_dates(function(tune(spark, f"{sf_dir}/lineitem.parquet"), sf_dir))

    _QUERIES[function.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- inputs -----------------------------------------------------------------


def _lines(spark, sf_dir):
    return star.lines(spark, sf_dir)


def _txns(spark, sf_dir):
    return grain.transactions(star.lines(spark, sf_dir))


def _named(spark, sf_dir):
    return with_category_names(star.lines(spark, sf_dir), star.categories(spark, sf_dir))


def _store_months(spark, sf_dir):
    """The mergeable KPI table, from one read of the fact."""
    return bitmaps.store_months(grain.baskets(star.lines(spark, sf_dir)))


def _kpis(spark, sf_dir):
    return bitmaps.kpis(_store_months(spark, sf_dir))


def _features(spark, sf_dir):
    return feats.features_of_baskets(grain.baskets(star.lines(spark, sf_dir)))


def _baskets(spark, sf_dir):
    return materialize(grain.baskets(star.lines(spark, sf_dir)), "baskets")


def _fine_baskets(spark, sf_dir):
    """Baskets over as many categories as the published catalogue has: those of a part's number."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = item.select(
        F.col("l_orderkey").alias("transaction_id"),
        F.lit(1).alias("client_id"),
        F.lit(1).alias("store_id"),
        F.lit(None).cast("date").alias("date"),
        F.pmod("l_partkey", F.lit(FINE_CATEGORIES)).cast("int").alias("category_id"),
        F.lit(1).cast("bigint").alias("quantity"),
    )
    return grain.baskets(lines)


def _rules(spark, sf_dir):
    return _mined(_baskets(spark, sf_dir), star.categories(spark, sf_dir))


def _mined(baskets, categories):
    return rules.association_rules(baskets, categories, SUPPORT, CONFIDENCE, LIFT)


def _index(spark, sf_dir, n=15):
    return rules.category_index(_rules(spark, sf_dir), n)


def _segment_recommendations(spark, sf_dir, n=20):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    top = seg.segment_top_categories(
        grain.client_items(grain.unnest(baskets)),
        categories,
        star.market_segments(spark, sf_dir),
    )
    index = rules.category_index(_mined(baskets, categories), None)
    return recommend.recommend_by_segment(top, index, n)


def _segmentation(spark, sf_dir):
    """The fitted segments, their clients stored, so that the cached features can go."""
    fitted = seg.fit_segments(materialize(_features(spark, sf_dir), "features"))
    try:
        fitted.clients = materialize(fitted.clients, "clients")
    finally:
        fitted.release()
    return fitted


def _given(spark, sf_dir):
    """Client features, and the segmentation that the customers' market segments make."""
    features = materialize(_features(spark, sf_dir), "features")
    return features, seg.of_mapping(features, star.market_segments(spark, sf_dir))


def _state(spark, sf_dir):
    """State of three batches of baskets: one is repeated before and one after a snapshot is made."""
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    path = scratch_path(spark, "state")
    part = lambda i: baskets.where(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == i)
    for batch in (0, 1, 1):
        state.add_batch(part(batch), categories, path, batch)
    state.compact(spark, path)
    for batch in (1, 2, 2):
        state.add_batch(part(batch), categories, path, batch)
    return state.read_states(spark, path)


def _text_directory(spark, sf_dir):
    directory = scratch_path(spark, "text")
    star.text_rows(spark, sf_dir).write.option("sep", "|").csv(f"{directory}/all_Tran.csv")
    return directory


def _store_files(spark, sf_dir, directory):
    """The raw lines as files of one store each, named by it."""
    parts = scratch_path(spark, "stores")
    rows = star.text_rows(spark, sf_dir).withColumn("store", F.col("store_id"))
    rows.write.option("sep", "|").partitionBy("store").csv(parts)
    for store in {r["store_id"] for r in rows.select("store_id").distinct().collect()}:
        _named_as_transactions(spark, f"{parts}/store={store}", directory)


def _named_as_transactions(spark, source, target):
    """Moves Spark's part files to the names that the ingest takes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(target))
    for i, file in enumerate(store.globStatus(path(f"{source}/part-*"))):
        store.rename(file.getPath(), path(f"{target}/{source.rpartition('/')[2]}-{i}_Tran.csv"))


def _units_by_visit(lines):
    return lines.groupBy("date", "store_id", "client_id", "category_id").agg(
        F.sum("quantity").alias("units"),
        F.countDistinct("transaction_id").alias("num_transactions"),
    )


# ---- sources and row-level steps --------------------------------------------


@_query
def enriched_fact(spark, sf_dir):
    return _named(spark, sf_dir)


@_query
def weighted_units(spark, sf_dir):
    return (
        star.lines(spark, sf_dir, weighted=True)
        .groupBy("store_id")
        .agg(F.sum("quantity").alias("total_units"))
    )


@_query
def category_dimension_text(spark, sf_dir):
    path = scratch_path(spark, "categories")
    star.categories(spark, sf_dir).write.option("sep", "|").csv(path)
    return text.category_catalogue(text.read_categories(spark, path))


@_query
def product_categories_text(spark, sf_dir):
    path = scratch_path(spark, "product-categories")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    part.select(
        F.col("p_partkey").alias("code"),
        F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(number).alias("category"),
    ).write.option("sep", "|").option("header", True).csv(path)
    return text.read_product_categories(spark, path)


@_query
def text_transactions(spark, sf_dir):
    return _units_by_visit(text.read_transactions(spark, _text_directory(spark, sf_dir)))


@_query
def text_transactions_by_position(spark, sf_dir):
    directory = _text_directory(spark, sf_dir)
    return _units_by_visit(text.read_transactions(spark, directory, stable_ids=False))


@_query
def text_baskets(spark, sf_dir):
    baskets = text.read_baskets(spark, _text_directory(spark, sf_dir))
    return _units_by_visit(grain.unnest(baskets))


@_query
def text_load_report(spark, sf_dir):
    """Rows per file, the files of a store together."""
    directory = scratch_path(spark, "text")
    _store_files(spark, sf_dir, directory)
    files = text.rows_per_file(text.read_raw_transactions(spark, directory))
    store = F.regexp_extract("file_name", r"store=(\d+)-\d+_Tran", 1).cast("int")
    return files.groupBy(store.alias("store_id")).agg(F.sum("num_rows").alias("num_rows"))


def _checked(spark, sf_dir):
    directory = scratch_path(spark, "text")
    _store_files(spark, sf_dir, directory)
    return text.read_checked_transactions(spark, directory)


@_query
def text_load_faults(spark, sf_dir):
    """Rows and faults per file, the files of a store together."""
    report = text.load_report(_checked(spark, sf_dir))
    store = F.regexp_extract("file_name", r"store=(\d+)-\d+_Tran", 1).cast("int")
    counts = [c for c in report.columns if c != "file_name"]
    return report.groupBy(store.alias("store_id")).agg(*[F.sum(c).alias(c) for c in counts])


@_query
def text_quarantine(spark, sf_dir):
    rows = text.quarantine(_checked(spark, sf_dir))
    return rows.groupBy("store_id", "reason", "value").agg(F.count(F.lit(1)).alias("num_faults"))


@_query
def text_load_summary(spark, sf_dir):
    data = scratch_path(spark, "data")
    _store_files(spark, sf_dir, f"{data}/Transactions")
    star.categories(spark, sf_dir).write.option("sep", "|").csv(f"{data}/Products/Categories.csv")
    lines, _ = text.load_all(spark, data)
    return kpis.kpis(lines, grain.transactions(lines))


@_query
def parsed_items(spark, sf_dir):
    raw = text.parse_rows(star.text_rows(spark, sf_dir))
    return (
        text.explode_items(text.number_rows_by_position(raw))
        .groupBy("store_id", "category_id")
        .agg(F.sum("quantity").alias("units"))
    )


@_query
def calendar_columns(spark, sf_dir):
    day = F.col("date")
    dow = c.weekday_index(day)
    return (
        _lines(spark, sf_dir)
        .select("date")
        .distinct()
        .select(
            "date",
            c.week_start(day).alias("week_start"),
            c.month_key(day).alias("month"),
            dow.alias("day_of_week"),
            c.weekday_name(day).alias("day_name_en"),
            c.weekday_label(dow).alias("day_name_es"),
            c.weekday_label(dow, short=True).alias("day_name_short"),
        )
    )


def _ratios(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return item.select(
        "l_returnflag",
        F.when(F.col("l_tax") == 0, F.lit(float("nan")))
        .when(F.col("l_discount") == 0, F.lit(float("inf")))
        .otherwise(F.col("l_extendedprice"))
        .alias("value"),
    )


@_query
def sanitized_floats(spark, sf_dir):
    return (
        sanitize_floats(_ratios(spark, sf_dir))
        .groupBy("l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("num_rows"),
            F.count("value").alias("num_finite"),
            F.max("value").alias("max_value"),
        )
    )


@_query
def finite_rows(spark, sf_dir):
    return (
        rules.drop_non_finite(_ratios(spark, sf_dir), ["value"])
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("num_rows"), F.min("value").alias("min_value"))
    )


@_query
def client_labels(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "client_id",
        c.segment_label(
            F.col("purchase_frequency"), F.col("total_units"), F.col("category_diversity")
        ).alias("label"),
    )


# ---- executive summary ------------------------------------------------------


@_query
def overall_kpis(spark, sf_dir):
    return _kpis(spark, sf_dir)


@_query
def kpis_of_months(spark, sf_dir):
    """Some months of some stores, from the tables of two halves of the baskets."""
    baskets = _baskets(spark, sf_dir)
    halves = [baskets.where(F.pmod(F.xxhash64("transaction_id"), F.lit(2)) == i) for i in (0, 1)]
    table = bitmaps.merged(bitmaps.store_months(halves[0]).union(bitmaps.store_months(halves[1])))
    return bitmaps.kpis(table, "1995-03", "1996-08", [1, 3, 4])


@_query
def sketched_clients(spark, sf_dir):
    """Clients per year by sketches of store and month, with whether they are within 3 % of the exact count."""
    txns = materialize(_txns(spark, sf_dir), "txns")
    sketches = materialize(bitmaps.client_sketches(txns), "sketches")
    exact = txns.groupBy(F.year("date").alias("year")).agg(F.countDistinct("client_id").alias("num_clients"))
    merged = sketches.groupBy(F.substring("month", 1, 4).cast("int").alias("year")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("clients")).alias("about")
    )
    near = F.abs(F.col("about") - F.col("num_clients")) <= F.col("num_clients") * 0.03
    return exact.join(merged, "year").select("year", "num_clients", near.cast("int").alias("is_near"))


@_query
def top_categories(spark, sf_dir):
    return kpis.top_categories(_lines(spark, sf_dir), star.categories(spark, sf_dir))


@_query
def categories_by_volume(spark, sf_dir):
    return kpis.categories_by_volume(_lines(spark, sf_dir), star.categories(spark, sf_dir))


@_query
def categories_with_remainder(spark, sf_dir):
    return kpis.categories_with_remainder(_lines(spark, sf_dir), star.categories(spark, sf_dir))


@_query
def top_clients(spark, sf_dir):
    return kpis.top_clients(_txns(spark, sf_dir))


@_query
def peak_days(spark, sf_dir):
    return kpis.peak_days(_txns(spark, sf_dir))


@_query
def sales_by_store(spark, sf_dir):
    return kpis.sales_by_store(_txns(spark, sf_dir))


@_query
def weekly_heatmap(spark, sf_dir):
    return kpis.weekly_heatmap(_txns(spark, sf_dir))


@_query
def weekly_heatmap_wide(spark, sf_dir):
    return kpis.heatmap_wide(_txns(spark, sf_dir))


@_query
def heatmap_intensity(spark, sf_dir):
    cells = kpis.heatmap_intensity(_txns(spark, sf_dir))
    return cells.withColumn("intensity", F.round("intensity", 4))


# ---- time series ------------------------------------------------------------


@_query
def daily_series(spark, sf_dir):
    return timeseries.daily(_txns(spark, sf_dir))


@_query
def weekly_series(spark, sf_dir):
    return timeseries.weekly(_txns(spark, sf_dir))


@_query
def monthly_series(spark, sf_dir):
    return timeseries.monthly(_txns(spark, sf_dir))


@_query
def store_daily_series(spark, sf_dir):
    return timeseries.store_daily(_txns(spark, sf_dir))


@_query
def store_columns(spark, sf_dir):
    wide = timeseries.store_columns(_txns(spark, sf_dir))
    return wide.select("date", *[F.col(s).alias(f"store_{s}") for s in wide.columns if s != "date"])


# ---- distributions ----------------------------------------------------------


def _rounded(stats):
    return stats.withColumns({x: F.round(x, 4) for x in ("mean", "std")})


@_query
def transaction_stats(spark, sf_dir):
    return _txns(spark, sf_dir)


@_query
def basket_size_stats(spark, sf_dir):
    return _rounded(distributions.basket_size_stats(_txns(spark, sf_dir)))


@_query
def client_total_stats(spark, sf_dir):
    return _rounded(distributions.client_total_stats(_txns(spark, sf_dir)))


@_query
def client_totals(spark, sf_dir):
    return distributions.units_per_client(_txns(spark, sf_dir))


@_query
def outlier_clients(spark, sf_dir):
    return distributions.outlier_clients(_txns(spark, sf_dir))


@_query
def category_transaction_units(spark, sf_dir):
    return distributions.category_units(
        star.lines(spark, sf_dir), star.categories(spark, sf_dir)
    )


@_query
def category_basket_stats(spark, sf_dir):
    return distributions.category_basket_stats(
        distributions.category_units(star.lines(spark, sf_dir), star.categories(spark, sf_dir))
    )


@_query
def category_basket_stats_of_baskets(spark, sf_dir):
    baskets = grain.baskets(star.lines(spark, sf_dir))
    return distributions.category_basket_stats(
        distributions.category_units_of_baskets(baskets, star.categories(spark, sf_dir))
    )


@_query
def most_frequent_categories(spark, sf_dir):
    return distributions.most_frequent_categories(
        distributions.category_units(star.lines(spark, sf_dir), star.categories(spark, sf_dir))
    )


@_query
def basket_size_histogram(spark, sf_dir):
    return distributions.basket_size_histogram(_txns(spark, sf_dir))


@_query
def basket_size_histogram_head(spark, sf_dir):
    return distributions.histogram_head(
        distributions.basket_size_histogram(_txns(spark, sf_dir)), 4
    )


@_query
def basket_size_histogram_small(spark, sf_dir):
    return distributions.basket_size_histogram(_txns(spark, sf_dir), max_size=6)


# ---- client features --------------------------------------------------------


@_query
def client_features(spark, sf_dir):
    table = _features(spark, sf_dir)
    return table.withColumns(
        {x: F.round(x, 4) for x in ("avg_basket_size", "avg_categories_per_txn")}
    )


@_query
def segmentation_features(spark, sf_dir):
    table = feats.segment_features(_features(spark, sf_dir))
    return table.withColumn("avg_basket_size", F.round("avg_basket_size", 4))


@_query
def feature_correlation(spark, sf_dir):
    return feats.correlation_matrix(_features(spark, sf_dir))


@_query
def feature_client_count(spark, sf_dir):
    return feats.client_count(_features(spark, sf_dir))


@_query
def feature_zscores(spark, sf_dir):
    scores = feats.zscores(_features(spark, sf_dir))
    return scores.select("client_id", *[F.round(x, 4).alias(x) for x in scores.columns[1:]])


@_query
def feature_client_sample(spark, sf_dir):
    return feats.client_sample(_features(spark, sf_dir))


# ---- segmentation -----------------------------------------------------------


@_query
def segment_sweep(spark, sf_dir):
    return _segmentation(spark, sf_dir).elbow(spark)


@_query
def segment_mapping(spark, sf_dir):
    return _segmentation(spark, sf_dir).mapping()


@_query
def segment_centroids(spark, sf_dir):
    return seg.centroids(_segmentation(spark, sf_dir), spark)


@_query
def segment_client_sample(spark, sf_dir):
    return seg.segment_sample(_segmentation(spark, sf_dir).clients)


@_query
def given_segment_client_sample(spark, sf_dir):
    clients = _features(spark, sf_dir).join(star.market_segments(spark, sf_dir), "client_id")
    return seg.segment_sample(clients, 100)


@_query
def segment_invariants(spark, sf_dir):
    """One row per k tried and one for the choice: all clients, ids by size, no client nearer elsewhere."""
    features = materialize(_features(spark, sf_dir), "features")
    fitted = seg.fit_segments(features)
    clients = materialize(fitted.clients, "clients")
    fitted.release()
    names = fixed.SEGMENT_FEATURES
    spread = features.agg(*[F.stddev_samp(x).alias(x) for x in names]).first()

    def distance(center):
        parts = [((F.col(x) - v) / (spread[x] or 1.0)) ** 2 for x, v in zip(names, center, strict=True)]
        return sum(parts, F.lit(0.0))

    far = F.array(*[distance(c) for c in fitted.centers])
    mismatch = F.get(far, F.col("segment_id")) > F.array_min(far) + 1e-6
    means = clients.groupBy("segment_id").agg(*[F.avg(x) for x in names]).collect()
    far_off = max(abs(m - v) / (spread[x] or 1.0) for r in means for x, m, v in zip(names, r[1:], fitted.centers[r[0]], strict=True))
    sizes = [r["count"] for r in clients.groupBy("segment_id").count().orderBy("segment_id").collect()]
    return clients.agg(
        F.count(F.lit(1)).alias("num_clients"),
        F.sum(mismatch.cast("int")).alias("mismatches"),
        F.lit(sizes == sorted(sizes, reverse=True)).cast("int").alias("sizes_in_order"),
        F.lit(far_off < 1e-5).cast("int").alias("centers_are_means"),
        F.lit(fitted.silhouette == max(s for _, _, s in fitted.sweep if s is not None)).cast("int").alias("best_chosen"),
    )


@_query
def scaled_client_vectors(spark, sf_dir):
    vectors, _, _ = seg.scaled_vectors(_features(spark, sf_dir))
    scaled = vector_to_array("scaled")
    return vectors.select(
        "client_id",
        *[F.round(scaled[i], 4).alias(x) for i, x in enumerate(fixed.SEGMENT_FEATURES)],
    )


@_query
def given_segment_summary(spark, sf_dir):
    return seg.segment_summary(_features(spark, sf_dir), star.market_segments(spark, sf_dir))


def _bucketed(spark, sf_dir):
    """Names of the bucketed tables of features and market segments; a run has tables of its own."""
    names = []
    features = feats.segment_features(_features(spark, sf_dir))
    for df in (features, star.market_segments(spark, sf_dir)):
        path = scratch_path(spark, "clients")
        names.append(path.rpartition("/")[2].replace("-", "_"))
        clients.write_clients(df, names[-1], path, 16)
    return names


@_query
def bucketed_segment_summary(spark, sf_dir):
    """The summary from tables bucketed by client, joined without moving a row."""
    features, segments = (clients.read_clients(spark, name) for name in _bucketed(spark, sf_dir))
    return seg.segment_summary(features, segments)


@_query
def bucketed_client_lookup(spark, sf_dir):
    features, segments = _bucketed(spark, sf_dir)
    row = clients.one_client(spark, features, 7).join(clients.one_client(spark, segments, 7), "client_id")
    return row.withColumn("avg_basket_size", F.round("avg_basket_size", 4))


@_query
def given_segment_stats(spark, sf_dir):
    return seg.segment_stats(_features(spark, sf_dir), star.market_segments(spark, sf_dir))


@_query
def given_segment_silhouette(spark, sf_dir):
    scores = seg.silhouettes(_features(spark, sf_dir), star.market_segments(spark, sf_dir))
    return scores.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("num_clients"), F.round(F.avg("silhouette"), 4).alias("silhouette")
    )


@_query
def given_segments_by_size(spark, sf_dir):
    return seg.renumber_segments(star.market_segments(spark, sf_dir))


@_query
def given_segment_sizes(spark, sf_dir):
    return seg.segment_sizes(star.market_segments(spark, sf_dir))


@_query
def given_segment_top_categories(spark, sf_dir):
    return seg.segment_top_categories(
        grain.client_items(_lines(spark, sf_dir)),
        star.categories(spark, sf_dir),
        star.market_segments(spark, sf_dir),
    )


@_query
def given_segment_radar(spark, sf_dir):
    return seg.radar(
        seg.segment_summary(_features(spark, sf_dir), star.market_segments(spark, sf_dir))
    )


# ---- baskets and rules ------------------------------------------------------


@_query
def basket_items(spark, sf_dir):
    return grain.basket_items(_lines(spark, sf_dir))


@_query
def basket_arrays(spark, sf_dir):
    sets = rules.basket_sets(grain.baskets(_lines(spark, sf_dir)))
    return sets.select("transaction_id", F.array_join("items", " ").alias("items"))


@_query
def unnested_baskets(spark, sf_dir):
    return grain.unnest(grain.baskets(_lines(spark, sf_dir)))


@_query
def category_support(spark, sf_dir):
    return rules.category_support(
        materialize(grain.baskets(_lines(spark, sf_dir)).select("transaction_id", "items"), "items"),
        star.categories(spark, sf_dir),
    )


@_query
def category_pair_counts(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    pairs = rules.pair_counts(baskets, rules.frequent_categories(baskets, SUPPORT))
    return pairs.select(
        F.col("x").alias("category_a"), F.col("y").alias("category_b"), "num_baskets"
    )


@_query
def frequent_pair_counts(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    pairs = rules.pair_counts(baskets, rules.frequent_categories(baskets, 0.15))
    return pairs.select(
        F.col("x").alias("category_a"), F.col("y").alias("category_b"), "num_baskets"
    )


def _itemsets(spark, sf_dir):
    baskets = materialize(grain.baskets(_lines(spark, sf_dir)).select("transaction_id", "items"), "items")
    return itemsets.frequent_itemsets(baskets, SET_SUPPORT, 3)


@_query
def frequent_itemsets(spark, sf_dir):
    found = _itemsets(spark, sf_dir)
    names = F.array_join(F.transform("items", lambda i: i.cast("string")), " ")
    return found.select(names.alias("items"), "count", F.round("support", 4).alias("support"))


@_query
def itemset_rules(spark, sf_dir):
    """Rules with one or two antecedents."""
    found = itemsets.itemset_rules(_itemsets(spark, sf_dir), 0.15, 1.1)
    names = F.array_join(F.transform("antecedent_ids", lambda i: i.cast("string")), " ")
    return found.select(names.alias("antecedents"), "consequent_id", "support", "confidence", "lift")


@_query
def association_rules(spark, sf_dir):
    return rules.ordered_rules(_rules(spark, sf_dir))


@_query
def top_rules(spark, sf_dir):
    return rules.top_rules(_rules(spark, sf_dir), 50)


@_query
def strong_rule_lift_bands(spark, sf_dir):
    """Rules between several hundred fine categories, whose rare pairs have high lifts."""
    baskets = materialize(_fine_baskets(spark, sf_dir).select("transaction_id", "items"), "fine")
    mined = rules.association_rules(baskets, star.categories(spark, sf_dir), FINE_SUPPORT, 0.0, LIFT)
    return mined.select("antecedent_id", "consequent_id", c.lift_band(F.col("lift")).alias("band"))


@_query
def rule_lift_bands(spark, sf_dir):
    return _rules(spark, sf_dir).select(
        "antecedent_id", "consequent_id", c.lift_band(F.col("lift")).alias("band")
    )


@_query
def category_index(spark, sf_dir):
    return _index(spark, sf_dir)


@_query
def category_index_short(spark, sf_dir):
    return _index(spark, sf_dir, 5)


@_query
def rule_metadata(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    mined = _mined(baskets, star.categories(spark, sf_dir))
    return rules.rule_metadata(baskets, mined, SUPPORT, CONFIDENCE, LIFT)


@_query
def fpgrowth_rules(spark, sf_dir):
    model = rules.fit_fpgrowth(_baskets(spark, sf_dir), SUPPORT, CONFIDENCE)
    return rules.fpgrowth_rules(model, star.categories(spark, sf_dir), LIFT)


@_query
def fpgrowth_suggestions(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    model = rules.fit_fpgrowth(baskets, SUPPORT, CONFIDENCE)
    mined = rules.fpgrowth_rules(model, star.categories(spark, sf_dir), 0.0)
    return rules.suggest_for_baskets(mined, baskets)


@_query
def sampled_baskets(spark, sf_dir):
    return rules.sample_baskets(_lines(spark, sf_dir), 0.25)


# ---- recommendations --------------------------------------------------------


@_query
def recommend_by_category(spark, sf_dir):
    return recommend.recommend_by_category(_index(spark, sf_dir), "Brand#12")


@_query
def recommend_by_category_id(spark, sf_dir):
    return recommend.recommend_by_category_id(_index(spark, sf_dir), 23)


def _overview(spark, sf_dir):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    mined = _mined(baskets, categories)
    return recommend.overview(baskets, categories, mined, SUPPORT, CONFIDENCE, LIFT)


@_query
def categories_with_rules(spark, sf_dir):
    return _overview(spark, sf_dir)["categories_with_rules"]


@_query
def overview_metadata(spark, sf_dir):
    return _overview(spark, sf_dir)["metadata"]


@_query
def overview_supports(spark, sf_dir):
    return _overview(spark, sf_dir)["category_support"]


@_query
def overview_top_rules(spark, sf_dir):
    return _overview(spark, sf_dir)["top_rules"]


@_query
def search_categories(spark, sf_dir):
    return recommend.search_categories(_index(spark, sf_dir), "bRAND#1")


@_query
def recommend_by_segment(spark, sf_dir):
    return _segment_recommendations(spark, sf_dir)


@_query
def recommend_by_segment_short(spark, sf_dir):
    return _segment_recommendations(spark, sf_dir, 5)


@_query
def recommend_for_clients(spark, sf_dir):
    return recommend.recommend_for_clients(
        star.market_segments(spark, sf_dir), _segment_recommendations(spark, sf_dir)
    )


@_query
def recommend_for_one_client(spark, sf_dir):
    return recommend.recommend_for_clients(
        star.market_segments(spark, sf_dir), _segment_recommendations(spark, sf_dir), client_id=7
    )


@_query
def client_answer(spark, sf_dir):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    segments = star.market_segments(spark, sf_dir)
    top = materialize(
        seg.segment_top_categories(grain.client_items(grain.unnest(baskets)), categories, segments), "top"
    )
    index = rules.category_index(_mined(baskets, categories), None)
    labels = seg.segment_summary(_features(spark, sf_dir), segments).select("segment_id", "label")
    answer = recommend.client_answer(
        segments, labels, top, recommend.recommend_by_segment(top, index), client_id=7
    )
    return answer.withColumn("top_categories", F.array_join("top_categories", "|"))


# ---- sinks and runs ---------------------------------------------------------


def _round_trip(spark, sf_dir, fmt):
    directory = scratch_path(spark, "marts")
    marts.write_marts({"daily": timeseries.daily(_txns(spark, sf_dir))}, directory, fmt)
    stored = marts.read_mart(spark, directory, "daily", fmt)
    return stored.select("date", "num_transactions", "total_units")


@_query
def mart_round_trip_parquet(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parquet")


@_query
def mart_round_trip_json(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json")


def _stored(spark, documents, name, fmt="parquet"):
    """One mart of a document, as a reader finds it after all of the document was written."""
    directory = scratch_path(spark, "marts")
    marts.write_marts(documents, directory, fmt)
    return marts.read_mart(spark, directory, name, fmt)


@_query
def mart_executive_summary(spark, sf_dir):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    document = documents.executive_summary(grain.unnest(baskets), categories, baskets.drop("items"))
    return _stored(spark, document, "categories_by_volume")


@_query
def mart_time_series(spark, sf_dir):
    return _stored(spark, documents.time_series(_txns(spark, sf_dir)), "by_store_daily", "json")


@_query
def mart_boxplot_data(spark, sf_dir):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    units = distributions.category_units_of_baskets(baskets, categories)
    document = documents.boxplot_data(units, baskets.drop("items"))
    return _stored(spark, document, "basket_size_histogram", "json")


@_query
def mart_heatmap_data(spark, sf_dir):
    features = materialize(_features(spark, sf_dir), "features")
    return _stored(spark, documents.heatmap_data(spark, features), "correlation_matrix")


@_query
def mart_clustering(spark, sf_dir):
    features, fitted = _given(spark, sf_dir)
    try:
        document = documents.clustering(spark, fitted, features)
        return _stored(spark, document, "segments", "json")
    finally:
        fitted.release()


@_query
def mart_segment_stats(spark, sf_dir):
    features, fitted = _given(spark, sf_dir)
    try:
        return _stored(spark, documents.clustering(spark, fitted, features), "segment_stats", "json")
    finally:
        fitted.release()


@_query
def mart_segment_summary(spark, sf_dir):
    features, fitted = _given(spark, sf_dir)
    try:
        return _stored(spark, documents.clustering(spark, fitted, features), "summary")
    finally:
        fitted.release()


@_query
def mart_client_segments(spark, sf_dir):
    return _client_segments(spark, sf_dir, "mapping")


@_query
def mart_client_segment_categories(spark, sf_dir):
    return _client_segments(spark, sf_dir, "top_categories")


@_query
def mart_client_segment_labels(spark, sf_dir):
    return _client_segments(spark, sf_dir, "labels")


def _client_segments(spark, sf_dir, name):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    _, fitted = _given(spark, sf_dir)
    try:
        bought = grain.client_items(grain.unnest(baskets))
        document = documents.client_segments(spark, fitted, bought, categories, fitted.mapping())
        return _stored(spark, document, name)
    finally:
        fitted.release()


@_query
def mart_recommendations(spark, sf_dir):
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    document = documents.recommendations(baskets, categories, SUPPORT, CONFIDENCE, LIFT)
    return _stored(spark, document, "rules", "json")


@_query
def fact_table_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fact")
    marts.write_fact(_lines(spark, sf_dir), path)
    stored = marts.read_fact(spark, path)
    return stored.groupBy("month").agg(F.sum("quantity").alias("total_units"))


@_query
def incremental_ingest(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest")
    directory = scratch_path(spark, "text")
    rows = star.text_rows(spark, sf_dir)
    for later in (False, True):  # the second pass finds new files beside those it has taken
        part = rows.where((F.pmod(F.xxhash64("client_id"), F.lit(2)) == 1) == later)
        part.write.option("sep", "|").mode("append").csv(f"{directory}/{later}")
        _named_as_transactions(spark, f"{directory}/{later}", directory)
        ingest.append_new_files(
            spark, directory, table, checkpoint, max_files_per_batch=4
        ).awaitTermination()
    return _units_by_visit(grain.unnest(ingest.read_ingested(spark, table)))


@_query
def incremental_kpis(spark, sf_dir):
    return incremental.overall(_state(spark, sf_dir))


@_query
def incremental_sales_by_store(spark, sf_dir):
    return incremental.executive_summary(_state(spark, sf_dir), star.categories(spark, sf_dir))["sales_by_store"]


@_query
def incremental_heatmap(spark, sf_dir):
    return incremental.executive_summary(_state(spark, sf_dir), star.categories(spark, sf_dir))["weekly_heatmap"]


@_query
def incremental_store_daily(spark, sf_dir):
    return incremental.time_series(_state(spark, sf_dir))["by_store_daily"]


@_query
def incremental_category_stats(spark, sf_dir):
    return incremental.boxplot_data(_state(spark, sf_dir))["category_basket_stats"]


@_query
def incremental_client_features(spark, sf_dir):
    table = incremental.client_features(_state(spark, sf_dir))
    return table.withColumns(
        {x: F.round(x, 4) for x in ("avg_basket_size", "avg_categories_per_txn")}
    )


@_query
def incremental_segment_categories(spark, sf_dir):
    return seg.segment_top_categories(
        incremental.client_categories(_state(spark, sf_dir)),
        star.categories(spark, sf_dir),
        star.market_segments(spark, sf_dir),
    )


@_query
def incremental_rules(spark, sf_dir):
    document = incremental.recommendations(
        _state(spark, sf_dir), star.categories(spark, sf_dir), SUPPORT, CONFIDENCE, LIFT
    )
    return document["rules"]


def _served(spark, sf_dir):
    """SQL functions over stored documents; the segments are the customers' market segments."""
    baskets, categories = _baskets(spark, sf_dir), star.categories(spark, sf_dir)
    out = scratch_path(spark, "served")
    _, fitted = _given(spark, sf_dir)
    try:
        bought = grain.client_items(grain.unnest(baskets))
        marts.write_marts(
            documents.recommendations(baskets, categories, SUPPORT, CONFIDENCE, LIFT), f"{out}/recommendations"
        )
        segments = documents.client_segments(spark, fitted, bought, categories, fitted.mapping())
        marts.write_marts(segments, f"{out}/client_segments")
    finally:
        fitted.release()
    serving.register(spark, out)


@_query
def sql_recommend_by_category(spark, sf_dir):
    _served(spark, sf_dir)
    return spark.sql("SELECT * FROM recommend_by_category('Brand#12')")


@_query
def sql_recommend_for_client(spark, sf_dir):
    _served(spark, sf_dir)
    return spark.sql("SELECT recommendation, confidence, lift, support, from_category, rank FROM recommend_for_client(7)")


def _three_runs(spark, sf_dir):
    """Three runs, of which one is recorded twice and one failed."""
    path = scratch_path(spark, "runs")
    totals = _kpis(spark, sf_dir).first().asDict()
    for day in (1, 2, 3, 3):
        start, end = datetime(2024, 1, day, 12), datetime(2024, 1, day, 12, 0, day)
        failed = "no input" if day == 2 else None
        marts.record_run(spark, path, f"run-{day}", start, None if failed else totals, failed, end)
    return marts.read_runs(spark, path)


def _run_columns(runs):
    return runs.withColumn("run_day", F.date_format("run_at", "yyyy-MM-dd")).drop("run_at", "finished_at")


@_query
def run_history(spark, sf_dir):
    return _run_columns(marts.run_history(_three_runs(spark, sf_dir), 2))


@_query
def latest_run(spark, sf_dir):
    return _run_columns(marts.latest_run(_three_runs(spark, sf_dir)))
