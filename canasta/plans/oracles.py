"""ANSI SQL with the same result as each query, for a cross-check in another engine."""

from __future__ import annotations

from canasta import fixed
from canasta.plans.queries import CONFIDENCE, FINE_CATEGORIES, FINE_SUPPORT, LIFT, SET_SUPPORT, SUPPORT

_FACT = r"""
lines AS (
  SELECT l_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS date,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS store_id, o_custkey AS client_id,
         CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) AS category_id,
         CAST(1 AS BIGINT) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
dim AS (
  SELECT DISTINCT CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) AS category_id,
         p_brand AS category_name
  FROM part WHERE CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) <= 20),
fact AS (
  SELECT lines.*, coalesce(category_name, 'Categoría ' || CAST(lines.category_id AS VARCHAR))
         AS category_name
  FROM lines LEFT JOIN dim ON lines.category_id = dim.category_id)"""

_FEATURES = """
txn AS (
  SELECT transaction_id, client_id, store_id, date, sum(quantity) AS basket_size,
         count(DISTINCT category_id) AS num_categories
  FROM lines GROUP BY transaction_id, client_id, store_id, date),
features AS (
  SELECT client_id, count(*) AS purchase_frequency, CAST(sum(basket_size) AS BIGINT) AS total_units,
         avg(CAST(basket_size AS DOUBLE)) AS avg_basket_size,
         avg(CAST(num_categories AS DOUBLE)) AS avg_categories_per_txn,
         any_value(category_diversity) AS category_diversity,
         count(DISTINCT store_id) AS num_stores_visited, count(DISTINCT date) AS active_days
  FROM txn JOIN (SELECT client_id, count(DISTINCT category_id) AS category_diversity
                 FROM lines GROUP BY client_id) USING (client_id)
  GROUP BY client_id),
segments AS (SELECT c_custkey AS client_id, c_mktsegment AS segment_id FROM customer),
members AS (SELECT features.*, segment_id FROM features JOIN segments USING (client_id))"""

_RULES = f"""
items AS (SELECT DISTINCT transaction_id, category_id FROM lines),
n AS (SELECT CAST(count(DISTINCT transaction_id) AS DOUBLE) AS n FROM items),
item_counts AS (SELECT category_id, count(*) AS cnt FROM items GROUP BY category_id),
names AS (SELECT DISTINCT category_id, category_name FROM fact),
pairs AS (
  SELECT a.category_id AS x, b.category_id AS y, count(*) AS num_baskets
  FROM items a JOIN items b ON a.transaction_id = b.transaction_id
  GROUP BY a.category_id, b.category_id),
metrics AS (
  SELECT x, y, num_baskets / n AS support,
         CAST(num_baskets AS DOUBLE) / cx.cnt AS confidence,
         (num_baskets / n) / ((cx.cnt / n) * (cy.cnt / n)) AS lift
  FROM pairs JOIN item_counts cx ON x = cx.category_id JOIN item_counts cy ON y = cy.category_id, n
  WHERE x <> y),
rules AS (
  SELECT x AS antecedent_id, nx.category_name AS antecedent, y AS consequent_id,
         ny.category_name AS consequent, round(support, 4) AS support,
         round(confidence, 4) AS confidence, round(lift, 4) AS lift
  FROM metrics JOIN names nx ON x = nx.category_id JOIN names ny ON y = ny.category_id
  WHERE support >= {SUPPORT}e0 AND confidence >= {CONFIDENCE}e0 AND lift >= {LIFT}e0),
idx AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY antecedent
           ORDER BY lift DESC, confidence DESC, antecedent_id, consequent_id) AS INTEGER) AS rank
  FROM rules)"""

_SEGMENT_RULES = f"""
seg_top AS (
  SELECT segment_id, category_name, row_number() OVER (PARTITION BY segment_id
           ORDER BY count(DISTINCT client_id) DESC, category_name) AS category_rank
  FROM fact JOIN (SELECT c_custkey AS client_id, c_mktsegment AS segment_id FROM customer)
       USING (client_id)
  GROUP BY segment_id, category_name
  QUALIFY category_rank <= {fixed.SEGMENT_TOP_CATEGORIES}),
found AS (
  SELECT t.segment_id, t.category_name AS from_category, t.category_rank, i.*
  FROM seg_top t JOIN idx i ON i.antecedent = t.category_name
  WHERE NOT EXISTS (
    SELECT 1 FROM seg_top o WHERE o.segment_id = t.segment_id AND o.category_name = i.consequent)),
first_seen AS (
  SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY segment_id, consequent
           ORDER BY category_rank, rank) = 1),
seg_rec AS (
  SELECT segment_id, CAST(row_number() OVER (PARTITION BY segment_id
           ORDER BY lift DESC, category_rank, rank) AS INTEGER) AS rank, from_category,
         consequent AS recommendation, confidence, lift, support
  FROM first_seen)"""

_TEXT = r"""
raw AS (
  SELECT row_number() OVER () AS transaction_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS store_id, o_custkey AS client_id,
         regexp_extract(p_brand, '(\d+)', 1) || '  ' || CAST(l_linenumber AS VARCHAR)
           || CASE WHEN l_returnflag = 'R' THEN ' x' ELSE '' END AS items_str
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
text_lines AS (
  SELECT transaction_id, date, store_id, client_id, TRY_CAST(token AS INTEGER) AS category_id
  FROM (SELECT *, unnest(string_split_regex(items_str, '\s+')) AS token FROM raw)
  WHERE TRY_CAST(token AS INTEGER) IS NOT NULL)"""

_TEXT_VISITS = f"""WITH {_TEXT}
SELECT date, store_id, client_id, category_id, count(*) AS units,
       count(DISTINCT transaction_id) AS num_transactions
FROM text_lines GROUP BY date, store_id, client_id, category_id"""

_KPIS = """
SELECT CAST(sum(quantity) AS BIGINT) AS total_units,
       count(DISTINCT transaction_id) AS total_transactions,
       count(DISTINCT client_id) AS total_clients, count(DISTINCT category_id) AS total_categories,
       count(DISTINCT store_id) AS total_stores,
       strftime(min(date), '%Y-%m-%d') AS date_start, strftime(max(date), '%Y-%m-%d') AS date_end
FROM lines"""
_KPI_ROW = f" kpi AS ({_KPIS})"

_UNITS = """
units AS (
  SELECT category_id, category_name, CAST(sum(quantity) AS BIGINT) AS total_units
  FROM fact GROUP BY category_id, category_name)"""

_BOTH = "count(DISTINCT transaction_id) AS num_transactions, CAST(sum(quantity) AS BIGINT) AS total_units"

_HEATMAP = """
months AS (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM lines),
days AS (SELECT DISTINCT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM lines),
seen AS (
  SELECT strftime(date, '%Y-%m') AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         count(DISTINCT transaction_id) AS cnt
  FROM lines GROUP BY ALL),
cells AS (
  SELECT month, day_of_week, coalesce(cnt, 0) AS count
  FROM months CROSS JOIN days LEFT JOIN seen USING (month, day_of_week))"""


def _labels(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_DAY_ES = f"{_labels(fixed.WEEKDAYS_ES)}[day_of_week + 1]"


def _with(*parts_and_select: str) -> str:
    *parts, select = parts_and_select
    return "WITH " + ",".join(parts) + select


def _describe(column: str, source: str, label: str) -> str:
    return f"""
SELECT '{label}' AS label, CAST(min(v) AS DOUBLE) AS min, quantile_cont(v, 0.25) AS q1,
       quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3,
       CAST(max(v) AS DOUBLE) AS max, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
       count(*) AS count
FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source})"""


def _label_case() -> str:
    return f"""CASE WHEN purchase_frequency <= 4 AND total_units <= 25 THEN '{fixed.SPORADIC}'
       WHEN purchase_frequency <= 10 AND total_units <= 80 THEN '{fixed.OCCASIONAL}'
       WHEN category_diversity >= 40 AND total_units >= 200 THEN '{fixed.DIVERSIFIED}'
       WHEN total_units >= 300 THEN '{fixed.VIP}' ELSE '{fixed.REGULAR}' END"""


def _correlations() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(covar_pop({a}, {b}) / "
        f"nullif(stddev_pop({a}) * stddev_pop({b}), 0), 4) AS r FROM features"
        for a in fixed.FEATURES
        for b in fixed.FEATURES
    )


def _segment_stats() -> str:
    return " UNION ALL ".join(
        f"SELECT segment_id, '{f}' AS feature, round(avg({f}), 2) AS mean, "
        f"round(quantile_cont(CAST({f} AS DOUBLE), 0.5), 2) AS median, "
        f"round(stddev_samp({f}), 2) AS std, round(CAST(min({f}) AS DOUBLE), 2) AS min, "
        f"round(CAST(max({f}) AS DOUBLE), 2) AS max FROM members GROUP BY segment_id"
        for f in fixed.SEGMENT_FEATURES
    )


_SUMMARY = f"""
summary AS (
  SELECT segment_id, {_label_case()} AS label, size, percentage, {", ".join(fixed.SEGMENT_FEATURES)}
  FROM (SELECT segment_id, count(*) AS size,
               round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM members) * 100, 1) AS percentage,
               {", ".join(f"round(avg({f}), 2) AS {f}" for f in fixed.SEGMENT_FEATURES)}
        FROM members GROUP BY segment_id))"""


def _radar() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, segment_id, CAST(round(100 * ({f} / CASE WHEN max({f}) OVER () = 0 "
        f"THEN 1 ELSE max({f}) OVER () END)) AS INTEGER) AS value FROM summary"
        for f in fixed.SEGMENT_FEATURES
    )


def _zscores(std: str) -> str:
    return ", ".join(
        f"coalesce(round((CAST({f} AS DOUBLE) - avg({f}) OVER ()) / "
        f"nullif({std}({f}) OVER (), 0), 4), 0) AS {f}"
        for f in fixed.SEGMENT_FEATURES
    )


_VALUES = """
SELECT l_returnflag, CASE WHEN l_tax = 0 OR l_discount = 0 THEN NULL ELSE l_extendedprice END AS value
FROM lineitem"""

_RULE_LIST = "antecedent_id, antecedent, consequent_id, consequent, support, confidence, lift"
_SUGGESTION = "rank, consequent_id, consequent, confidence, lift, support"
_RULE_ORDER = "lift DESC, confidence DESC, antecedent_id, consequent_id"
_DAILY = _with(
    _FACT, f" SELECT strftime(date, '%Y-%m-%d') AS date, {_BOTH} FROM lines GROUP BY 1"
)
_SEGMENT_SOURCE = "SELECT c_custkey AS client_id, c_mktsegment AS segment_id FROM customer"
_SIZES = """
sizes AS (
  SELECT c_mktsegment AS segment_id, count(*) AS size, CAST(row_number() OVER (
           ORDER BY count(*) DESC, c_mktsegment) - 1 AS INTEGER) AS new_segment_id
  FROM customer GROUP BY c_mktsegment)"""


def _top_rules(n: int) -> str:
    return _with(
        _FACT,
        _RULES,
        f" SELECT {_RULE_LIST}, CAST(row_number() OVER (ORDER BY {_RULE_ORDER}) AS INTEGER) AS rank"
        f" FROM rules QUALIFY rank <= {n}",
    )


def _support(min_support: float) -> str:
    return _with(
        _FACT,
        _RULES,
        f""" SELECT category_id, category_name, cnt AS count, round(cnt / n, 4) AS support
        FROM item_counts JOIN names USING (category_id), n WHERE cnt / n >= {min_support}e0""",
    )


_CATEGORY_STATS = _with(
    _FACT,
    """, per_txn AS (SELECT category_name, CAST(sum(quantity) AS DOUBLE) AS v
    FROM fact GROUP BY category_name, transaction_id)
    SELECT category_name, min(v) AS min, quantile_cont(v, 0.25) AS q1,
           quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max,
           round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, count(*) AS count
    FROM per_txn GROUP BY category_name""",
)

_METADATA = _with(
    _FACT,
    _RULES,
    f""" SELECT count(DISTINCT transaction_id) AS n_transactions,
    count(DISTINCT category_id) AS n_categories, CAST({SUPPORT} AS DOUBLE) AS min_support,
    CAST({CONFIDENCE} AS DOUBLE) AS min_confidence, CAST({LIFT} AS DOUBLE) AS min_lift,
    (SELECT count(*) FROM rules) AS total_rules FROM lines""",
)

ORACLES: dict[str, str] = {
    # ---- sources and row-level steps ----
    "enriched_fact": _with(
        _FACT,
        """ SELECT transaction_id, strftime(date, '%Y-%m-%d') AS date, store_id, client_id,
        category_id, quantity, category_name FROM fact""",
    ),
    "weighted_units": """
        SELECT CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS store_id,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_units
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY 1""",
    "category_dimension_text": _with(_FACT, " SELECT category_id, category_name FROM dim"),
    "product_categories_text": r"""
        SELECT CAST(p_partkey AS BIGINT) AS product_code,
               CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS category_id
        FROM part WHERE p_size % 5 <> 0""",
    "text_transactions": _TEXT_VISITS,
    "text_transactions_by_position": _TEXT_VISITS,
    "text_baskets": _TEXT_VISITS,
    "text_load_report": f"WITH {_TEXT} SELECT store_id, count(*) AS num_rows FROM raw GROUP BY store_id",
    "text_load_summary": f"""WITH {_TEXT}
        SELECT count(*) AS total_units, count(DISTINCT transaction_id) AS total_transactions,
               count(DISTINCT client_id) AS total_clients,
               count(DISTINCT category_id) AS total_categories,
               count(DISTINCT store_id) AS total_stores, min(date) AS date_start,
               max(date) AS date_end
        FROM text_lines""",
    "parsed_items": f"""WITH {_TEXT}
        SELECT store_id, category_id, count(*) AS units FROM text_lines
        GROUP BY store_id, category_id""",
    "calendar_columns": _with(
        _FACT,
        f""" SELECT strftime(date, '%Y-%m-%d') AS date,
        strftime(CAST(date_trunc('week', date) AS DATE), '%Y-%m-%d') AS week_start,
        strftime(date, '%Y-%m') AS month, day_of_week, dayname(date) AS day_name_en,
        {_DAY_ES} AS day_name_es,
        {_labels(fixed.WEEKDAYS_ES_SHORT)}[day_of_week + 1] AS day_name_short
        FROM (SELECT DISTINCT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM lines)""",
    ),
    "sanitized_floats": f"""
        SELECT l_returnflag, count(*) AS num_rows, count(value) AS num_finite,
               max(value) AS max_value
        FROM ({_VALUES}) GROUP BY l_returnflag""",
    "finite_rows": f"""
        SELECT l_returnflag, count(*) AS num_rows, min(value) AS min_value
        FROM ({_VALUES}) WHERE value IS NOT NULL GROUP BY l_returnflag""",
    "client_labels": _with(
        _FACT, _FEATURES, f" SELECT client_id, {_label_case()} AS label FROM features"
    ),
    # ---- executive summary ----
    "overall_kpis": _with(_FACT, _KPIS),
    "top_categories": _with(
        _FACT,
        _UNITS,
        """ SELECT *, CAST(row_number() OVER (ORDER BY total_units DESC, category_id) AS INTEGER)
        AS rank FROM units QUALIFY rank <= 10""",
    ),
    "categories_by_volume": _with(
        _FACT,
        _UNITS,
        """ SELECT *, round(100e0 * (CAST(total_units AS DOUBLE) /
        (SELECT sum(total_units) FROM units)), 2) AS percentage FROM units""",
    ),
    "categories_with_remainder": _with(
        _FACT,
        _UNITS,
        f""", ranked AS (SELECT *, row_number() OVER (ORDER BY total_units DESC, category_id) AS rn
        FROM units)
        SELECT CAST(least(rn, 10) AS INTEGER) AS slice,
               CASE WHEN rn <= 9 THEN category_name ELSE '{fixed.REMAINDER_LABEL}' END AS name,
               CAST(sum(total_units) AS BIGINT) AS total_units
        FROM ranked GROUP BY 1, 2""",
    ),
    "top_clients": _with(
        _FACT,
        f""" SELECT client_id, {_BOTH}, CAST(row_number() OVER (
        ORDER BY count(DISTINCT transaction_id) DESC, client_id) AS INTEGER) AS rank
        FROM lines GROUP BY client_id QUALIFY rank <= 10""",
    ),
    "peak_days": _with(
        _FACT,
        f""" SELECT strftime(date, '%Y-%m-%d') AS date, {_BOTH}, dayname(date) AS day_of_week,
        CAST(row_number() OVER (ORDER BY count(DISTINCT transaction_id) DESC, lines.date)
        AS INTEGER) AS rank FROM lines GROUP BY lines.date QUALIFY rank <= 10""",
    ),
    "sales_by_store": _with(
        _FACT,
        f""" SELECT store_id, {_BOTH}, count(DISTINCT client_id) AS num_clients
        FROM lines GROUP BY store_id""",
    ),
    "weekly_heatmap": _with(
        _FACT, _HEATMAP, f" SELECT month, day_of_week, {_DAY_ES} AS day_name, count FROM cells"
    ),
    "weekly_heatmap_wide": _with(
        _FACT,
        " SELECT strftime(date, '%Y-%m') AS month, "
        + ", ".join(
            f'count(DISTINCT CASE WHEN isodow(date) = {i + 1} THEN transaction_id END) AS "{d}"'
            for i, d in enumerate(fixed.WEEKDAYS_ES_SHORT)
        )
        + " FROM lines GROUP BY 1",
    ),
    "heatmap_intensity": _with(
        _FACT,
        _HEATMAP,
        f""" SELECT month, day_of_week, {_DAY_ES} AS day_name, count,
        round(CAST(count AS DOUBLE) / (SELECT max(count) FROM cells), 4) AS intensity FROM cells""",
    ),
    # ---- time series ----
    "daily_series": _DAILY,
    "weekly_series": _with(
        _FACT,
        f""" SELECT strftime(CAST(date_trunc('week', date) AS DATE), '%Y-%m-%d') AS week_start,
        {_BOTH} FROM lines GROUP BY 1""",
    ),
    "monthly_series": _with(
        _FACT, f" SELECT strftime(date, '%Y-%m') AS month, {_BOTH} FROM lines GROUP BY 1"
    ),
    "store_daily_series": _with(
        _FACT,
        f" SELECT strftime(date, '%Y-%m-%d') AS date, store_id, {_BOTH} FROM lines GROUP BY 1, 2",
    ),
    "store_columns": _with(
        _FACT,
        " SELECT strftime(date, '%Y-%m-%d') AS date, "
        + ", ".join(
            f"nullif(count(DISTINCT CASE WHEN store_id = {i} THEN transaction_id END), 0) "
            f"AS store_{i}"
            for i in range(1, 6)
        )
        + " FROM lines GROUP BY 1",
    ),
    # ---- distributions ----
    "transaction_stats": _with(
        _FACT,
        _FEATURES,
        """ SELECT transaction_id, client_id, store_id, strftime(date, '%Y-%m-%d') AS date,
        CAST(basket_size AS BIGINT) AS basket_size, num_categories FROM txn""",
    ),
    "basket_size_stats": _with(
        _FACT, _FEATURES, _describe("basket_size", "txn", fixed.BASKET_SIZE_LABEL)
    ),
    "client_total_stats": _with(
        _FACT, _FEATURES, _describe("total_units", "features", fixed.CLIENT_TOTAL_LABEL)
    ),
    "client_totals": _with(_FACT, _FEATURES, " SELECT client_id, total_units FROM features"),
    "outlier_clients": _with(
        _FACT,
        _FEATURES,
        """, q AS (SELECT quantile_cont(CAST(total_units AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(total_units AS DOUBLE), 0.75) AS q3 FROM features)
        SELECT client_id, total_units FROM features, q WHERE total_units > q3 + 1.5 * (q3 - q1)
        ORDER BY total_units DESC, client_id LIMIT 20""",
    ),
    "category_transaction_units": _with(
        _FACT,
        """ SELECT category_name, transaction_id, CAST(sum(quantity) AS BIGINT) AS units
        FROM fact GROUP BY category_name, transaction_id""",
    ),
    "category_basket_stats": _CATEGORY_STATS,
    "category_basket_stats_of_baskets": _CATEGORY_STATS,
    "most_frequent_categories": _with(
        _FACT,
        """ SELECT category_name, count(DISTINCT transaction_id) AS num_transactions,
        CAST(row_number() OVER (ORDER BY count(DISTINCT transaction_id) DESC, category_name)
        AS INTEGER) AS rank FROM fact GROUP BY category_name QUALIFY rank <= 15""",
    ),
    "basket_size_histogram": _with(
        _FACT,
        _FEATURES,
        """ SELECT CAST(basket_size AS BIGINT) AS basket_size, count(*) AS frequency FROM txn
        WHERE basket_size <= 50 GROUP BY 1""",
    ),
    "basket_size_histogram_head": _with(
        _FACT,
        _FEATURES,
        """ SELECT CAST(basket_size AS BIGINT) AS basket_size, count(*) AS frequency FROM txn
        GROUP BY 1 ORDER BY 1 LIMIT 4""",
    ),
    "basket_size_histogram_small": _with(
        _FACT,
        _FEATURES,
        """ SELECT CAST(basket_size AS BIGINT) AS basket_size, count(*) AS frequency FROM txn
        WHERE basket_size <= 6 GROUP BY 1""",
    ),
    # ---- client features ----
    "client_features": _with(
        _FACT,
        _FEATURES,
        """ SELECT client_id, purchase_frequency, total_units,
        round(avg_basket_size, 4) AS avg_basket_size,
        round(avg_categories_per_txn, 4) AS avg_categories_per_txn,
        category_diversity, num_stores_visited, active_days FROM features""",
    ),
    "segmentation_features": _with(
        _FACT,
        _FEATURES,
        """ SELECT client_id, purchase_frequency, total_units,
        round(avg_basket_size, 4) AS avg_basket_size, category_diversity, active_days
        FROM features""",
    ),
    "feature_correlation": _with(_FACT, _FEATURES, f" {_correlations()}"),
    "feature_client_count": _with(
        _FACT, _FEATURES, " SELECT count(*) AS client_features_count FROM features"
    ),
    "feature_zscores": _with(
        _FACT, _FEATURES, f" SELECT client_id, {_zscores('stddev_pop')} FROM features"
    ),
    "scaled_client_vectors": _with(
        _FACT, _FEATURES, f" SELECT client_id, {_zscores('stddev_samp')} FROM features"
    ),
    # ---- segmentation on a given mapping ----
    "given_segment_summary": _with(_FACT, _FEATURES, _SUMMARY, " SELECT * FROM summary"),
    "given_segment_stats": _with(_FACT, _FEATURES, f" {_segment_stats()}"),
    "given_segments_by_size": _with(
        _SIZES,
        f""" SELECT client_id, new_segment_id AS segment_id
        FROM ({_SEGMENT_SOURCE}) JOIN sizes USING (segment_id)""",
    ),
    "given_segment_sizes": _with(_SIZES, " SELECT segment_id, size, new_segment_id FROM sizes"),
    "given_segment_top_categories": _with(
        _FACT,
        f""" SELECT segment_id, category_name, count(DISTINCT client_id) AS num_clients,
        CAST(row_number() OVER (PARTITION BY segment_id ORDER BY count(DISTINCT client_id) DESC,
        category_name) AS INTEGER) AS rank
        FROM fact JOIN ({_SEGMENT_SOURCE}) USING (client_id)
        GROUP BY segment_id, category_name QUALIFY rank <= 10""",
    ),
    "given_segment_radar": _with(_FACT, _FEATURES, _SUMMARY, f" {_radar()}"),
    # ---- baskets and rules ----
    "basket_items": _with(_FACT, " SELECT DISTINCT transaction_id, category_id FROM lines"),
    "basket_arrays": _with(
        _FACT,
        """ SELECT transaction_id, string_agg(CAST(category_id AS VARCHAR), ' '
        ORDER BY category_id) AS items
        FROM (SELECT DISTINCT transaction_id, category_id FROM lines) GROUP BY transaction_id""",
    ),
    "unnested_baskets": _with(
        _FACT,
        """ SELECT transaction_id, strftime(date, '%Y-%m-%d') AS date, store_id, client_id,
        category_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM lines
        GROUP BY transaction_id, lines.date, store_id, client_id, category_id""",
    ),
    "category_support": _support(fixed.MIN_SUPPORT),
    "category_pair_counts": _with(
        _FACT,
        _RULES,
        """ SELECT x AS category_a, y AS category_b, num_baskets FROM pairs""",
    ),
    "frequent_pair_counts": _with(
        _FACT,
        _RULES,
        """, often AS (SELECT category_id FROM item_counts, n WHERE cnt / n >= 0.15e0)
        SELECT x AS category_a, y AS category_b, num_baskets FROM pairs
        WHERE x IN (SELECT category_id FROM often) AND y IN (SELECT category_id FROM often)""",
    ),
    "association_rules": _with(_FACT, _RULES, f" SELECT {_RULE_LIST} FROM rules"),
    "top_rules": _top_rules(50),
    "rule_lift_bands": _with(
        _FACT,
        _RULES,
        """ SELECT antecedent_id, consequent_id, CASE WHEN lift >= 3 THEN '>=3'
        WHEN lift >= 2 THEN '>=2' WHEN lift >= 1.5 THEN '>=1.5'
        ELSE '<1.5' END AS band FROM rules""",
    ),
    "category_index": _with(
        _FACT, _RULES, f" SELECT {_RULE_LIST}, rank FROM idx WHERE rank <= 15"
    ),
    "category_index_short": _with(
        _FACT, _RULES, f" SELECT {_RULE_LIST}, rank FROM idx WHERE rank <= 5"
    ),
    "rule_metadata": _METADATA,
    "overview_metadata": _METADATA,
    "fpgrowth_rules": _with(_FACT, _RULES, f" SELECT {_RULE_LIST} FROM rules"),
    # ---- recommendations ----
    "recommend_by_category": _with(
        _FACT,
        _RULES,
        f" SELECT {_SUGGESTION} FROM idx WHERE antecedent = 'Brand#12' AND rank <= 15",
    ),
    "recommend_by_category_id": _with(
        _FACT, _RULES, f" SELECT {_SUGGESTION} FROM idx WHERE antecedent_id = 23 AND rank <= 15"
    ),
    "categories_with_rules": _with(
        _FACT, _RULES, " SELECT DISTINCT antecedent AS category_name FROM rules"
    ),
    "overview_supports": _support(SUPPORT) + " ORDER BY support DESC, category_id LIMIT 30",
    "overview_top_rules": _top_rules(30),
    "search_categories": _with(
        _FACT,
        _RULES,
        """ SELECT DISTINCT antecedent AS category_name FROM rules
        WHERE contains(lower(antecedent), 'brand#1') ORDER BY category_name LIMIT 8""",
    ),
    "recommend_by_segment": _with(
        _FACT, _RULES, _SEGMENT_RULES, " SELECT * FROM seg_rec WHERE rank <= 20"
    ),
    "recommend_by_segment_short": _with(
        _FACT, _RULES, _SEGMENT_RULES, " SELECT * FROM seg_rec WHERE rank <= 5"
    ),
    "recommend_for_clients": _with(
        _FACT,
        _RULES,
        _SEGMENT_RULES,
        f""" SELECT client_id, r.* FROM ({_SEGMENT_SOURCE}) c
        JOIN seg_rec r ON c.segment_id = r.segment_id WHERE rank <= 20""",
    ),
    "recommend_for_one_client": _with(
        _FACT,
        _RULES,
        _SEGMENT_RULES,
        f""" SELECT client_id, r.* FROM ({_SEGMENT_SOURCE}) c
        JOIN seg_rec r ON c.segment_id = r.segment_id WHERE rank <= 20 AND client_id = 7""",
    ),
    # ---- sinks and runs ----
    "mart_round_trip_parquet": _DAILY,
    "mart_round_trip_json": _DAILY,
    "fact_table_round_trip": _with(
        _FACT,
        """ SELECT strftime(date, '%Y-%m') AS month, CAST(sum(quantity) AS BIGINT) AS total_units
        FROM lines GROUP BY 1""",
    ),
    "incremental_ingest": _TEXT_VISITS,
    "latest_run": _with(
        _FACT,
        _KPI_ROW,
        """ SELECT 'run-3' AS run_id, '2024-01-03' AS run_day, 3.0::DOUBLE AS duration_sec, 'completed' AS status,
        CAST(NULL AS VARCHAR) AS error, * FROM kpi""",
    ),
    "fpgrowth_suggestions": _with(
        _FACT,
        _RULES,
        f""" SELECT i.transaction_id, count(DISTINCT CASE WHEN own.category_id IS NULL
          THEN m.y END) AS num_suggestions
        FROM items i LEFT JOIN (SELECT x, y FROM metrics WHERE support >= {SUPPORT}e0
          AND confidence >= {CONFIDENCE}e0) m ON i.category_id = m.x
        LEFT JOIN items own ON own.transaction_id = i.transaction_id AND own.category_id = m.y
        GROUP BY i.transaction_id""",
    ),
    "run_history": _with(
        _FACT,
        _KPI_ROW,
        """ SELECT 1 AS rank, 'run-3' AS run_id, '2024-01-03' AS run_day, 3.0::DOUBLE AS duration_sec,
        'completed' AS status, CAST(NULL AS VARCHAR) AS error, * FROM kpi
        UNION ALL SELECT 2, 'run-2', '2024-01-02', 2.0, 'failed', 'no input', NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM kpi""",
    ),
}

_SETS = f"""
items AS (SELECT DISTINCT transaction_id AS t, category_id AS x FROM lines),
n AS (SELECT CAST(count(DISTINCT t) AS DOUBLE) AS n FROM items),
every AS (
  SELECT [x] AS list, count(*) AS count FROM items GROUP BY 1
  UNION ALL SELECT [a.x, b.x], count(*) FROM items a JOIN items b ON a.t = b.t AND a.x < b.x GROUP BY 1
  UNION ALL SELECT [a.x, b.x, c.x], count(*) FROM items a JOIN items b ON a.t = b.t AND a.x < b.x
            JOIN items c ON c.t = a.t AND b.x < c.x GROUP BY 1),
sets AS (SELECT list, array_to_string(list, ' ') AS items, count FROM every, n WHERE count / n >= {SET_SUPPORT}e0)"""

_BY_SIZE = """
by_size AS (
  SELECT segment_id, CAST(row_number() OVER (ORDER BY count(*) DESC, segment_id) - 1 AS INTEGER) AS new_id
  FROM members GROUP BY segment_id)"""

#: Distances between the standard scores of all members.
_SCORES = f"""
scores AS (
  SELECT client_id, segment_id, {", ".join(f"(CAST({f} AS DOUBLE) - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0) AS {f}" for f in fixed.SEGMENT_FEATURES)}
  FROM members),
pairs AS (
  SELECT a.client_id, a.segment_id AS own, b.segment_id AS other,
         sqrt({" + ".join(f"power(coalesce(a.{f} - b.{f}, 0), 2)" for f in fixed.SEGMENT_FEATURES)}) AS d
  FROM scores a, scores b)"""

_SILHOUETTES = """
sides AS (
  SELECT client_id, own, max(n) FILTER (own = other) AS n,
         max(total / greatest(n - 1, 1)) FILTER (own = other) AS inner_d,
         min(total / n) FILTER (own <> other) AS outer_d
  FROM far GROUP BY client_id, own),
silhouettes AS (
  SELECT client_id, own, CASE WHEN n > 1 AND greatest(inner_d, outer_d) > 0
         THEN (outer_d - inner_d) / greatest(inner_d, outer_d) ELSE 0 END AS silhouette
  FROM sides)"""

_MD5 = f"md5('{fixed.SEED}-' || CAST({{}} AS VARCHAR))"

ORACLES |= {
    "mart_executive_summary": ORACLES["categories_by_volume"],
    "mart_time_series": ORACLES["store_daily_series"],
    "mart_boxplot_data": ORACLES["basket_size_histogram"],
    "mart_heatmap_data": ORACLES["feature_correlation"],
    "mart_recommendations": ORACLES["association_rules"],
    "mart_clustering": _with(
        _FACT,
        _FEATURES,
        _SUMMARY,
        _BY_SIZE,
        """ SELECT s.* REPLACE (new_id AS segment_id) FROM summary s JOIN by_size USING (segment_id)""",
    ),
    "mart_segment_stats": _with(
        _FACT,
        _FEATURES,
        _BY_SIZE,
        f" stats AS ({_segment_stats()})",
        " SELECT stats.* REPLACE (new_id AS segment_id) FROM stats JOIN by_size USING (segment_id)",
    ),
    "mart_segment_summary": _with(
        _FACT,
        _FEATURES,
        _SCORES,
        " far AS (SELECT client_id, own, other, sum(d * d) AS total, count(*) AS n FROM pairs GROUP BY ALL)",
        _SILHOUETTES,
        """ SELECT CAST(count(DISTINCT own) AS INTEGER) AS k, round(avg(silhouette), 4) AS silhouette,
        count(*) AS total_clients FROM silhouettes""",
    ),
    "given_segment_silhouette": _with(
        _FACT,
        _FEATURES,
        _SCORES,
        " far AS (SELECT client_id, own, other, sum(d) AS total, count(*) AS n FROM pairs GROUP BY ALL)",
        _SILHOUETTES,
        """ SELECT own AS segment_id, count(*) AS num_clients, round(avg(silhouette), 4) AS silhouette
        FROM silhouettes GROUP BY own""",
    ),
    "mart_client_segments": _with(
        _FACT, _FEATURES, _BY_SIZE,
        " SELECT client_id, new_id AS segment_id FROM members JOIN by_size USING (segment_id)",
    ),
    "mart_client_segment_labels": _with(
        _FACT, _FEATURES, _SUMMARY, _BY_SIZE,
        " SELECT new_id AS segment_id, label FROM summary JOIN by_size USING (segment_id)",
    ),
    "mart_client_segment_categories": _with(
        _FACT, _FEATURES, _BY_SIZE,
        """ SELECT new_id AS segment_id, category_name, count(DISTINCT client_id) AS num_clients,
        CAST(row_number() OVER (PARTITION BY new_id ORDER BY count(DISTINCT client_id) DESC,
             category_name) AS INTEGER) AS rank
        FROM fact JOIN segments USING (client_id) JOIN by_size USING (segment_id)
        GROUP BY new_id, category_name QUALIFY rank <= 10""",
    ),
    "bucketed_segment_summary": ORACLES["given_segment_summary"],
    "bucketed_client_lookup": _with(
        _FACT,
        _FEATURES,
        f""" SELECT client_id, {", ".join(f"round({f}, 4) AS {f}" if f == "avg_basket_size" else f for f in fixed.SEGMENT_FEATURES)},
        segment_id FROM members WHERE client_id = 7""",
    ),
    "text_load_faults": f"""WITH {_TEXT}
        SELECT store_id, count(*) AS num_rows, count(*) FILTER (contains(items_str, 'x')) AS faulty_rows,
               CAST(0 AS BIGINT) AS empty_baskets, CAST(0 AS BIGINT) AS bad_fields, CAST(0 AS BIGINT) AS bad_date,
               CAST(0 AS BIGINT) AS bad_store_id, CAST(0 AS BIGINT) AS bad_client_id,
               count(*) FILTER (contains(items_str, 'x')) AS bad_item
        FROM raw GROUP BY store_id""",
    "text_quarantine": f"""WITH {_TEXT}
        SELECT CAST(store_id AS VARCHAR) AS store_id, 'item' AS reason, 'x' AS value, count(*) AS num_faults
        FROM raw WHERE contains(items_str, 'x') GROUP BY store_id""",
    "sql_recommend_by_category": ORACLES["recommend_by_category"],
    "sql_recommend_for_client": _with(
        _FACT, _FEATURES, _RULES, _SEGMENT_RULES,
        """ SELECT recommendation, confidence, lift, support, from_category, rank
        FROM seg_rec WHERE rank <= 20 AND segment_id = (SELECT c_mktsegment FROM customer WHERE c_custkey = 7)""",
    ),
    "kpis_of_months": _with(
        _FACT, _KPIS + " WHERE store_id IN (1, 3, 4) AND strftime(date, '%Y-%m') BETWEEN '1995-03' AND '1996-08'"
    ),
    "sketched_clients": _with(
        _FACT,
        """ SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT client_id) AS num_clients, 1 AS is_near
        FROM lines GROUP BY 1""",
    ),
    "frequent_itemsets": _with(_FACT, _SETS, " SELECT items, count, round(count / n, 4) AS support FROM sets, n"),
    "itemset_rules": _with(
        _FACT,
        _SETS,
        """ SELECT a.items AS antecedents, c.x AS consequent_id, round(s.count / n, 4) AS support,
               round(s.count / n / (a.count / n), 4) AS confidence,
               round(s.count / n / (a.count / n * (c.count / n)), 4) AS lift
        FROM (SELECT *, unnest(list) AS out FROM sets WHERE len(list) > 1) s
        JOIN sets a ON a.list = list_filter(s.list, lambda i: i <> s.out)
        JOIN (SELECT list[1] AS x, count FROM sets WHERE len(list) = 1) c ON c.x = s.out, n
        WHERE s.count / n / (a.count / n) >= 0.15e0 AND s.count / n / (a.count / n * (c.count / n)) >= 1.1e0""",
    ),
    "incremental_kpis": ORACLES["overall_kpis"],
    "incremental_sales_by_store": ORACLES["sales_by_store"],
    "incremental_heatmap": ORACLES["weekly_heatmap"],
    "incremental_store_daily": ORACLES["store_daily_series"],
    "incremental_category_stats": ORACLES["category_basket_stats"],
    "incremental_client_features": ORACLES["client_features"],
    "incremental_segment_categories": ORACLES["given_segment_top_categories"],
    "incremental_rules": ORACLES["association_rules"],
    "strong_rule_lift_bands": f"""
        WITH items AS (
          SELECT DISTINCT l_orderkey AS t, CAST(l_partkey % {FINE_CATEGORIES} AS INTEGER) AS category FROM lineitem),
        n AS (SELECT CAST(count(DISTINCT t) AS DOUBLE) AS n FROM items),
        own AS (SELECT category, count(*) AS cnt FROM items GROUP BY category),
        pairs AS (
          SELECT a.category AS x, b.category AS y, count(*) AS together
          FROM items a JOIN items b USING (t) WHERE a.category <> b.category GROUP BY 1, 2),
        rules AS (
          SELECT x AS antecedent_id, y AS consequent_id,
                 (together / n) / ((cx.cnt / n) * (cy.cnt / n)) AS lift
          FROM pairs JOIN own cx ON cx.category = x JOIN own cy ON cy.category = y, n
          WHERE together / n >= {FINE_SUPPORT}e0)
        SELECT antecedent_id, consequent_id,
               CASE WHEN round(lift, 4) >= 3 THEN '>=3' WHEN round(lift, 4) >= 2 THEN '>=2'
               WHEN round(lift, 4) >= 1.5 THEN '>=1.5' ELSE '<1.5' END AS band
        FROM rules WHERE lift >= {LIFT}e0""",
    "segment_invariants": _with(
        _FACT,
        """ SELECT count(DISTINCT client_id) AS num_clients, CAST(0 AS BIGINT) AS mismatches,
        1 AS sizes_in_order, 1 AS centers_are_means, 1 AS best_chosen FROM lines""",
    ),
    "feature_client_sample": _with(
        _FACT,
        _FEATURES,
        f""" SELECT client_id, {", ".join(fixed.FEATURES)} FROM features
        ORDER BY {_MD5.format("client_id")} LIMIT {fixed.FEATURE_SAMPLE}""",
    ),
    "given_segment_client_sample": _with(
        _FACT,
        _FEATURES,
        f""" SELECT client_id, segment_id,
        {", ".join(f"round({f}, 2) AS {f}" for f in fixed.SEGMENT_FEATURES)}
        FROM members ORDER BY {_MD5.format("client_id")} LIMIT 100""",
    ),
    "sampled_baskets": _with(
        _FACT,
        f""" SELECT * FROM (SELECT transaction_id, strftime(date, '%Y-%m-%d') AS date, store_id,
        client_id, category_id, quantity FROM lines)
        WHERE CAST('0x' || substr({_MD5.format("transaction_id")}, 1, 8) AS BIGINT) % 1000000 < 250000""",
    ),
    "client_answer": _with(
        _FACT,
        _FEATURES,
        _RULES,
        _SEGMENT_RULES,
        _SUMMARY,
        """ SELECT CAST(7 AS BIGINT) AS client_id, r.*, label AS segment_label, top_categories
        FROM seg_rec r JOIN summary s ON r.segment_id = s.segment_id
        JOIN (SELECT segment_id, string_agg(category_name, '|' ORDER BY category_rank)
              AS top_categories FROM seg_top GROUP BY segment_id) t ON t.segment_id = r.segment_id
        WHERE rank <= 20 AND r.segment_id = (SELECT c_mktsegment FROM customer WHERE c_custkey = 7)""",
    ),
}
