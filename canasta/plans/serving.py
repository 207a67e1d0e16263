"""The lookups as SQL table functions over stored marts.

:func:`register` reads the marts that a refresh wrote and creates temporary views and table functions in the session:

    SELECT * FROM recommend_by_category('QUESO')
    SELECT * FROM recommend_by_category_id(12)
    SELECT * FROM recommend_by_segment(0)
    SELECT * FROM recommend_for_client(4711)
    SELECT * FROM search_categories('que')

Every function is one SELECT over views of the marts, so its filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from canasta import fixed
from canasta.operators import recommend, rules as assoc
from canasta.sources.marts import read_mart

_SUGGESTION = "rank INT, consequent_id INT, consequent STRING, confidence DOUBLE, lift DOUBLE, support DOUBLE"
_SEGMENT = "rank INT, from_category STRING, recommendation STRING, confidence DOUBLE, lift DOUBLE, support DOUBLE"

#: name, parameters, result columns and body of every function.
FUNCTIONS = [
    (
        "recommend_by_category",
        "name STRING",
        _SUGGESTION,
        "SELECT rank, consequent_id, consequent, confidence, lift, support FROM canasta_index "
        "WHERE antecedent = recommend_by_category.name",
    ),
    (
        "recommend_by_category_id",
        "id INT",
        _SUGGESTION,
        "SELECT rank, consequent_id, consequent, confidence, lift, support FROM canasta_index "
        "WHERE antecedent_id = recommend_by_category_id.id",
    ),
    (
        "recommend_by_segment",
        "segment INT",
        _SEGMENT,
        "SELECT rank, from_category, recommendation, confidence, lift, support FROM canasta_segment_suggestions "
        "WHERE segment_id = recommend_by_segment.segment",
    ),
    (
        "recommend_for_client",
        "client BIGINT",
        f"segment_id INT, {_SEGMENT}",
        "SELECT s.segment_id, s.rank, s.from_category, s.recommendation, s.confidence, s.lift, s.support "
        "FROM canasta_segment_suggestions s JOIN canasta_mapping m ON m.segment_id = s.segment_id "
        "WHERE m.client_id = recommend_for_client.client",
    ),
    (
        "search_categories",
        "part STRING",
        "category_name STRING",
        "SELECT DISTINCT antecedent AS category_name FROM canasta_index "
        f"WHERE contains(lower(antecedent), lower(search_categories.part)) ORDER BY category_name LIMIT {fixed.SUGGESTIONS_SHOWN}",
    ),
]


def register(
    spark: SparkSession,
    out_dir: str,
    fmt: str = "parquet",
    per_category: int | None = fixed.INDEX_PER_CATEGORY,
    n: int = fixed.RECOMMENDATIONS_PER_CLIENT,
) -> None:
    """Creates the views and functions; ``per_category`` and ``n`` as in the lookups of :mod:`canasta.operators.recommend`."""
    base = out_dir.rstrip("/")
    rules = read_mart(spark, f"{base}/recommendations", "rules", fmt)
    top = read_mart(spark, f"{base}/client_segments", "top_categories", fmt)
    mapping = read_mart(spark, f"{base}/client_segments", "mapping", fmt)
    if rules is None or top is None or mapping is None:
        raise ValueError(f"{out_dir} has no recommendations and client_segments: refresh the marts first")
    index = assoc.category_index(rules, None)
    shown = index if per_category is None else index.where(f"rank <= {int(per_category)}")
    shown.createOrReplaceTempView("canasta_index")
    recommend.recommend_by_segment(top, index, n, per_category).createOrReplaceTempView("canasta_segment_suggestions")
    mapping.createOrReplaceTempView("canasta_mapping")
    for name, parameters, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
