"""Query of the vector operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from squallbars.llm.near_vectors import vector_groups
from squallbars.llm.registry import query


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.y, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least.y, vec_id)) AS kept
FROM v LEFT JOIN least ON vec_id = least.x LEFT JOIN counts ON vec_id = counts.x"""


@query("op3_near_vectors", SQL)
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
