"""Query of the similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from squallbars.llm.common import documents
from squallbars.llm.ngram_join import join_similar
from squallbars.llm.registry import query


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE w IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(least.y, d.doc_id)) AS class_id, coalesce(counts.n, 0) AS n_links,
  d.doc_id = least(d.doc_id, coalesce(least.y, d.doc_id)) AS kept
FROM documents d LEFT JOIN least ON d.doc_id = least.x LEFT JOIN counts ON d.doc_id = counts.x"""


@query("op8_ngram_join", SQL)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return join_similar(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "kept")
