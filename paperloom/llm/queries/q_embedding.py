"""op9: near-duplicate groups of all vectors of one label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.embedding_dups import near_duplicates
from paperloom.session import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
near AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach(u, v) AS (SELECT DISTINCT u, v FROM near UNION SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM near GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
  coalesce(e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)), false) AS kept
FROM embeddings e LEFT JOIN counts ON counts.u = e.vec_id LEFT JOIN least ON least.u = e.vec_id
"""
