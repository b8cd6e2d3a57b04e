"""op12: rule and verdict of every page's URL.

Labelled URLs are those that a rule decides, and of the others those whose id has a label (toxic or of no quality: block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.url_filter import judged, learn
from paperloom.session import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    bad = F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    return pages.join(labels, "page_id", "left").select("page_id", "url", F.coalesce(F.col("verdict") == "block", F.col("bad")).alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(labelled(spark, sf_dir), key="page_id")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")
