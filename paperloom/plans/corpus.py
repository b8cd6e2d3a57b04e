"""The driver's tables as pages, queries, grades and vectors.

The tables have no scans, ink or captions, so those are made from ids, the same way in SQL
(``paperloom.plans.sql``). A document group has at most 400 pages, so windows over a group stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import evaluate as E
from paperloom.operators import pages as P
from paperloom.params import Params
from paperloom.session import spread, table

HEAD = """CASE WHEN doc_id % 11 = 1 THEN concat('제 ', doc_id % 9 + 1, ' 장 개요', chr(10)) WHEN doc_id % 13 = 1 THEN concat('1. 개요', chr(10), '2. 범위', chr(10))
 WHEN doc_id % 17 = 1 THEN concat('a..... 1', chr(10), 'b..... 2', chr(10), 'c..... 3', chr(10)) WHEN doc_id % 19 = 1 THEN concat('매출 30명을', chr(10)) ELSE '' END"""
PAGE_ID = "concat(source, '/d', cast(floor(doc_id / 400) as bigint), '_', doc_id % 400 + 1)"
FILING_ID = "concat('dart/Corp_2023_', lpad(cast(doc_id as string), 14, '0'), '_', CASE WHEN doc_id % 2 = 0 THEN concat('[Company', doc_id % 7, ']') ELSE 'x' END, 'Report_', doc_id % 400 + 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.selectExpr(
        "doc_id AS seq", f"{PAGE_ID} AS id", f"concat({HEAD}, text) AS text",
        "CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS ocr", "doc_id % 4 <> 3 AS has_image", "(doc_id * 37 % 1000) / 100000D AS ink", f"concat(source, '/d', cast(floor(doc_id / 400) as bigint)) AS file",
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.route(pages(spark, sf_dir), LONG)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").selectExpr(f"{PAGE_ID} AS page_id", "concat('caption ', text) AS caption")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages: id, document, route."""
    return routed(spark, sf_dir).select("id", F.col("text").alias("document"), "route", "seq")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by page id: texts meet their ids where they are read."""
    return spread(table(spark, sf_dir, "documents").selectExpr(f"{PAGE_ID} AS page_id", "text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the first documents: a document's id is its vector's."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query, query_vec``: the words of each benchmark item, with a vector of the same number."""
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id AS qid", r"array_join(split(trim(text), '\\s+'), ' ') AS query")
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vec"))
    return items.join(own, "qid")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, gold``: the first document that contains an item's text; null if there is none."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    return E.first_containing(documents(spark, sf_dir), items)


def grades(spark: SparkSession, sf_dir: str, pooled: DataFrame) -> DataFrame:
    """``qid, doc_id, grade`` of pooled pages: 2 if good and not toxic, null if unlabelled."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.expr("2 * quality * (1 - toxic)")).alias("grade"))
    return pooled.select("qid", "doc_id").distinct().join(labels, "doc_id", "left")


def wide(df: DataFrame) -> DataFrame:
    """Integer columns as bigint."""
    return df.select(*(F.col(f"`{n}`").cast("bigint").alias(n) if k in ("int", "smallint") else F.col(f"`{n}`") for n, k in df.dtypes))


#: Texts here are longer than those of scanned pages, so longer ones count as too short.
LONG = Params(min_text_chars=1500, min_ocr_chars=1000)
FILTERED = Params(filter_no_content=True)
