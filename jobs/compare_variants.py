"""Compare two ways to index pages: their text alone, and with document and section names as a first line.

    python -m jobs.compare_variants --documents PATH --questions PATH --output PATH [--config FILE]

For each variant the best pages of every question are written (``ranked``, partitioned by variant), then
the ranking metrics of both, over all questions and by type, and how many questions the second variant wins and loses
against the first (``report``, partitioned by variant). A question's gold page is the first that contains its
text (``gold``). A run replaces the partitions of its variants, so running again gives the same output.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from paperloom.operators import evaluate as E
from paperloom.operators import pages as P
from paperloom.operators import search as R

log = logging.getLogger("compare_variants")
DEFAULTS = {
    "id": "doc_id", "text": "text", "question_id": "item_id", "question": "text", "type": "concat('t', qid % 3)", "top_k": 10,
    "page_id": "concat(source, '/d', cast(floor(doc_id / 400) as bigint), '_', doc_id % 400 + 1)",
}
FIRST, SECOND = "plain", "headed"


def variants(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_id, document) as ``doc_id, text, variant``: the text, which both variants have (null), and the first line
    of the second. Names travel without texts."""
    sections = P.section_map(pages.select(F.col("page_id").alias("id"), "document", F.lit("text").alias("route")))
    named = sections.groupBy(F.col("id").alias("page_id")).agg(F.max("section_title").alias("section_title"))
    titled = pages.select("doc_id", "page_id").join(named, "page_id", "left")
    filings = pages.sparkSession.range(0).select(F.lit("").alias("rcept_no"), F.lit("").alias("report_nm"))
    head = P.lexical_text(P.with_prefix(titled, filings).withColumn("document", F.lit("")))
    return pages.select("doc_id", F.col("document").alias("text"), F.lit(None).cast("string").alias("variant")).unionByName(head.select("doc_id", F.col("lexical_text").alias("text"), F.lit(SECOND).alias("variant")))


def _replace(rows: DataFrame, path: str) -> None:
    written = Observation()
    watched = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(path)
    log.info("wrote %d rows to %s", written.get["rows"], path)


def run(spark: SparkSession, documents: str, questions: str, output: str, config: dict | None = None) -> None:
    """Write ranked pages and the report of both variants below ``output``."""
    c = DEFAULTS | (config or {})
    given, asked = spark.read.parquet(documents), spark.read.parquet(questions)
    log.info("reading %s and %s", documents, questions)
    pages = given.select(F.col(c["id"]).alias("doc_id"), F.expr(c["page_id"]).alias("page_id"), F.coalesce(F.col(c["text"]), F.lit("")).alias("document"))
    items = asked.select(F.col(c["question_id"]).alias("qid"), F.col(c["question"]).alias("query")).filter("query IS NOT NULL")
    for name, best in R.lexical_tops(variants(pages), items, c["top_k"], [FIRST, SECOND]).items():
        _replace(best.withColumn("variant", F.lit(name)), f"{output}/ranked")
    ranked = spark.read.parquet(f"{output}/ranked")
    found = E.first_containing(pages.select("doc_id", F.col("document").alias("text")), items.select("qid", F.col("query").alias("item")))
    found.filter("gold IS NOT NULL").withColumn("type", F.expr(c["type"])).write.mode("overwrite").parquet(f"{output}/gold")
    gold = spark.read.parquet(f"{output}/gold")
    ranks = {n: E.gold_ranks(gold, ranked.filter(F.col("variant") == n), "doc_id") for n in (FIRST, SECOND)}
    reports = []
    for name, rows in ranks.items():
        metrics = E.metrics_by_group(rows, "type").drop("grouping")
        reports.append(long(metrics, "type").withColumn("variant", F.lit(name)))
    against = E.win_loss(ranks[SECOND], ranks[FIRST]).drop("n").withColumn("type", F.lit(None).cast("string"))
    reports.append(long(against, "type").withColumn("variant", F.lit(SECOND)))
    _replace(R.union(reports), f"{output}/report")


def long(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each metric: the keys, ``metric``, ``value``."""
    names = [n for n in rows.columns if n not in keys]
    return rows.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(list(keys), names, "metric", "value")


def result(spark: SparkSession, output: str) -> DataFrame:
    """Ranked pages and report in one table."""
    ranked, report = spark.read.parquet(f"{output}/ranked"), spark.read.parquet(f"{output}/report")
    return ranked.select("variant", "qid", "doc_id", "score", "rank").unionByName(report.select("variant", "type", "metric", "value"), allowMissingColumns=True)


if __name__ == "__main__":
    main(run, "compare_variants", "documents", "questions", "output", defaults=DEFAULTS)
