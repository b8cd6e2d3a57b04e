"""Stored tables that are merged, resumed or read from their start."""

import os
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluate as E
from paperloom.operators import models as M
from paperloom.sources import readers
from paperloom.streaming import latency


def test_grades_are_merged_where_they_lie(spark, tmp_path):
    path = str(tmp_path / "grades")
    pool = lambda *rows: spark.createDataFrame(rows, "qid long, doc_id long")
    E.upsert_grades(spark, path, pool((1, 10), (1, 11), (2, 20)), "doc_id", parts=8)
    E.set_grades(spark, path, spark.createDataFrame([(1, 10, 2), (2, 20, 1), (2, 99, 1), (1, 11, None)], "qid long, doc_id long, grade int"), "doc_id", parts=8)
    files = lambda: {str(p): os.stat(p).st_mtime_ns for p in (tmp_path / "grades").rglob("*.parquet")}
    part = {r.qid: r.part for r in spark.read.parquet(path).collect()}
    before = files()
    E.upsert_grades(spark, path, pool((1, 10), (1, 12), (1, 12)), "doc_id", parts=8)
    rows = lambda: sorted((r.qid, r.doc_id, r.grade) for r in spark.read.parquet(path).collect())
    assert rows() == [(1, 10, 2), (1, 11, None), (1, 12, None), (2, 20, 1)]
    assert part[1] != part[2] and {k: v for k, v in files().items() if f"part={part[2]}/" in k} == {k: v for k, v in before.items() if f"part={part[2]}/" in k}
    E.upsert_grades(spark, path, pool((1, 10), (1, 12), (1, 12)), "doc_id", parts=8)
    assert len(rows()) == 4


def test_a_failed_merge_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "grades")
    E.upsert_grades(spark, path, spark.createDataFrame([(1, 10)], "qid long, doc_id long"), "doc_id")
    bad = spark.createDataFrame([(1, 11)], "qid long, doc_id long").withColumn("doc_id", F.expr("assert_true(qid < 0)").isNull().cast("long") + F.col("doc_id"))
    with pytest.raises(Exception, match="is not true"):
        E.upsert_grades(spark, path, bad, "doc_id")
    assert [(r.qid, r.doc_id) for r in spark.read.parquet(path).collect()] == [(1, 10)]


def test_captions_go_on_where_they_stopped(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    os.mkdir(calls)
    pages = spark.createDataFrame([(f"p{i}", "image" if i < 6 else "text", bytearray(b"%d" % i)) for i in range(8)], "id string, route string, image binary")

    def load():
        def model(content):
            open(f"{calls}/{content.decode()}-{time.time_ns()}", "w").close()
            if content == b"3" and not os.path.exists(f"{calls}/up"):
                raise RuntimeError("down")
            return f"caption {content.decode()}"

        return model

    report = M.caption_missing(spark, pages, log, load, parts=2, retries=0).first()
    assert (report.captioned, report.failed) == (5, 1)
    open(f"{calls}/up", "w").close()
    first = len(os.listdir(calls)) - 1
    report = M.caption_missing(spark, pages, log, load, parts=2, retries=0).first()
    assert (report.captioned, report.failed) == (1, 0) and first == 6 and len(os.listdir(calls)) == 8  # one call more
    assert M.caption_missing(spark, pages, log, load, parts=2).first().captioned == 0
    assert {r.page_id: r.caption for r in readers.captions(spark, log).collect()} == {f"p{i}": f"caption {i}" for i in range(6)}


def test_first_rows_in_scan_order(spark, tmp_path):
    for n, (a, b) in enumerate([(900, 950), (0, 500), (700, 800)]):
        spark.range(a, b, 1, 1).selectExpr("id", "cast(id AS string) AS text").write.option("parquet.block.size", 1024).parquet(str(tmp_path / f"in/{n}"))
    order = [*range(900, 950), *range(0, 500), *range(700, 800)]
    df = spark.read.parquet(*(str(tmp_path / f"in/{n}") for n in range(3)))
    for n in (0, 1, 50, 51, 550, 640, 10_000):
        assert sorted(r.id for r in readers.head(df, n).collect()) == sorted(order[:n])
    few = readers.head(df, 40)
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == 1  # later files aren't opened


def test_exact_windows_of_a_stream_across_a_restart(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = lambda a, b: spark.range(a, b).selectExpr("timestamp_seconds(id * 60) AS ts", "concat('k', id % 2) AS event_type", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 97 = 5 THEN 1e9D ELSE cast(id * 7919 % 50 AS double) END AS value")
    schema = rows(0, 1).schema

    def run():
        latency.append_value_counts(spark.readStream.schema(schema).parquet(source), out, mark).awaitTermination()
        return latency.percentiles_of_counts(spark.read.parquet(out))

    rows(0, 2000).coalesce(1).write.mode("append").parquet(source)
    run()
    rows(2000, 4000).coalesce(1).write.mode("append").parquet(source)
    run()
    rows(10_000, 10_001).coalesce(1).write.mode("append").parquet(source)  # much later: all windows before close
    got = {tuple(r) for r in run().collect()}
    assert got == {tuple(r) for r in latency.window_percentiles(rows(0, 4000)).collect()} and len(got) > 100
    assert {tuple(r) for r in run().collect()} == got  # nothing new, nothing twice
