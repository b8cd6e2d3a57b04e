import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators import index as I
from paperloom.operators import models as M
from paperloom.sources import readers, writers
from paperloom.streaming import latency


def test_pages(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [("b", None, "o", (bytearray(b"png"), "p")), ("a", "t", None, None)]
    spark.createDataFrame(rows, "id string, text string, ocr string, image struct<bytes: binary, path: string>").write.parquet(path)
    assert [tuple(r) for r in readers.pages(spark, path).orderBy("id").collect()] == [("a", "t", ""), ("b", "", "o")]
    assert readers.pages(spark, path, limit=1).count() == 1 and readers.count_pages(spark, path) == 2
    assert [r.image for r in readers.pages(spark, path, with_image=True).orderBy("id").collect()] == [None, b"png"]
    plan = readers.pages(spark, path)._jdf.queryExecution().toString()
    assert "image" not in plan.split("ReadSchema")[-1]


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-one\ftwo")
    (tmp_path / "in/b.PDF").write_bytes(b"not a pdf")
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-broken")
    files = readers.pdf_files(spark, str(tmp_path))
    assert files.count() == 2

    def reader(content):
        if b"broken" in content:
            raise ValueError
        return [(part.decode(), "") for part in content[5:].split(b"\f")]

    got = readers.pdf_pages(files, reader, "dart/").orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [("dart/a_1", "one"), ("dart/a_2", "two")]


def test_logs(spark, tmp_path):
    log = str(tmp_path / "captions")
    rows = lambda *r: spark.createDataFrame(r, "page_id string, caption string, elapsed_sec double")
    writers.append_captions(rows(("a", "one", 1.234), ("b", "", 1.0)), log)
    writers.append_captions(rows(("c", "three", 2.0)), log)
    assert {r.page_id: r.caption for r in readers.captions(spark, log).collect()} == {"a": "one", "c": "three"}
    manifest = str(tmp_path / "m.json")
    with open(manifest, "w") as f:
        f.write('{"url":"u","report_nm":"old","fetched":"2026-01-01","sha256":"a"}\n{"url":"u","report_nm":"new","fetched":"2026-02-01","sha256":"b"}\n')
    assert [r.report_nm for r in readers.manifest(spark, manifest).collect()] == ["new"]
    out = str(tmp_path / "report")
    writers.report(spark.createDataFrame([("한", 1)], "name string, n int"), out)
    assert spark.read.text(out).first().value == '{"name":"한","n":1}'
    postings = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0)], "doc_id long, term string, weight double")
    writers.postings(postings, str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.store(postings, str(tmp_path / "s"))
    writers.sections(postings, str(tmp_path / "j"))


def test_models(spark):
    df = spark.createDataFrame([("ＡＢ１",), (None,)], "x string")
    assert [r.y for r in df.select(M.nfkc("x").alias("y")).collect()] == ["AB1", None]
    dark = spark.createDataFrame([([1.0] * 256,), ([0.0] * 256,)], "h array<double>")
    assert [r.d for r in dark.select(M.dark_share(F.col("h")).alias("d")).collect()] == [200 / 256, 0.0]
    pixels = spark.createDataFrame([(bytearray([0, 255]),), (None,)], "b binary")
    assert [r.d for r in pixels.select(M.ink("b").alias("d")).collect()] == [0.5, 0.0]

    def captioner():
        def run(content):
            if content == b"bad":
                raise ValueError("no image")
            return "caption"

        return run

    images = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "page_id string, content binary")
    got = {r.page_id: (r.caption, r.error) for r in M.caption(images, captioner, wait=0).collect()}
    assert got == {"a": ("caption", None), "b": ("", "no image")}
    vectors = df.select(M.embedder(lambda: lambda texts: [[3.0, 4.0]] * len(texts))("x").alias("v")).collect()
    assert [round(x, 4) for x in vectors[0].v] == [0.6, 0.8]
    prompts = spark.createDataFrame([(1, "q", ["i.png"]), (2, "r", None)], "qid long, prompt string, images array<string>")
    answers = {r.qid: (r.answer, r.retried, r.degenerate) for r in M.answer(prompts, lambda: lambda p, i: "@" * 31 if p == "r" else "fine answer").collect()}
    assert answers == {1: ("fine answer", False, False), 2: (None, True, True)}
    assert isinstance(pd.Series([1]), pd.Series)


def test_answer_flow(spark):
    class Model:
        def __init__(self):
            self.restarts, self.seen = 0, []

        def __call__(self, prompt, images):
            return f"answer {len(images)} {self.restarts}" if "bad" not in prompt or self.restarts else "@" * 40

        def restart(self):
            self.restarts += 1

    queries = spark.createDataFrame([(1, "ｗｈｏ"), (2, "bad"), (3, "none")], "qid long, query string")
    packed = spark.createDataFrame([(1, "ctx ﬁ", ["a", "b", "c"], ["s"]), (2, "c", None, ["s"])], "qid long, context string, images array<string>, sources array<string>")
    asked = M.prompts(packed, queries)
    got = {r.qid: r for r in asked.collect()}
    assert got[1].prompt == "질문: who\n\n참고 문서:\nctx fi" and got[3].prompt is None and got[3].sources == []
    out = {r.qid: (r.answer, r.retried, r.error) for r in M.answer(asked.coalesce(1), Model).collect()}
    assert out[1][0].startswith("answer 2") and out[2] == ("answer 0 1", True, None) and out[3] == ("문서에서 찾을 수 없습니다.", False, None)
    always = spark.createDataFrame([(1, "x", None)], "qid long, prompt string, images array<string>")
    with pytest.raises(Exception, match="degenerate"):
        M.answer(always, lambda: lambda p, i: "ab" * 30, strict=True).collect()
    assert M.health(lambda: 1) and not M.health(lambda: 1 / 0)


def test_index_run(spark, tmp_path):
    pages = spark.createDataFrame(
        [("f/a_1", "제 1 장 개요\n" + "본문 " * 60, "", False, 0.0, 1), ("f/a_2", "매출 표 " * 40, "", False, 0.0, 2), ("f/a_3", "", "", True, 0.5, 3), ("f/a_4", "", "", False, 0.0, 4)],
        "id string, text string, ocr string, has_image boolean, ink double, seq int",
    )
    captions = spark.createDataFrame([], "page_id string, caption string")
    embed = M.embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    path = str(tmp_path / "index")
    report = I.run(spark, pages, captions, embed, path, partitions=2).first()
    assert (report.total, report.text_route, report.image_route, report.chunks, report.failed) == (4, 2, 1, 2, 1)
    index = I.load(spark, path)
    assert len(index) == 2 and index.postings.count() > 3 and index.sections.count() == 2
    queries = spark.createDataFrame([(1, "매출", [1.0, 0.0])], "qid long, query string, query_vec array<double>")
    assert [r.page_id for r in I.search(index, queries).orderBy("rank").collect()][0] in ("f/a_1", "f/a_2")
    shutil.rmtree(f"{path}/postings")
    shutil.rmtree(f"{path}/sections")
    bare = I.load(spark, path)
    assert bare.postings is None and bare.sections.count() == 0 and I.search(bare, queries).count() == 2


def test_manifest_keeps_the_last_line(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda *r: spark.createDataFrame(r, "url string, rcept_no string, report_nm string, fetched string, sha256 string").coalesce(1)
    file = tmp_path / "one.json"
    file.write_text('{"url":"u","rcept_no":"1","report_nm":"first","fetched":"2026-03-01","sha256":"z"}\n{"url":"u","rcept_no":"1","report_nm":"last","fetched":"2026-01-01","sha256":"a"}\n')
    got = readers.manifest(spark, str(file)).collect()
    assert [(r.url, r.report_nm) for r in got] == [("u", "last")]
    assert [(r.rcept_no, r.report_nm) for r in readers.manifest(spark, str(file), "rcept_no").collect()] == [("1", "last")]
    writers.append_manifest(rows(("v", "2", "new", "2026-01-01", "b")), path)
    writers.append_manifest(rows(("w", "3", "newer", "2026-01-01", "b")), path)
    assert readers.manifest(spark, path).count() == 2


def test_filings_and_dates(spark):
    listed = spark.createDataFrame([("a", "2023-01-01"), ("a", "2023-06-30"), ("a", "2023-07-01"), ("b", "2023-02-01")], "corp string, filed string").withColumn("filed", F.to_date("filed"))
    wanted = spark.createDataFrame([("a", 2022), ("c", 2022)], "corp string, year int")
    assert sorted(str(r.filed) for r in readers.in_window(listed, wanted).collect()) == ["2023-01-01", "2023-06-30"]
    days = spark.createDataFrame([("20230315000123",), ("20231315000123",), (None,)], "r string")
    assert [str(r.d) for r in days.select(readers.receipt_date(F.col("r")).alias("d")).collect()] == ["2023-03-15", "None", "None"]


def test_tables_follow_the_text(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1 b")
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1 a")
    assert [r.path.rsplit("/", 1)[1] for r in readers.pdf_list(spark, str(tmp_path)).collect()] == ["a.PDF", "b.pdf"]
    found = readers.pdf_pages(readers.pdf_files(spark, str(tmp_path)), lambda content: [("text", "", ["| a |", " ", "| b |"]), ("plain", "ocr")])
    got = {r.id: r.text for r in found.collect()}
    assert got["a_1"] == "text\n\n[표 구조]\n| a |\n\n| b |" and got["a_2"] == "plain"


def test_images_are_written_once(spark, tmp_path):
    def write(path, content):
        try:
            with open(path, "xb") as f:
                f.write(content)
            return True
        except FileExistsError:
            return False

    rows = spark.createDataFrame([("a.png", bytearray(b"1")), ("b.png", bytearray(b"2"))], "name string, content binary")
    assert {r.name: r.written for r in writers.images(rows, str(tmp_path), write).collect()} == {"a.png": True, "b.png": True}
    assert not any(r.written for r in writers.images(rows, str(tmp_path), write).collect())


def test_window_percentiles_of_a_stream(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    exact = {(r.window_start, r.event_type): (r.n, r.p50, r.p95) for r in latency.window_percentiles(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    q = latency.window_percentiles(stream).writeStream.format("memory").queryName("percentiles").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.event_type): (r.n, r.p50, r.p95) for r in spark.table("percentiles").collect()}
    assert set(got) == set(exact) and all(got[k][0] == exact[k][0] for k in got)


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet")
    batch = {tuple(r) for r in latency.windowed(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/events.parque[t]")
    q = latency.windowed(stream).writeStream.format("memory").queryName("latency").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("latency").collect()} == batch


def test_stop_phrases(spark):
    from paperloom.operators.evaluate import usable_queries

    df = spark.createDataFrame([("이 표는 무엇인가",), ("  ",), ("매출은 얼마인가",)], "query string")
    assert [r.query for r in usable_queries(df, readers.STOP_PHRASES).collect()] == ["매출은 얼마인가"]
