import base64

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.text import CUT_MARK
from paperloom.operators import context as C
from paperloom.operators import pages as P
from paperloom.params import Params

PAGE = "id string, text string, ocr string, has_image boolean, ink double, seq long"


def test_routes(spark):
    rows = [("a", "t" * 120, "", True, 0.5), ("b", "t", "o" * 120, True, 0.5), ("c", "", "", True, 0.5), ("d", "", "", True, 0.0), ("e", None, None, False, 0.5), ("f", "t" * 99, "", True, 0.5), ("g", "t" * 100, "", False, 0.0), ("h", "　" + "t" * 99, "", False, 0.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], PAGE)
    got = P.route(df)
    assert [r.route for r in got.orderBy("seq").collect()] == ["text", "ocr", "image", "blank", "blank", "image", "text", "blank"]
    s = P.route_stats(got).first()
    assert (s.total, s.text_route, s.ocr_route, s.image_route, s.blank_skipped, s.image_overflow_route) == (8, 2, 1, 2, 3, 0)


def test_cap_keeps_the_first(spark):
    df = spark.createDataFrame([(i, "image" if i != 2 else "text") for i in range(5)], "seq long, route string")
    routes = lambda cap: [r.route for r in P.cap_images(df, cap).orderBy("seq").collect()]
    assert routes(1) == ["image", "image_overflow", "text", "image_overflow", "image_overflow"]
    assert routes(0) == ["image_overflow", "image_overflow", "text", "image_overflow", "image_overflow"]
    assert routes(9) == ["image", "image", "text", "image", "image"]


def test_chunk_texts(spark):
    rows = [("a", "t", "ocr", "image"), ("b", "t", "ocr", "image"), ("c", "", "", "image"), ("d", "t", "  ", "image"), ("e", "t", "", "blank"), ("f", "t", "o", "text"), ("g", "t", "o", "image_overflow"), ("h", " ", "", "text"), ("i", "t", "o", "ocr")]
    df = spark.createDataFrame(rows, "id string, text string, ocr string, route string")
    captions = spark.createDataFrame([("a", "cap"), ("c", "cap"), ("d", "cap")], "page_id string, caption string")
    got = {r.page_id: (r.text_for_embedding, r.image_path) for r in P.chunks(df, captions).collect()}
    assert got == {"a": ("cap\nocr", "a.png"), "b": ("ocr", "b.png"), "c": ("cap", "c.png"), "d": ("cap", "d.png"), "f": ("t", None), "g": ("o", None), "i": ("o", "i.png")}


def test_section_map(spark):
    rows = [("d_1", "제 1 장 서론\n" + "x" * 300, "text"), ("d_2", "본문 " * 90, "text"), ("d_10", "제 2 장 결론\n" + "x" * 300, "text"), ("e_3", "표지", "image"), ("nonumber", "x", "text")]
    df = spark.createDataFrame(rows, "id string, document string, route string")
    out = P.section_map(df)
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert got == {"d_1": (False, "제 1 장 서론", None, "d_2"), "d_2": (False, "제 1 장 서론", "d_1", "d_10"), "d_10": (False, "제 2 장 결론", "d_2", None), "e_3": (True, "", None, None)}
    s = P.section_stats(df, out).first()
    assert (s.pages, s.image_pages, s.no_content_pages, s.no_content_image_pages, s.titled_pages) == (5, 1, 1, 1, 3)
    assert (s.no_content_share, s.no_content_image_share) == (0.2, 1.0)
    assert P.section_stats(df.limit(0), out.limit(0)).first().no_content_share == 0.0


def test_lexical_text(spark):
    df = spark.createDataFrame([("p", "s", "d"), ("p", None, "d"), ("", "", "d")], "prefix string, section_title string, document string")
    assert [r.lexical_text for r in P.lexical_text(df).collect()] == ["p s\nd", "p\nd", "d"]


def test_sparse_stats(spark):
    df = spark.createDataFrame([("a", "x" * 200), ("a", "x"), ("b", None)], "file string, text string")
    assert {(r.file, r.pages, r.sparse_pages) for r in P.sparse_stats(df).collect()} == {("a", 2, 1), ("b", 1, 1), (None, 3, 2)}


def test_budget(spark):
    assert [r.b for r in spark.range(4).select(C.text_budget(F.col("id").cast("int")).alias("b")).collect()] == [5094, 2844, 594, 300]


def test_packing(spark):
    p = Params()
    rows = [(1, 1, "a" * 3000, "A", None), (1, 2, "b" * 2000, "B", None), (1, 3, "c" * 3000, "C", None), (1, 4, "d", "D", None), (2, 1, "shown", "E", "e.png"), (2, 2, "text", "F", None)]
    df = spark.createDataFrame(rows, "qid long, rank int, text string, source_file string, image_path string")
    got = {r.qid: r for r in C.pack(df, C.choose_images(df), p).collect()}
    parts = got[1].context.split("\n\n")
    assert parts[0] == "[출처: A]\n" + "a" * 2500 + CUT_MARK and parts[1] == "[출처: B]\n" + "b" * 2000
    left = 5094 - 2506 - 2000
    assert parts[2] == "[출처: C]\n" + "c" * left + CUT_MARK and len(parts) == 3 and got[1].budget_left == -len(CUT_MARK)
    assert got[2].context == "[출처: F]\ntext" and got[2].sources == ["E", "F"] and got[1].sources == ["A", "B", "C", "D"]


def test_images_are_capped(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (2, 2, None)], "qid long, rank int, image_path string")
    neighbors = spark.createDataFrame([(1, "n"), (2, "n")], "qid long, image_path string")
    assert {r.qid: r.images for r in C.choose_images(df, neighbors).collect()} == {1: ["a", "b", "n"], 2: ["x", "n"]}
    assert {r.qid: r.images for r in C.choose_images(df).collect()} == {1: ["a", "b"], 2: ["x"]}
    same = spark.createDataFrame([(1, "b"), (3, "only")], "qid long, image_path string")
    assert {r.qid: r.images for r in C.choose_images(df, same).collect()} == {1: ["a", "b"], 2: ["x"], 3: ["only"]}


def test_neighbor_comes_last(spark):
    ranked = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (2, 1, "r")], "qid long, rank int, page_id string")
    following = spark.createDataFrame([(1, "n")], "qid long, page_id string")
    assert {tuple(r) for r in C.with_neighbor(ranked, following).collect()} == {(1, 1, "p"), (1, 2, "q"), (1, 3, "n"), (2, 1, "r")}


def test_cap_is_strict_on_ties(spark):
    df = spark.createDataFrame([(7, f"p{k}", "image") for k in range(5)] + [(7, "t", "text")], "seq int, id string, route string")
    got = {r.id: r.route for r in P.cap_images(df, 2).collect()}
    assert got == {"p0": "image", "p1": "image", "p2": "image_overflow", "p3": "image_overflow", "p4": "image_overflow", "t": "text"}


def test_long_page_numbers(spark):
    ids = ["dart/a_20230315000123", "dart/a_9", "dart/a_" + "9" * 50, "dart/a_0010", "dart/b"]
    df = spark.createDataFrame([(i, "1. Intro" if i == "dart/a_9" else "text", "text") for i in ids], "id string, document string, route string")
    got = {r.id: r for r in P.section_map(df).collect()}
    assert len(got) == 4 and got["dart/a_9"].next_id == "dart/a_0010" and got["dart/a_0010"].next_id == "dart/a_20230315000123"
    assert got["dart/a_20230315000123"].next_id == "dart/a_" + "9" * 50 and {r.section_title for r in got.values()} == {"1. Intro"}
    assert [str(r.n) for r in df.select(X.page_no(F.col("id")).alias("n")).collect()] == ["20230315000123", "9", "None", "10", "None"]


def test_variants_and_urls(spark):
    rows = spark.createDataFrame([("a", "image", "old a"), ("b", "image", "old b"), ("c", "image", "old c"), ("t", "text", "old t")], "page_id string, route string, document string")
    captions = spark.createDataFrame([("a", " cap "), ("b", ""), ("t", "cap t")], "page_id string, caption string")
    read = spark.createDataFrame([("a", "read a"), ("b", "read b")], "page_id string, text string")
    both = {r.page_id: r.document for r in P.variant_text(rows, captions, read).collect()}
    assert both == {"a": "cap\nread a", "b": "read b", "c": "old c", "t": "old t"}
    assert {r.page_id: r.document for r in P.variant_text(rows, captions).collect()} == {"a": "cap", "b": "old b", "c": "old c", "t": "old t"}
    results = spark.createDataFrame([("a", "x/y/a.png"), ("b", "b.png"), ("c", None)], "page_id string, image_path string")
    there = spark.createDataFrame([("a.png",), ("z.png",)], "name string")
    assert {r.page_id: r.image_url for r in P.with_urls(results, there).collect()} == {"a": "/pages/a.png", "b": None, "c": None}


def test_sizes_and_base64(spark):
    df = spark.createDataFrame([(2480, 3505), (1280, 100), (1, 9000)], "w int, h int")
    assert [tuple(r.s) for r in df.select(X.fitted(F.col("w"), F.col("h")).alias("s")).collect()] == [(906, 1280), (1280, 100), (1, 1280)]
    raw = bytes(range(256)) * 3
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(X.encoded(F.col("b")).alias("x")).first().x == base64.b64encode(raw).decode()


def test_parameters_from_the_environment():
    assert Params.from_environment({"PAPERLOOM_TOP_K": "7", "PAPERLOOM_HYBRID": "false", "PAPERLOOM_B": "0.5", "OTHER": "1"}) == Params(top_k=7, hybrid=False, b=0.5)
