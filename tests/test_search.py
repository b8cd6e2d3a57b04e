import random
import math

import numpy as np
import pytest

from paperloom.operators import evaluate as E
from paperloom.operators import search as R
from paperloom.params import Params


def docs(spark):
    return spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "durian"), (4, None)], "doc_id long, text string")


def test_bm25_weights(spark):
    got = {(r.doc_id, r.term): r.weight for r in R.postings(docs(spark)).collect()}
    avg = 6 / 4
    w = lambda tf, df, dl: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[1, "apple"] == pytest.approx(w(2, 1, 3)) and got[2, "banana"] == pytest.approx(w(1, 2, 2))
    terms = spark.createDataFrame([("banana",)], "term string")
    some = {(r.doc_id, r.term): r.weight for r in R.postings(docs(spark), terms=terms).collect()}
    assert some == {k: pytest.approx(v) for k, v in got.items() if k[1] == "banana"}


def test_lexical_top(spark):
    q = spark.createDataFrame([(1, "banana banana unknown"), (2, "zzz"), (3, "")], "qid long, query string")
    got = [(r.qid, r.doc_id, r["rank"]) for r in R.lexical_top(docs(spark), q, 5).orderBy("qid", "rank").collect()]
    assert [g[:2] for g in got] == [(1, 2), (1, 1)]
    assert R.lexical_top(docs(spark).limit(0), q, 5).count() == 0 and R.lexical_top(docs(spark), q, 0).count() == 0


@pytest.mark.parametrize("block", [2, 2000])
def test_dense_top(spark, monkeypatch, block):
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((300, 8)).astype(np.float32), rng.standard_normal((5, 8)).astype(np.float32)
    x[7] = x[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<float>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, query_vec array<float>")
    real = R.blocks
    monkeypatch.setattr(R, "blocks", lambda s, *a: real(s, "qid", block))
    got = {(r.qid, r["rank"]): (r.vec_id, r.score) for r in R.dense_top(vectors, asked, 10).collect()}
    scores = np.round(q.astype(float) @ x.astype(float).T, 6)
    for i in range(5):
        order = sorted(range(300), key=lambda j: (-scores[i, j], j))[:10]
        assert [got[i, n + 1][0] for n in range(10)] == order
    assert len(got) == 50


def ranked(spark, *rows):
    return spark.createDataFrame(list(rows), "qid long, id string, score double, rank int")


def test_fusion(spark):
    dense = ranked(spark, (1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3))
    lexical = ranked(spark, (1, "c", 5.0, 1), (1, "d", 4.0, 2), (2, "x", 1.0, 1))
    order = lambda df: [(r.id, r["rank"]) for r in df.orderBy("qid", "rank").collect()]
    assert order(R.fuse(dense, lexical, "id", 10)) == [("c", 1), ("a", 2), ("b", 3), ("d", 4)]  # b before d: equal scores, dense first
    assert order(R.fuse(dense, None, "id", 2)) == [("a", 1), ("b", 2)]
    barred = spark.createDataFrame([("a",)], "id string")
    got = {r.id: r.score for r in R.fuse(dense, lexical, "id", 10, barred=barred).collect()}
    assert got["b"] == pytest.approx(1 / 62) and "a" not in got  # ranks don't close up


def test_filtered_search_widens(spark):
    d = spark.createDataFrame([(i, f"w{i} common") for i in range(12)], "doc_id long, text string")
    v = spark.createDataFrame([(i, [1.0 - i / 100, 0.0]) for i in range(12)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, "nothing", [1.0, 0.0])], "qid long, query string, query_vec array<float>")
    barred = spark.createDataFrame([(0,), (1,)], "doc_id long")
    p = Params(top_k=3, overfetch=3, filter_no_content=True)
    ids = lambda p, b: [r.doc_id for r in R.search(d, v, q, "doc_id", p, b).orderBy("rank").collect()]
    assert ids(p, barred) == [2, 3, 4]
    assert ids(Params(top_k=3), barred) == [0, 1, 2]
    assert ids(p, spark.createDataFrame([(11,)], "doc_id long")) == [0, 1, 2]


def test_rerank_keeps_order_of_ties(spark):
    c = spark.createDataFrame([(1, "a", "x y", "x", 1), (1, "b", "x y", "x y", 2), (1, "c", "x y", "y", 3)], "qid long, id string, query string, text string, rank int")
    assert [(r.id, r.score) for r in R.rerank(c, "id", p=Params(top_n=3)).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.5), ("c", 0.5)]


def test_neighbors(spark):
    sections = spark.createDataFrame([("a_1", False, "a_2"), ("a_2", False, "a_3"), ("a_3", True, None), ("b_1", False, "b_2"), ("c_1", False, "c_2")], "id string, no_content boolean, next_id string")
    chunk_ids = spark.createDataFrame([("a_1",), ("a_2",), ("a_3",), ("b_1",), ("b_2",), ("c_1",)], "page_id string")
    rows = spark.createDataFrame([(1, "a_1", 1), (2, "a_2", 1), (3, "a_3", 1), (4, "b_1", 1), (4, "b_2", 2), (5, "c_1", 1), (6, "b_1", 1), (7, "z", 1)], "qid long, page_id string, rank int")
    got = {r.qid: r.page_id for r in R.add_neighbor(rows, sections, chunk_ids).collect()}
    assert got == {1: "a_2", 6: "b_2"}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 3, "a"), (3, None, "b"), (4, 10, "b"), (5, 11, "b")], "qid long, rank int, kind string")
    got = {(r.grouping, r.kind): r for r in E.metrics_by_group(df, "kind").collect()}
    all_ = got["overall", None]
    assert (all_.recall_1, all_.recall_3, all_.recall_5, all_.recall_10, all_.n) == (0.2, 0.4, 0.4, 0.6, 5)
    assert all_.mrr == pytest.approx((1 + 1 / 3 + 1 / 10 + 1 / 11) / 5, abs=1e-6) and all_.ndcg_3 == pytest.approx(0.3)
    assert got["kind", "a"].n == 2
    assert E.metrics_by_group(df.limit(0), "kind").count() == 0


def test_judging(spark):
    rows = spark.createDataFrame([(1, "s", "a", 1, 1.0), (1, "s", "b", 2, 0.9), (2, "s", "c", 1, 1.0), (3, "s", "d", 1, 1.0), (1, "t", "b", 1, 1.0)], "qid long, system string, id string, rank int, score double")
    grades = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 0), (3, "d", 1)], "qid long, id string, grade int")
    asked = spark.createDataFrame([(1, "x", "t", "b", True), (2, "x", "t", None, True), (3, "x", "t", None, False)], "qid long, corpus string, type string, gold string, expect_answer boolean")
    got = {(r.system, r.bucket): r for r in E.judge_metrics(rows, grades, asked, "id").collect()}
    s = got["s", "all"]
    assert (s.n, s.ndcg, s.recall, s.irrelevant, s.gold_in_top) == (2, 1.0, 0.5, 0.5, 1.0)
    assert got["t", "all"].ndcg == pytest.approx(1 / (2 + 1 / math.log2(3)), abs=1e-6) and ("s", "x/t") in got
    f = E.false_positives(rows, grades, asked, "id").first()
    assert (f.system, f.n, f.false_positives) == ("s", 1, 1)
    pool = {(r.qid, r.id): (r.first_system, r.ranks) for r in E.pool(rows, "id").collect()}
    assert pool[1, "b"] == ("t", {"s": 2, "t": 1})
    merged = {(r.qid, r.id): r.grade for r in E.merge_grades(grades.filter("qid = 1"), E.pool(rows, "id"), "id").collect()}
    assert merged[1, "a"] == 2 and merged[2, "c"] is None


@pytest.mark.parametrize("n, place", [(1, 0), (2, 1), (19, 18), (20, 19), (21, 19), (100, 95)])
def test_percentile_place(spark, n, place):
    df = spark.createDataFrame([(float(i // 2), "k") for i in range(n)] + [(None, "k")], "value double, key string")
    r = E.latency_summary(df, "value", "key").first()
    assert r.n == n and r.p95 == float(place // 2)


def test_percentiles_by_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.5, 0.5, 1e6, rng.expovariate(1), -rng.random()]), rng.choice(["a", "b", None])) for _ in range(500)] + [(7.0, "one"), (3.0, "same"), (3.0, "same"), (None, "none")]
    df = spark.createDataFrame(rows, "v double, k string").repartition(3)
    got = {r.k: (r.n, r.p50, r.p95) for r in E.percentile(df, "v", {"p50": 0.5, "p95": 0.95}, "k").collect()}
    want = {}
    for k in {k for _, k in rows} - {"none"}:
        own = sorted(v for v, x in rows if x == k)
        want[k] = (len(own), *(own[min(int(len(own) * s), len(own) - 1)] for s in (0.5, 0.95)))
    assert got == want
    everyone = sorted(v for v, _ in rows if v is not None)
    r = E.percentile(df, "v", {"p50": 0.5}).first()
    assert (r.n, r.p50) == (len(everyone), everyone[len(everyone) // 2])
    assert tuple(E.percentile(df.limit(0), "v", {"p50": 0.5}).first()) == (None, None) and E.percentile(df.limit(0), "v", {"p50": 0.5}, "k").count() == 0


def test_samples_and_reports(spark):
    qa = spark.createDataFrame([(i, "t%d" % (i % 2), f"q{i}") for i in range(20)], "id long, type string, query string")
    made = spark.createDataFrame([(f"p{i}", f"s{i}") for i in range(20)], "page_id string, query string")
    manual = spark.createDataFrame([("m", False)], "query string, expect_answer boolean")
    out = E.judge_sample(qa, made, manual).orderBy("sample_id").collect()
    assert [r.sample_id for r in out] == ["J%02d" % k for k in range(1, 27)] and [r.source for r in out] == ["qa"] * 10 + ["synthetic"] * 15 + ["manual"]
    log = spark.createDataFrame([("x", 1.0), ("", 9.0), ("y", 3.0), (None, None)], "caption string, elapsed_sec double")
    assert tuple(E.caption_report(log).first()) == (2, 2, 2.0, 3.0)
    assert tuple(E.caption_report(log.filter("caption = ''")).first()) == (0, 1, None, None)
    rows = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.1)], "qid long, score double")
    assert [r.qid for r in E.report_order(rows, "score").collect()] == [3, 2, 1]
    pooled = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "qid long, doc_id long")
    gold = spark.createDataFrame([(1, 6), (2, None)], "qid long, gold long")
    docs = spark.createDataFrame([(5, "x" * 2000)], "doc_id long, text string")
    got = {(r.qid, r.doc_id): (len(r.snippet or ""), r.is_gold) for r in E.pool_entries(pooled, docs, gold, "doc_id").collect()}
    assert got == {(1, 5): (1500, False), (1, 6): (0, True), (2, 5): (1500, False)}


def test_gold_by_inner_words(spark, tmp_path):
    from paperloom.plans import corpus

    items = [(1, "alpha beta gamma"), (2, "lone"), (3, "two words"), (4, None), (5, "absent middle word here"), (6, " a b "), (7, "")]
    docs = [(10, "x alpha beta gammax"), (11, "xalpha beta gamma"), (12, "alone"), (13, "two  words two wordsy"), (14, None), (15, "c a b d"), (9, "alpha beta  gamma")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.qid: r.gold for r in corpus.gold(spark, str(tmp_path)).collect()}
    want = {q: min((d for d, t in docs if x is not None and t is not None and x in t), default=None) for q, x in items}
    assert got == want


def test_logs_and_samples(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("b", 1, None)], "k string, at int, v string")
    assert [tuple(r) for r in E.latest(log, "k", "at", "v").collect()] == [("a", "y")]
    rows = spark.createDataFrame([(i, "s%d" % (i % 2)) for i in range(40)], "id long, s string")
    one = {r.id for r in E.stratified_sample(rows, "s", "id", 5, 1).collect()}
    assert one == {r.id for r in E.stratified_sample(rows.repartition(7), "s", "id", 5, 1).collect()} and len(one) == 10
    assert one != {r.id for r in E.stratified_sample(rows, "s", "id", 5, 2).collect()}
    a = spark.createDataFrame([(1, 1), (2, None), (3, 4), (4, None)], "qid long, rank int")
    b = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, None)], "qid long, rank int")
    assert tuple(E.win_loss(a, b).first()) == (1, 1, 2, 4)
