import random

import numpy as np
import pytest

from paperloom.operators import blocks as B
from paperloom.operators import evaluate as E
from paperloom.operators import index as I
from paperloom.operators import search as R
from paperloom.params import Params


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(2000, None)]  # copies: ties
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(25)] + [(90, "none"), (91, ""), (92, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")


@pytest.mark.parametrize("count,k", [(1, 5), (40, 5), (40, 700), (5000, 3)])
def test_blocks_give_what_postings_give(spark, corpus, tmp_path, count, k):
    docs, asked = corpus
    postings = R.postings(docs)
    B.write(B.blocked(postings, count), str(tmp_path / "blocks"), partitions=3)
    index = B.load(spark, str(tmp_path / "blocks"))
    assert rows(B.search(index, asked, k)) == rows(R.lexical_top(docs, asked, k))
    if (count, k) == (40, 5):
        counts = B.read_counts(index, asked, k).collect()
        assert sum(r.read for r in counts) < 0.7 * sum(r.blocks for r in counts)  # bounds rule blocks out
        assert all(r.read >= min(r.blocks, B.FIRST) for r in counts)
        assert index.agg({"n": "sum"}).first()[0] == postings.count()


def test_bounds_alone_are_read_first(spark, corpus, tmp_path):
    """Blocks are ranked without their lists."""
    docs, asked = corpus
    B.write(B.blocked(R.postings(docs), 40), str(tmp_path / "b"), partitions=2)
    plan = B._ranked(B.load(spark, str(tmp_path / "b")), R.query_terms(asked))._jdf.queryExecution().executedPlan().toString()
    assert "bound" in plan and "weights" not in plan and "ids" not in plan


def test_stored_index_with_blocks_and_filter(spark, corpus, tmp_path):
    docs, asked = corpus
    rng = np.random.default_rng(1)
    paged = docs.selectExpr("concat('b/d_', doc_id) AS page_id", "text")
    store = spark.createDataFrame([(r.page_id, rng.normal(size=4).astype(np.float32).tolist()) for r in paged.collect()], "page_id string, embedding array<float>")
    queries = spark.createDataFrame([(r.qid, r.query, rng.normal(size=4).tolist()) for r in asked.collect()], "qid long, query string, query_vec array<double>")
    sections = spark.createDataFrame([(f"b/d_{i}", i % 2 == 0, "", None, None) for i in range(600)], "id string, no_content boolean, section_title string, prev_id string, next_id string")
    postings = R.postings(paged, "page_id")
    I.write(str(tmp_path / "a"), store, postings, sections, 3)
    I.write(str(tmp_path / "b"), store, None, sections, 3, B.blocked(postings, 30, "page_id"))
    for p in (Params(), Params(filter_no_content=True)):
        a, b = (rows(I.search(I.load(spark, str(tmp_path / x)), queries, p=p)) for x in "ab")
        assert a == b and a
    assert not any(int(r[1][4:]) % 2 == 0 for r in b if int(r[1][4:]) < 600)


@pytest.mark.parametrize("name,held", [("long", 1 << 20), ("string", 7)])
def test_dense_top_is_exact(spark, monkeypatch, name, held):
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    x, q = rng.integers(-2, 3, (300, 6)).astype(float), rng.integers(-2, 3, (70, 6)).astype(float)  # many ties
    ids = [i * 7 % 300 for i in range(300)] if name == "long" else [f"é{i * 7 % 300}" for i in range(300)]
    vectors = [(i, v.tolist()) for i, v in zip(ids, x)] + [(None, x[0].tolist()), (ids[0], None), (ids[1], [1.0, None] * 3), (ids[2], []), (ids[3], [9.0] * 5)]
    frame = spark.createDataFrame(vectors, f"vec_id {name}, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(500, None), (501, [1.0] * 5), (502, [1.0] * 7)], "qid long, query_vec array<double>").repartition(3)
    want = [(i, k, s, r) for i, v in enumerate(q) for r, (s, k) in enumerate(sorted(((-(float(v @ y)), k) for k, y in zip(ids, x)))[:10], 1)]
    got = rows(R.dense_top(frame, asked, 10))
    assert got == sorted([(i, k, -s, r) for i, k, s, r in want] + [(501, ids[3], 45.0, 1)])
    assert R.dense_top(frame.limit(0), asked, 10).count() == 0 and R.dense_top(frame, asked.limit(0), 10).count() == 0


def test_dense_plan_has_one_size(spark):
    """The plan doesn't grow with the queries, and building it runs no job."""
    vectors = spark.range(1000).selectExpr("id AS vec_id", "array(cast(id AS float), 1F) AS embedding")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    sizes = {len(R.dense_top(vectors, spark.range(n).selectExpr("id AS qid", "array(1D, cast(id AS double)) AS query_vec"), 3)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (3, 30_000)}
    assert len(sizes) == 1 and not tracker.getJobIdsForGroup("plans")
    spark.sparkContext.setJobGroup("default", "default")


@pytest.mark.parametrize("values", [
    [0.5], [1.0, 2.0], list(range(20)), [5] * 1000, [1] * 700 + [2] * 300, [float(i % 977) for i in range(20_000)] + [1e9, -1e18], [1e9] + [i / 7 for i in range(9_999)], [float("inf"), 0.0, -1.0] * 50,
])
def test_percentiles_are_exact_whatever_the_spread(spark, values):
    data = [("a", float(v)) for v in values] + [("b", float(-v)) for v in values] + [(None, 3.0), ("a", None)]
    frame = spark.createDataFrame(data, "k string, v double").repartition(6)
    shares = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r.k: r for r in E.percentile(frame, "v", shares, "k").collect()}
    for k, own in (("a", sorted(map(float, values))), ("b", sorted(-float(v) for v in values)), (None, [3.0])):
        n = len(own)
        assert (got[k].n, *(got[k][s] for s in shares)) == (n, *(own[min(int(n * s), n - 1)] for s in shares.values()))
    whole = E.percentile(frame, "v", shares).collect()
    every = sorted(v for _, v in data if v is not None)
    assert [whole[0][s] for s in shares] == [every[min(int(len(every) * s), len(every) - 1)] for s in shares.values()]


def test_few_values_are_sorted_beside_an_outlier(spark):
    n = 200_000
    frame = spark.range(n).selectExpr("cast(id * 7919 % 100003 AS double) AS v").union(spark.range(1).selectExpr("1e9D AS v"))
    for r in E.brackets(frame, "v", {"p50": 0.5, "p95": 0.95}).collect():
        assert frame.filter(frame.v.between(r._low, r._high)).count() < n / 100
