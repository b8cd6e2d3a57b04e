import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import compare_variants
from paperloom.functions import sections as S
from paperloom.functions import text as X
from paperloom.operators import evaluate as E
from paperloom.operators import search as R

TEXTS = ["", " ", "Apple apple2pear 12ab34cd", "제 1 장 사과는 30명을 만났다", "한국에서 abc12 3개월", "Kelvin İstanbul İ9x", "Ünïcode straße word", "a" * 3000, "x\ny\tz", "日本語 text 中文abc"]


def test_counts_are_those_of_tokens(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("aB9 가을는\n.éK", k=rng.randrange(60))) for _ in range(200)]
    words, row, code, n = X.count_tokens([t.encode() for t in texts])
    got = sorted(zip(row.tolist(), words.take(code).to_pylist(), n.tolist()))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = df.select("id", F.explode(X.tokens("text")).alias("t")).groupBy("id", "t").count()
    assert got == sorted((r["id"], r["t"], r["count"]) for r in want.collect())
    assert [len(x) for x in X.count_tokens([])[1:]] == [0, 0, 0]


@pytest.mark.parametrize("asked,docs,size", [(1 << 17, 2048, 1 << 23), (7, 3, 40)])
def test_variants_are_indexes_of_their_own(spark, monkeypatch, asked, docs, size):
    for name, value in (("ASKED", asked), ("BLOCK_DOCS", docs), ("TEXT_BYTES", size)):
        monkeypatch.setattr(R, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i % 50 if i % 7 else None, " ".join(rng.choices(words, k=rng.randrange(12))) or None, (None, "b")[i % 3 == 0]) for i in range(150)]
    parts = spark.createDataFrame(rows, "doc_id long, text string, variant string").repartition(3)
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(20)] + [(90, "none")], "qid long, query string")
    got = R.lexical_tops(parts, items, 8, ["a", "b"])
    for name, own in (("a", parts.filter("variant IS NULL")), ("b", parts)):
        ids = parts.select("doc_id").distinct()  # a document without a text in a variant is empty there
        whole = own.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
        whole = ids.join(whole, ids.doc_id.eqNullSafe(whole.doc_id), "left").select(ids.doc_id, "text")
        joined = R.postings(whole).join(R.query_terms(items), "term").groupBy("qid", "doc_id").agg(F.sum("weight").alias("score"))
        want = R.top(joined, 8, "doc_id").select("qid", "doc_id", "score", "rank")
        order = lambda df: sorted(map(repr, df.collect()))
        assert order(got[name]) == order(want)


def test_texts_are_shuffled_once_for_both_variants(spark, tmp_path, monkeypatch):
    """Before, each variant dealt all texts anew, and names were joined to texts."""
    seen = []
    real = R.asked_counts
    monkeypatch.setattr(R, "asked_counts", lambda parts, *a: seen.append(parts) or real(parts, *a))
    spark.createDataFrame([(i, f"제 {i} 장\nw{i} x", "s") for i in range(9)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, "w3 x")], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    compare_variants.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), str(tmp_path / "out"))
    assert len(seen) == 1 and seen[0].filter("variant IS NULL").count() == 9 and seen[0].filter("variant = 'headed'").count() == 9


def test_section_titles_of_lines_that_are_not_stripped(spark):
    texts = ["  ## 제 1 장 a  \nb", "x\n　# 2. 가나 \t", "a\nb\nc\nd\n제 5 장", "#", "##  PART 3", " IV ) x", "1.2", "\n\n" + "y" * 50 + "\r\n1. abc" + "z" * 100 + " "]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1).orderBy("i").select(S.section_title(F.col("t"))).collect()]
    assert got == ["제 1 장 a", "2. 가나", None, None, "PART 3", "IV ) x", None, "1. abc" + "z" * 54]


def test_items_of_short_and_long_words(spark):
    docs = spark.createDataFrame([(1, "a bb ccc dd e"), (2, "x bb longest-word y"), (3, None), (4, "pre x bb longest-word yz")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a bb ccc"), (2, "x bb longest-word y"), (3, "bb longest-word yz"), (4, "dd e"), (5, "q bb q")], "qid long, item string")
    assert {r.qid: r.gold for r in E.first_containing(docs, items).collect()} == {1: 1, 2: 2, 3: 4, 4: 1, 5: None}
    assert np.isscalar(E.first_containing(docs, items.filter("qid = 4")).count())
