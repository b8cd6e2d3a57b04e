import random
import re

import pytest

from paperloom.operators import blocks as B
from paperloom.operators import growing as G
from paperloom.operators import search as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[3]))


def pairs_shuffled(df):
    """Whether the plan deals rows by query and document at once: then each pair of both that share a term is shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(re.search(r"hashpartitioning\(qid#\d+L?, doc_id", plan))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(200)]
    docs += [(500 + i, docs[i % 5][1]) for i in range(40)] + [(None, "w1 w2"), (900, None)]  # copies: ties; no id; no text
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(90, "none"), (91, "")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "qid long, query string")


@pytest.mark.parametrize("kind,k", [("long", 5), ("string", 7), ("long", 300)])
def test_products_give_what_a_join_gives(spark, monkeypatch, corpus, kind, k):
    for name, size in (("BLOCK_DOCS", 7), ("BLOCK_QUERIES", 4), ("BLOCK_ENTRIES", 40), ("HELD", 30)):
        monkeypatch.setattr(R, name, size)
    docs, asked = corpus
    docs = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    joined = R.postings(docs).join(R.query_terms(asked), "term").groupBy("qid", "doc_id").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "score")
    want = rows(R.top(joined, k, "doc_id").select("qid", "doc_id", "score", "rank"))
    assert want and rows(R.lexical_top(docs, asked, k)) == want and rows(R.stored_top(R.postings(docs), asked, k)) == want
    assert k == 300 or any(len({r[2] for r in want if r[0] == q}) < k for q in range(30))  # ties


def test_no_pair_of_query_and_document_is_shuffled(spark, corpus, tmp_path):
    docs, asked = corpus
    assert not pairs_shuffled(R.lexical_top(docs, asked, 5))
    assert not pairs_shuffled(R.stored_top(R.postings(docs), asked, 5))
    G.write_segment(docs, str(tmp_path / "grown"), 0)
    assert not pairs_shuffled(G.search(G.load(spark, str(tmp_path / "grown")), asked, 5))


def test_counts_are_not_dealt_by_term_to_be_weighed(spark, corpus):
    """Document counts of known, small size go to the counts; the other way round all counts would be shuffled."""
    plan = R.postings(corpus[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(term", plan)


def test_read_blocks_are_scored_without_shuffling_pairs(spark, corpus, tmp_path):
    """Blocks whose bounds let them in meet all queries in products; only results are dealt by query and document."""
    docs, asked = corpus
    B.write(B.blocked(R.postings(docs), 20), str(tmp_path / "b"), partitions=2)
    found = B.search(B.load(spark, str(tmp_path / "b")), asked, 5)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(R.lexical_top(docs, asked, 5))


def test_texts_are_split_once_for_a_segment(spark, corpus, tmp_path):
    """Both tables of a segment come from counts written once, whatever sampling the ranges of terms take."""
    docs, _ = corpus
    path = str(tmp_path / "grown")
    G.write_segment(docs, path, 0)
    counts = spark.read.parquet(f"{path}/_counts")
    assert sorted(map(str, counts.select("doc_id", "term", "tf").collect())) == sorted(map(str, spark.read.parquet(f"{path}/postings").select("doc_id", "term", "tf").collect()))
