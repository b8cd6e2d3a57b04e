import random

import pytest

from paperloom.operators import blocks as B
from paperloom.operators import search as R
from paperloom.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select("qid", "doc_id", "score", "rank").collect()))


def shuffled(spark, run):
    """Rows that all stages of ``run`` wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["사과는", "사과", "30명", "ab12cd"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(200)]
    docs += [(500 + i, docs[i % 5][1]) for i in range(40)] + [(None, "w1 w2"), (None, "w2 w3"), (900, None)]  # copies: ties; no id; no text
    docs += [(7, "w1 w1 사과는"), (8, None)]  # rows of one id are one document
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(90, "none"), (91, "")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "qid long, query string")


@pytest.mark.parametrize("kind,count,k,docs_at_once,size", [("long", 1, 5, 2048, 1 << 23), ("string", 40, 7, 3, 200), ("long", 40, 300, 30, 1 << 23), ("long", 5000, 3, 50, 500)])
def test_counted_blocks_give_what_texts_give(spark, monkeypatch, corpus, tmp_path, kind, count, k, docs_at_once, size):
    monkeypatch.setattr(B, "TEXTS", docs_at_once)
    monkeypatch.setattr(B, "TEXT_BYTES", size)
    docs, asked = corpus
    docs = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    B.write(B.counted(docs, count), str(tmp_path / "b"))
    index = B.load(spark, str(tmp_path / "b"))
    postings = R.postings(docs)
    assert rows(B.search(index, asked, k)) == rows(R.stored_top(postings, asked, k))
    terms = index.filter("term IS NOT NULL")
    assert terms.groupBy("term", "block").count().filter("count > 1").count() == 0
    flat = terms.selectExpr("term", "inline(arrays_zip(ids, tfs))")
    assert sorted(map(repr, flat.selectExpr("ids", "term", "tfs").collect())) == sorted(map(repr, postings.selectExpr("doc_id AS ids", "term", "tf AS tfs").collect()))
    assert terms.filter("n <> size(ids) OR tf <> array_max(tfs) OR dl <> array_min(dls)").count() == 0
    assert index.filter("term IS NULL").selectExpr("sum(n)", "sum(tf)").first()[:] == (docs.select("doc_id").distinct().count(), docs.select(R.X.tokens("text").alias("t")).selectExpr("sum(size(t))").first()[0])


def test_bounds_rule_blocks_out_and_leave_lists_unread(spark, corpus, tmp_path):
    docs, asked = corpus
    B.write(B.counted(docs, 40), str(tmp_path / "b"))
    index = B.load(spark, str(tmp_path / "b"))
    few = asked.filter("length(query) < 12 AND query <> ''")
    counts = B.read_counts(index, few, 2).collect()
    assert sum(r.read for r in counts) < sum(r.blocks for r in counts) and all(r.read >= min(r.blocks, B.FIRST) for r in counts)
    plan = B._ranked(*B._asked(index, asked, R.DEFAULT))._jdf.queryExecution().executedPlan().toString()
    assert "tfs" not in plan and "ids" not in plan


def test_an_index_without_tokens_or_documents(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a b")], "qid long, query string")
    for n, docs in enumerate(([(1, ""), (2, None)], [])):
        B.write(B.counted(spark.createDataFrame(docs, "doc_id long, text string"), 3), str(tmp_path / str(n)))
        assert B.search(B.load(spark, str(tmp_path / str(n))), asked, 5).count() == 0


@pytest.mark.parametrize("query", [catalog.block_postings_search, catalog.stored_filtered_search])
def test_no_posting_is_shuffled_to_be_stored(spark, query):
    """Texts are dealt once; before, postings were dealt by term and block, and their rows by range, and by block once more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert shuffled(spark, lambda: query(spark, SF).collect()) < R.term_frequencies(docs).count() / 2
