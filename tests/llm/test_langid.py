import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import langid as L
from paperloom.llm.queries import q_langid

SF = "/root/testdata/sf0.01"


def test_features_ignore_case_digits_and_spacing():
    a, b = L.features("Ein  Haus, 42\n".encode()), L.features(b"ein haus")
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    for x in (None, b"", b"123 !?", "١٢٣".encode()):
        assert not len(L.features(x)[0])


def test_long_texts_count_all_ngrams():
    text = "ein haus " * 130_000  # more than a chunk
    own, counts = L.features(text.encode())
    assert counts.sum() == 7 * 130_000 + (9 * 130_000) + (9 * 130_000 - 1)


def test_penalties_make_weights_sparse():
    learner = L.FollowTheLeader(2, l1=0.02)
    strong = L.FollowTheLeader(2, l1=5.0)
    for m in (learner, strong):
        for _ in range(5):
            m.learn(np.array([1, 2]), np.array([0.7, 0.7]), 0)
            m.learn(np.array([3, 4]), np.array([0.7, 0.7]), 1)
    assert (learner.weights(np.arange(5)) != 0).sum() == 8
    assert (strong.weights(np.arange(5)) != 0).sum() == 0


def test_temperature_calms_a_bold_model():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 400)
    said = np.where(rng.random(400) < 0.8, labels, 1 - labels)
    logits = np.zeros((400, 2))
    logits[np.arange(400), said] = 20
    t = L.temperature(logits, labels)
    assert L.softmax(logits / t).max(axis=1).mean() == pytest.approx(0.8, abs=0.05)


def test_held_out_accuracy(spark):
    got = q_langid.query(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) == len(both)
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, ("das ist ein haus " if i % 2 else "this is the house ") * 5, "de" if i % 2 else "en", "x") for i in range(60)]
    rows += [(100, None, "de", "x"), (101, "", "en", "x"), (102, "123", None, "x"), (None, "this is the house", "en", "x"), (1, rows[1][1], "de", "y"), (103, "this is the house " * 9000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = L.train(df, "doc_id", "text", "lang", fold != 2, fold == 3)
    out = L.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "least_score"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103].lang_pred == "en" and all(by[i].lang_pred == ("de" if i % 2 else "en") for i in range(60))


def test_no_labelled_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(empty, "doc_id", "text", "lang", F.lit(True), F.lit(False))
    assert L.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert L.identify(one, model).first().lang_pred == "und"


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, "ein haus" if i % 10 else "a house", "de" if i % 10 else "en") for i in range(500)], "doc_id long, text string, lang string")
    seen = []
    real = L.fit
    try:
        L.fit = lambda rows: seen.append(rows) or real(rows)
        L.train(df, "doc_id", "text", "lang", F.lit(True), F.lit(False), sample=60)
    finally:
        L.fit = real
    assert 20 < len(seen[0]) <= 60 and {r[0] for r in seen[0]} == {"de", "en"}


def test_repeated_rows_keep_bound_and_labels(spark):
    rows = [(7, "das ist ein haus", "de")] * 2000 + [(7, f"this is house {i}", "en") for i in range(300)] + [(8, "una casa", "es")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    real = L.fit
    try:
        L.fit = lambda rows: seen.append(rows) or real(rows)
        model = L.train(df, "doc_id", "text", "lang", F.lit(True), F.lit(False), sample=60)
    finally:
        L.fit = real
    labels = [r[0] for r in seen[0]]
    assert len(labels) <= 60 and labels.count("de") == 1 and labels.count("es") == 1 and labels.count("en") == 20
    assert model["labels"] == ["de", "en", "es"]


@pytest.mark.parametrize("text", ["Straße 12, naïve!", "a", " x  y ", "日本 語", "ab" * 50, "Ünï-ç 9 ß"])
def test_features_match_a_plain_version(text):
    mask, spaced = (1 << 32) - 1, " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        spaced += c if c != " " or spaced[-1] != " " else ""
    spaced = spaced if spaced[-1] == " " else spaced + " "
    want = {}

    def add(gram):
        mixed = ((gram ^ (gram >> 16)) * 0x7FEB352D) & mask
        want[mixed >> (32 - L.BUCKET_BITS)] = want.get(mixed >> (32 - L.BUCKET_BITS), 0) + 1

    one = [ord(c) * 2654435761 & mask for c in spaced]
    two = [((a ^ (a >> 15)) * 2246822519 + b) & mask for a, b in zip(one, one[1:])]
    three = [((a ^ (a >> 13)) * 3266489917 + b) & mask for a, b in zip(two, one[2:])]
    for c, a in zip(spaced, one):
        if c != " ":
            add(a)
    for a in two:
        add((a + 0x9E3779B1) & mask)
    for a in three:
        add((a + 0x85EBCA77) & mask)
    own, counts = L.features(text.encode())
    assert dict(zip(own.tolist(), counts.tolist())) == want


def test_query_predicts_as_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = L.train(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", "lang", fold != 2, fold == 3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(docs), model).collect()}
    for r in docs[:60]:
        own, counts = L.features((r.text or "").encode())
        z = model["w"][L.BUCKETS].astype(float)
        x = (1 + np.log(counts)) * model["idf"][own]
        for k, v in zip(own, x / np.sqrt((x * x).sum())):
            z = z + v * model["w"][k]
        p = np.exp(z / model["t"]) / np.exp(z / model["t"]).sum()
        assert got[r.doc_id][0] == model["labels"][int(p.argmax())] and got[r.doc_id][1] == pytest.approx(p.max(), abs=1e-4)
