from collections import Counter

import numpy as np
import pytest

from paperloom.llm import pieces as P
from paperloom.llm import segment as S
from paperloom.llm.queries.q_segment import MODEL, query

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary(open(MODEL, "rb").read())


def every_path(text, vocab):
    """All segmentations of a text with their probabilities."""
    text = (" " + text).replace(" ", P.SPACE)

    def grow(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for n in range(1, min(vocab.longest, len(rest)) + 1):
            i = vocab.ids.get(rest[:n])
            if i is not None:
                out += [((i, *p), w + vocab.weights[i]) for p, w in grow(rest[n:])]
        if rest[0] not in vocab.ids:
            ids = vocab.fallback(rest[0])
            out += [((*ids, *p), w + vocab.weights[ids].sum()) for p, w in grow(rest[1:])]
        return out

    found = grow(text)
    total = np.logaddexp.reduce([w for _, w in found])
    return {p: float(np.exp(w - total)) for p, w in found}


def draw(text, vocab, key, k, front=S.FRONT):
    lattices = S.Lattices(vocab)
    cut = vocab.units(text)
    (numbers,) = lattices.learn([cut])
    lengths = np.array([len(u) for u in cut])
    return S.draw_samples(lattices, [numbers], [lengths], np.array([key], np.uint64), k, front)[0]


@pytest.mark.parametrize("front", [1, 2, 32])
def test_samples_follow_the_distribution(vocab, front):
    true = every_path("the\nend", vocab)
    n, top = 4000, Counter()
    second, given = Counter(), Counter()
    for key in range(n):
        got = draw("the\nend", vocab, np.uint64(key * 7919 + 1), 2, front)
        a, b = (tuple(g["ids"].tolist()) for g in got)
        assert a != b and a in true and b in true
        assert got[0]["value"] >= got[1]["value"]
        assert got[0]["log_p"] == pytest.approx(np.log(true[a])) and got[1]["log_p"] == pytest.approx(np.log(true[b]))
        top[a] += 1
        second[b] += 1
    for path, p in true.items():
        assert top[path] / n == pytest.approx(p, abs=4 * np.sqrt(p * (1 - p) / n) + 1e-3)
        q = sum(r * p / (1 - r) for o, r in true.items() if o != path)  # second of a draw without replacement
        assert second[path] / n == pytest.approx(q, abs=4 * np.sqrt(q * (1 - q) / n) + 1e-3)


@pytest.mark.parametrize("front", [1, 3, 32])
def test_all_segmentations_without_replacement(vocab, front):
    for text in ("ab", "a b", "中é", "the", "🙂"):
        true = every_path(text, vocab)
        got = draw(text, vocab, np.uint64(5), len(true) + 3, front)
        assert {tuple(g["ids"].tolist()) for g in got} == set(true) and len(got) == len(true)
        assert all(g["log_inclusion"] == 0 for g in got)
        values = [g["value"] for g in got]
        assert values == sorted(values, reverse=True)


def test_inclusion_is_calibrated(vocab):
    """Weights by inclusion estimate the total probability, one, without bias."""
    estimates = []
    for key in range(1500):
        got = draw("hello", vocab, np.uint64(key * 104729 + 3), 4, 2)
        estimates.append(sum(np.exp(g["log_p"] - g["log_inclusion"]) for g in got))
    assert np.mean(estimates) == pytest.approx(1, abs=5 * np.std(estimates) / np.sqrt(1500))


def test_matches_the_library(spark, vocab):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = S.encode(docs, MODEL, samples=2).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == vocab.processor.encode(r.text) and r.decodes
        assert len(r.samples) == 2 and r.samples[0].ids != r.samples[1].ids
        for s in r.samples:
            assert vocab.processor.decode(s.ids) == r.text
            assert s.log_prob < 0 and s.log_inclusion <= 0
    again = {r.doc_id: r.samples for r in S.encode(docs.repartition(7).orderBy("text"), MODEL, samples=2).collect()}
    assert all(again[r.doc_id] == r.samples for r in got)
    back = S.decode(S.encode(docs, MODEL, samples=0), MODEL, to="decoded")
    assert back.filter("decoded <> text").count() == 0
    assert query(spark, SF).count() == len(got)


def test_odd_rows(spark, vocab):
    texts = [None, "", " ", "a  b ", "\n\n", "tab\tx", "日本 🙂\x00", "x" * 3000, "▁a", "word " * 20000, "a  b "]
    rows = [(None if i == 3 else i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = S.encode(df, MODEL, samples=3)
    assert got.columns == ["doc_id", "text", "ids", "decodes", "samples"]
    for r in got.collect():
        assert r.ids == (vocab.processor.encode(r.text) if r.text else [])
        assert r.decodes
        assert all(vocab.processor.decode(s.ids) == (r.text or "").replace("▁", " ") for s in r.samples)
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) <= 3
    assert S.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
