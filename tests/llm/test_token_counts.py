from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import pieces as P
from paperloom.llm import token_counts as C
from paperloom.llm.queries.q_token_counts import MODEL, query

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary(open(MODEL, "rb").read())


def plain(text, vocab):
    """Tokens of the best segmentation of a whole text, by plain dynamic programming."""
    if not text:
        return 0
    text = (" " + text).replace(" ", P.SPACE)
    by_byte = vocab.weights[vocab.bytes[0]]
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - vocab.longest), end):
            i = vocab.ids.get(text[start:end])
            if i is not None:
                options.append((best[start][0] + vocab.weights[i], -best[start][1] - 1))
        if text[end - 1] not in vocab.ids:
            n = len(text[end - 1].encode())
            options.append((best[end - 1][0] + n * by_byte, -best[end - 1][1] - n))
        top = max(s for s, _ in options)
        best.append((top, -max(c for s, c in options if s >= top - 1e-9)))
    return best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab eté\n 中▁🙂\t"), max_size=40))
def test_matches_plain_programming(text):
    v = _vocab()
    cut = v.units(text)
    counts = C.Counts(v)
    counts.learn([cut])
    assert sum(counts[u] for u in cut) == plain(text, v)


@lru_cache
def _vocab():
    return P.Vocabulary(open(MODEL, "rb").read())


def test_prefixes_are_shared(vocab, monkeypatch):
    asked = []

    class Spy(set):
        def __contains__(self, x):
            asked.append(x)
            return set.__contains__(self, x)

    monkeypatch.setattr(vocab, "endings", Spy(vocab.endings))
    C.trie_counts(["abcdefgh"], vocab)
    alone = len(asked)
    C.trie_counts(["abcdefgh"] + ["abcdefgh"[:k] for k in range(1, 8)], vocab)
    assert len(asked) == 2 * alone


def test_query(spark, vocab):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = query(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in list(zip(docs.doc_id, docs.text))[:60]:
        assert got.n_tokens[d] == plain(t, vocab) and got.n_characters[d] == len(t)


def test_odd_rows(spark, vocab):
    long = "word " * 50_000
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (2, "a b", 1), (2, "a b", 1), (3, long, 1)]
    got = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL)
    assert got.columns == ["doc_id", "text", "n_pretokens", "n_tokens", "n_characters"]
    assert sorted(r.n_tokens for r in got.collect()) == sorted(plain(t, vocab) for _, t, _ in rows)
    assert C.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
