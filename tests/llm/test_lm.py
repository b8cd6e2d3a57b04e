import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import lm as L
from paperloom.llm.queries import q_lm

SF = "/root/testdata/sf0.001"


def words_of(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain(docs):
    """doc_id: (held out, tokens, known, train tokens, base score), straight from the definition."""
    fold = {d: zlib.crc32(str(d).encode()) % 10 for d, _ in docs}
    c = Counter()
    for d, t in docs:
        if fold[d]:
            c.update(words_of(t))
            c["<end>"] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs:
        ts = [*words_of(t), "<end>"]
        out[d] = (fold[d] == 0, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts))
    return out


@pytest.mark.parametrize("few", [False, True])
def test_counts_and_base_scores(spark, few):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    small = L.score_held_out(docs, fold != 0, fold == 0, n_words=50, n_known=200, held_most=300) if few else q_lm.query(spark, SF)
    got, docs = small.toPandas().set_index("doc_id"), docs.toPandas()
    want = plain(list(docs.itertuples(index=False)))
    assert len(got) == len(want)
    for d, (held, n, known, total, base) in want.items():
        r = got.loc[d]
        assert (bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert (got.score < 0).all()


def test_probabilities_sum_to_one(spark):
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words, 6, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = L.learn(df, n_words=3, n_kinds=4, n_known=5)
    table = model["table"]
    assert np.allclose((10**table).sum(axis=1), 1)
    # After "aa", over the seen words and one unseen word for each kind:
    symbol = {w.decode(): 1 + i for i, w in enumerate(model["words"])}
    seen = {bytes(r.word): r.c for r in model["counts"].collect()}
    row, total = 10 ** table[symbol["aa"]], 0.0
    for w, c in seen.items():
        s = 0 if not w else symbol.get(bytes(w).decode())
        if s is not None:
            total += row[s]
        else:
            k = L.kind(bytes(w), 4)
            total += row[1 + len(symbol) + k] * (c + 0.1) / model["share"][k]
    total += sum(row[1 + len(symbol) + k] * 0.1 / model["share"][k] for k in range(4))
    assert total == pytest.approx(1)
    got = L.score(df, model).filter("doc_id = 0").first()
    want, before = 0.0, 0
    for w in [*texts[0].split(), ""]:
        s = 0 if not w else symbol.get(w, 1 + len(symbol) + L.kind(w.encode(), 4))
        want += table[before, s]
        if s > len(symbol):
            want += math.log10((seen[w.encode()]) + 0.1) - math.log10(model["share"][s - 1 - len(symbol)])
        before = s
    assert got.score == pytest.approx(want, abs=1e-6)


def test_training_finds_what_follows():
    rng = np.random.default_rng(1)
    true = rng.dirichlet(np.full(12, 0.3), 12)
    pairs = np.round(true * 10_000).astype(np.int64)
    p = 10 ** L.table(L.train(pairs, size=16, steps=400))
    share = pairs.sum(axis=0) / pairs.sum()
    loss = lambda q: -(pairs * np.log(np.maximum(q, 1e-12))).sum() / pairs.sum()
    assert loss(p) < loss(true) + 0.05 < loss(np.tile(share, (12, 1)))


def test_odd_rows(spark):
    rows = [(i, "one two three two", "x") for i in range(20)] + [(50, None, "x"), (51, "", "x"), (52, " \t\n", "x"), (None, "one unheard", "x"), (3, "one two three two", "y"), (53, "two " * 60000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    got = L.score_held_out(df, fold != 0, fold == 0).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got if r.doc_id in (50, 51, 52)) == [1, 1, 1]
    none = next(r for r in got if r.doc_id is None)
    assert not none.held_out and none.n_tokens == 3 and none.n_known == 2
    assert max(r.n_tokens for r in got) == 60001


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_held_out(df, F.lit(True), F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    r = L.score_held_out(one, F.lit(False), F.lit(True)).first()
    assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0)


def test_symbols_grow_with_the_training_tokens():
    sizes = [L.symbols(n) for n in (0, 1, 10**4, 4 * 10**6, 10**8, 10**13)]
    assert sizes[0] == (L.LEAST, L.LEAST // 4)  # a small input doesn't get a smaller model than that
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(sizes, sizes[1:])) and sizes[4][0] > sizes[3][0] and sizes[5][0] > 10 * sizes[3][0]


def test_vectors_give_the_table():
    pairs = np.random.default_rng(2).integers(0, 50, (40, 40))
    p = L.train(pairs, steps=50)
    before, after = L.vectors(p, L.table(p))
    assert np.allclose(before @ after.T, L.table(p), atol=1e-9)


def test_pairs_counted_in_parts(spark, monkeypatch):
    texts = ["a b a", "b b", None, "c a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    number = {b"a": 1, b"b": 2}
    for t in texts:
        line = [0, *(number.get(w.encode(), 3) for w in words_of(t)), 0]
        want.update(zip(line, line[1:]))
    for most in (1, 1 << 22):
        monkeypatch.setattr(L, "PAIRS", most)
        got = L.count_pairs(df, "text", [b"a", b"b"], 1)
        assert {(i, j): got[i, j] for i, j in np.argwhere(got).tolist()} == dict(want)
