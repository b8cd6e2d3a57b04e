import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import substrings as S
from paperloom.llm.queries import q_substrings


def brute(texts, length):
    """(kept bytes, spans) of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2)
        out.append((np.frombuffer(t, np.uint8)[~gone].tobytes(), edges.tolist()))
    return out


def cases(rng, scale):
    words = ["".join(rng.choices("abcdefgé", k=rng.randrange(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n * scale))
    base = [text(30) for _ in range(6)]
    out = []
    for _ in range(40):
        t = rng.choice(base)
        kind = rng.randrange(5)
        if kind == 0:
            w = t.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind == 1:
            a = rng.randrange(len(t))
            t = text(rng.randrange(1, 9)) + t[a : a + 30 * scale] + text(rng.randrange(1, 9))
        elif kind == 2:
            t = text(20)
        elif kind == 3:
            t = t + t[: len(t) // 2]
        out.append(t)
    return out + [None, "", "short", "ab" * 60 * scale, "z" * 90 * scale, "z" * (17 * scale), base[0], base[0]]


@pytest.mark.parametrize("sizes", [dict(length=12, anchor=4, step=3, crowd=10**6, chunk=1 << 20), dict(length=12, anchor=4, step=4, crowd=2, chunk=25), dict(length=30, anchor=12, step=16, crowd=10**6, chunk=64)])
def test_matches_brute_force(spark, sizes):
    texts = cases(random.Random(sizes["step"]), 2)
    ids = [None, 3, 3, *range(3, len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, kept string").repartition(4)
    got = S.remove_repeats(df, **sizes).collect()
    want = sorted((i is not None, i or 0, len((t or "").encode()), hashlib.sha256(k).hexdigest(), s) for i, t, (k, s) in zip(ids, texts, brute(texts, sizes["length"])))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, hashlib.sha256(r.kept).hexdigest(), [[a, b] for a, b in r.spans]) for r in got) == want
    assert all(r.n_removed == sum(b - a for a, b in r.spans) == r.n_bytes - len(r.kept) and r.n_spans == len(r.spans) for r in got)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    want = {d: (hashlib.sha256(k).hexdigest(), len(s)) for d, (k, s) in zip(docs.doc_id, brute(docs.text.tolist(), 400))}
    rows = q_substrings.query(spark, sf).collect()
    got = {r.doc_id: (r.kept_sha256, r.n_spans) for r in rows}
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and (r.n_removed or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256) for r in rows)
    assert got == want and sum(n > 0 for _, n in want.values()) > 5


def test_many_copies_of_one_row(spark):
    """The windows of a text travel once, not once for each of its copies."""
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(120))
    rows = spark.range(20_000).selectExpr("7L AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(8, text + " end"), (9, "alone " * 5)], "doc_id long, text string"))
    got = S.remove_repeats(rows).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted(tuple(r) for r in got) == [(7, len(text), 1, 20_000), (8, len(text), 1, 1), (9, 0, 0, 1)]


def test_windows_are_dealt_once():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"a" * 500
    h, at, first, last = S.runs(data, 60, 20)
    assert first[0] == 0 and last[-1] == len(data) - 60 and (first[1:] == last[:-1] + 1).all()
    assert (at >= last).all() and (at + 20 <= first + 60).all()


def test_shown_windows():
    strings = [("k", b"abc", b"xyz", 4), ("k", b"zbc", b"xyw", 4), ("k", b"qqq", b"www", 4), ("o", b"abc", b"xyz", 4)]
    got = [sorted(x) for x in S.repeated_windows(strings, 4)]
    assert got == [[1, 2], [1, 2], [], []]


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
