import numpy as np
import pytest

from paperloom.llm import embedding_dups as E


def brute(rows, threshold=0.93):
    def ok(x, y):
        return y is not None and x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)

    n, links = len(rows), []
    for i in range(n):
        for j in range(i):
            (_, a, p), (_, b, q) = rows[i], rows[j]
            if ok(a, p) and ok(b, q) and p == q and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b >= threshold * np.sqrt((a @ a) * (b @ b)):
                    links.append((i, j))
    group = list(range(n))
    for _ in range(n):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    out = []
    for i in range(n):
        ids = [rows[k][0] for k in range(n) if group[k] == group[i] and rows[k][0] is not None]
        out.append((rows[i][0], sum(i in p for p in links), min(ids, default=None)))
    return out


def cases():
    rng = np.random.default_rng(1)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = []
    for i in range(30):
        v = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), f(v + rng.standard_normal(16) * rng.choice([0, 0.02, 0.15])), int(rng.integers(0, 2))))
    v = rng.standard_normal(16)
    rows += [(1000 + i, f(v), 7) for i in range(25)] + [(1100 + i, f(v + 0.05 * rng.standard_normal(16)), 7) for i in range(60)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [None] + [1.0] * 15, 1), (2005, f(v), None), (2006, [float("inf")] * 16, 1)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [2.0, 4.0], 1), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (3002, f(2 * v), 7)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = cases()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, x string").repartition(3)
    got = E.near_duplicates(df).collect()
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_tables_reach_the_recall():
    for n in (500, 10**6, 10**9):
        bits, tables = E.tables_for(n, 0.93)
        agree = (1 - np.arccos(0.93) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.998


def test_measured_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * o
    bits, tables = E.tables_for(50_000, 0.93)
    assert (E.signatures(a, bits, tables) == E.signatures(b, bits, tables)).any(axis=1).mean() > 0.99


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
