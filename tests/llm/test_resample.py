import hashlib
import math
import random
import re
import zlib

import pytest

from paperloom.llm import resample as R
from paperloom.llm.queries import q_resample

SF = "/root/testdata/sf0.001"


def brute(docs, target, buckets=10_000, longest=1, least=20, share=(10, 100), seed=2024):
    """(n_features, weight, score, rank) of each (id, text); equal rows share their places."""

    def runs(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        out = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in out]

    ours, theirs = [runs(t) for _, t in docs], [runs(t) for t in target]
    s, t = [0] * buckets, [0] * buckets
    for table, found in ((s, ours), (t, theirs)):
        for _, own in found:
            for b in own:
                table[b] += 1
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
    known, rows = {}, []
    for (name, _), (n, own) in zip(docs, ours):
        weight = sum(known.setdefault(b, gain(b)) if b not in known else known[b] for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append([n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((i for i in range(len(docs)) if rows[i][0] >= least), key=lambda i: (-rows[i][3], docs[i][0] is None, docs[i][0] or 0 if not isinstance(docs[i][0], str) else docs[i][0], i))
    ranks = {i: k for k, i in enumerate(order[: share[0] * len(order) // share[1]], 1)}
    return [(*rows[i][1:], ranks.get(i)) for i in range(len(docs))]


def texts(rng, n, most=60):
    words = ["alpha", "Beta", "日本", "x1", "é", "zz", "the", "of"] + [f"w{i}" for i in range(30)]
    return [" ".join(rng.choices(words, k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("longest,rows_a_range,share", [(1, 10_000, (10, 100)), (2, 20, (10, 100)), (3, 7, (1, 2)), (1, 5, (1, 1)), (1, 5, (0, 1))])
def test_matches_brute_force(spark, monkeypatch, longest, rows_a_range, share):
    monkeypatch.setattr(R, "ROWS", rows_a_range)
    rng = random.Random(longest)
    docs = list(enumerate(texts(rng, 150))) + [(900, None), (901, ""), (902, "?!"), (None, "alpha " * 25), (903, ("beta-" * 7 + "\n") * 60_000)]
    docs += [docs[3]] * 5 + [(5, "zz " * 30)] * 40
    target = [*texts(rng, 12), None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("rank", R.F.lit("mine"))
    got = [tuple(r) for r in R.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, share=share, least=20).select("doc_id", "text", "n_features", "weight", "score", "rank").collect()]
    own = brute(docs, target, longest=longest, share=share)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(((*d, *r) for d, r in zip(docs, own)), key=key)
    ranks = sorted(r[5] for r in got if r[5] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_text_ids_and_pieces(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(f"k{i:03}é" if i % 2 else f"K{i}", t) for i, t in enumerate(texts(rng, 80))]
    frame = spark.createDataFrame(docs, "name string, body string")
    target = spark.createDataFrame([(x,) for x in texts(rng, 5)], "body string")
    got = {r.name: tuple(r)[1:] for r in R.resample(frame, target, "name", "body", share=(1, 3)).select("name", "n_features", "weight", "score", "rank").collect()}
    assert [got[n] for n, _ in docs] == brute(docs, [r.body for r in target.collect()], share=(1, 3))
    whole = [t.encode() for t in texts(rng, 3, 400)] + [None, b"", b"end" * 40 + b" " + b"x" * 70]
    found = lambda: sorted((int(w), int(b)) for who, _, own in R.features(whole, 3, 1000) for w, b in zip(who, own))
    one = found()
    monkeypatch.setattr(R, "PIECE", 37)
    assert found() == one
    assert sum(len(own) for _, words, own in R.features(whole, 3, 1000) if words) == sum(len((t or b"").split()) for t in whole)


@pytest.mark.parametrize("docs,target", [([], ["a b"]), ([(1, "a " * 30)], []), ([], [])])
def test_empty_tables(spark, docs, target):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in R.resample(frame, spark.createDataFrame([(x,) for x in target], "text string")).select("n_features", "weight", "score", "rank").collect()]
    assert got == brute(docs, target)


def test_merge_stops_at_the_count():
    rng = random.Random(2)
    for most in (None, 0, 1, 37, 10_000):
        runs = [sorted(rng.choices(range(500), k=rng.randrange(1, 40))) for _ in range(60)]
        parts = sorted((([(x, i, j) for j, x in enumerate(r)], i) for i, r in enumerate(runs)), key=lambda p: p[0][0])
        read = []

        def coming(parts=parts, read=read):
            for p in parts:
                read.append(p)
                yield p

        by = dict((i, keys) for keys, i in parts)
        out, rest, most_held = [], 0, 0
        for i, a, b, drawn in R.merged(coming(), most):
            if drawn:
                out += by[i][a:b]
            else:
                rest += b - a
        whole = sorted(k for keys in by.values() for k in keys)
        assert out == whole[:most] and rest == len(whole) - len(out)


def test_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(q_resample.ORACLE)
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r) for r in cursor.fetchall())
    got = sorted(tuple(r) for r in q_resample.query(spark, SF).select(*names).collect())
    assert [r[:4] for r in got] == [r[:4] for r in want] and got == want
