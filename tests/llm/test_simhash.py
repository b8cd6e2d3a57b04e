import random

import numpy as np
import pytest
import xxhash

from paperloom.llm import simhash as S


def brute_components(ids, fps, radius=3):
    least = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, fps):
            for b, y in zip(ids, fps):
                if bin((x ^ y) & (2**64 - 1)).count("1") <= radius and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a B", "a b c", "É x y z É x y z", "w " * 500, "  non breaking space x"])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('a b c') h").first()
    assert row.h == S.signed(S.fingerprint(b"A b\tc"))


def test_shards_share_every_link():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(400)]
    points = list({x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for x in base for _ in range(6)})
    x = np.array(points, np.uint64)
    shards = []
    for half in S.HALVES:
        tree = S.plant(x[:800] & half, len(x) / 800, 200, 1)
        shards += [set(own.tolist()) for _, own in S.route(tree, x & half, 1)]
    assert len(shards) > 8
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    near = [(a, b) for a, b in near.tolist() if a < b]
    for a, b in near:
        assert any(a in s and b in s for s in shards)
    got = [p for half in S.HALVES for p in S.shard_links(x, 3, half, cell=64)]
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in near}

    def classes(links):
        up = list(range(len(x)))
        for a, b in links:
            ra, rb = a, b
            while up[ra] != ra:
                ra = up[ra]
            while up[rb] != rb:
                rb = up[rb]
            up[max(ra, rb)] = min(ra, rb)
        out = []
        for i in range(len(x)):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    assert classes(got) == classes(near)


@pytest.mark.parametrize("crowd", [10**6, 7])
def test_groups_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "SHARD", 20)
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    docs, texts = [], [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    for i in range(160):
        t = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t), "x"))
    docs += [(200, None, None), (201, "", "x"), (202, " \n ", "x"), (203, "Two words", "x"), (204, "two WORDS", "x"), (5, docs[5][1], "again"), (None, docs[7][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string").repartition(3)
    rows = S.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    known = [(d, t) for d, t, _ in docs if d is not None]
    fps = [plain_fingerprint(t) for _, t in known]
    want = brute_components([d for d, _ in known], fps)
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
            assert S.signed(plain_fingerprint(dict(known)[r.doc_id])) == r.fp
    none = next(r for r in rows if r.doc_id is None)
    assert none.component_id == want[7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0


def test_query_matches_brute_force(spark):
    from paperloom.llm.queries import q_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    want = brute_components([r.doc_id for r in docs], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q_simhash.query(spark, sf).collect()}
    assert got == {r.doc_id: (f"{fp:016x}", want[r.doc_id]) for r, fp in zip(docs, fps)}


def test_long_texts_in_chunks():
    text = " ".join(f"w{k % 977}" for k in range(70_000))
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)
