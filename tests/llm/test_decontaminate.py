import hashlib
import random
import re

import pytest

from paperloom.llm import decontaminate as D
from paperloom.llm.queries import q_decontaminate

SF = "/root/testdata/sf0.001"


def spans_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(m[0], *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(text, items, size=13):
    """Words, hit words, items hit and character spans of hit runs."""
    found = spans_of(text)
    words, hit, who = [w for w, _, _ in found], set(), set()
    for name, item in items:
        own = [w for w, _, _ in spans_of(item)]
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[k : k + n]:
                    hit |= set(range(p, p + n))
                    who.add(name)
    runs = []
    for p in sorted(hit):
        if p - 1 in hit:
            runs[-1][1] = found[p][2]
        else:
            runs.append([found[p][1], found[p][2]])
    return len(words), sorted(hit), sorted(who), runs


def check(rows, got, items, size):
    assert len(got) == len(rows)
    for r in got:
        n, hit, who, runs = brute(r.text, items, size)
        assert (r.n_words, r.n_hit, r.n_items, r.item_ids) == (n, len(hit), len(who), who)
        assert [[s.start, s.end] for s in r.spans] == runs
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= n)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_matches_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = ["a", "b", "É", "x1", "don", "t", "日本", "zz"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 9])))) for i in range(12)] + [(50, ""), (51, None), (52, "?!"), (None, "a b x1"), (3, "a B--é Don't")]
    texts = [None, "", "... !", "A", "a b x1 É", "word " * 3000 + items[0][1]]
    for _ in range(60):
        t = rng.choices(words, k=rng.randrange(1, 30))
        if rng.random() < 0.6:
            at = rng.randrange(len(t))
            t[at:at] = (rng.choice(items[:12])[1].upper() if rng.random() < 0.5 else rng.choice(items[:12])[1]).split()
        texts.append("".join(w + rng.choice([" ", "\n", "-- ", "\t", "' "]) for w in t))
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(4, texts[4], "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(docs, table, size=4, block_bytes=block_bytes).collect()
    check(rows, got, [("" if i is None else str(i), t) for i, t in items], 4)


def test_query_matches_brute_force(spark):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q_decontaminate.query(spark, SF).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        if r.n_hit or r.doc_id < 20:
            n, hit, who, _ = brute(docs[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, len(hit), len(who), hashlib.sha256(",".join(who).encode()).hexdigest())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    r = D.decontaminate(docs, items).first()
    assert (r.n_words, r.n_hit, r.contaminated, r.spans) == (2, 0, False, [])
    assert D.decontaminate(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 24, 3])
def test_columns_pass_through_with_any_number_of_blocks(spark, block_bytes):
    docs = spark.createDataFrame([(1, "a b c", "mine", 5)], "doc_id long, text string, _row string, n_hit long")
    items = spark.createDataFrame([("x", "a b"), ("y", "c"), ("z", "q")], "item_id string, text string")
    got = D.decontaminate(docs, items, size=4, block_bytes=block_bytes).collect()[0]
    assert got["_row"] == "mine" and got.n_hit == 3 and got.item_ids == ["x", "y"]
