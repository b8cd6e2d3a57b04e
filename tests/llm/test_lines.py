import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import edit, words
from paperloom.llm import lines as L
from paperloom.llm.words import sketches


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=30), st.text("abé ", max_size=30))
def test_distance(a, b):
    assert edit.distance(a, b) == plain_distance(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé ", max_size=30), st.text("abé ", max_size=30)), max_size=60))
def test_similar(pairs):
    want = [plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert edit.similar([(edit.Form(a), edit.Form(b)) for a, b in pairs], 0.8).tolist() == want


def test_similar_over_many_words_of_bits():
    rng = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abcdé ", k=rng.choice([3, 63, 64, 65, 130, 200])))
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 3)):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "ab"])
        pairs.append((a, "z" + "".join(b) + "y"))
    want = [plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert 50 < sum(want) < 350
    assert edit.similar([(edit.Form(a), edit.Form(b)) for a, b in pairs], 0.8).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1é \n,", max_size=60)), max_size=8), st.integers(1, 40))
def test_sketches_in_pieces(texts, size):
    import xxhash

    raw = [None if t is None else t.encode() for t in texts]
    found = [sketches(p, 2) for p in words.pieces(raw, size)]
    lines = [normal(line) for t in texts if t is not None for line in t.split("\n")]
    got = {k: [v for x in found for v in x[k].tolist()] for k in ("words", "chars", "sim", "h1", "h2")}
    assert got["words"] == [len(x) for x in lines] and got["sim"] == [plain_simhash(x) for x in lines]
    assert got["chars"] == [len(b" ".join(x).decode()) for x in lines]
    halves = [np.frombuffer(xxhash.xxh3_128_digest(b" ".join(x)), np.int64).tolist() if x else [0, 0] for x in lines]
    assert [list(p) for p in zip(got["h1"], got["h2"])] == halves


def test_word_hashes():
    import xxhash

    rng = random.Random(8)
    found = ["".join(rng.choices("abcdefgé1", k=k)) for k in range(1, 90)]
    data, starts, sizes = b"", [], []
    for w in found:
        starts.append(len(data))
        sizes.append(len(w.encode()))
        data += w.encode() + b" "
    got = words.xxh64(data + b"\0" * 8, np.array(starts), np.array(sizes))
    assert got.tolist() == [xxhash.xxh64_intdigest(w) for w in found]


def test_long_lines_in_segments():
    line = [b"w%d" % (k * k) for k in range(5000)]
    assert simhashes([line, [b"x"], line[:1001]]) == [plain_simhash(x) for x in (line, [b"x"], line[:1001])]


def normal(line):
    return line.encode().translate(L.NORMAL).split()


def plain_simhash(words):
    import xxhash

    total = [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w)
        for b in range(64):
            total[b] += min(len(w), 64) * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(64) if total[b] > 0)


def simhashes(lines):
    return sketches(b"".join(b" ".join(x) + b"\n" for x in lines))["sim"].tolist()


def test_simhashes():
    lines = [normal(x) for x in ("One two, three!", "", "é 12 one", "word " * 300)]
    assert simhashes(lines) == [plain_simhash(x) for x in lines]


def brute(docs, hashes, bands=0):
    """Cut lines by document, straight from the rules."""
    spots = []
    for d, t in set(docs):
        for k, line in enumerate([] if t is None else t.split("\n")):
            if normal(line):
                spots.append(((d is None, d or 0, hashes[t], k), normal(line)))
    forms = sorted({tuple(f) for _, f in spots})
    number = {f: i for i, f in enumerate(forms)}
    group = list(range(len(forms)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    sims = [plain_simhash(f) for f in forms]
    keys = sketches(b"".join(b" ".join(f) + b"\n" for f in forms), bands, L.ROWS)["bands"] if forms and bands else None
    bits, sizes = np.array(sims, np.uint64), np.array([len(b" ".join(f).decode()) for f in forms])
    step = np.floor(np.log(np.maximum(sizes, 1)) / np.log(L.CLASS_STEP))
    for i in range(len(forms)):
        far = np.bitwise_count(bits[:i] ^ bits[i])
        may = far <= 3
        if bands:
            wide = np.where(np.minimum(step[:i], step[i]) < int(np.log(L.SHORT) / np.log(L.CLASS_STEP)), L.WIDER, L.WIDE)
            may |= (keys[:i] == keys[i]).any(axis=1) & (far <= wide)
        for j in np.flatnonzero(may).tolist():
            if min(len(forms[i]), len(forms[j])) >= L.FUZZY_WORDS:
                a, b = b" ".join(forms[i]).decode(), b" ".join(forms[j]).decode()
                if (edit.distance if bands else plain_distance)(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                    group[max(root(i), root(j))] = min(root(i), root(j))
    first = {}
    for place, f in sorted(spots, key=lambda s: s[0]):
        first.setdefault(root(number[tuple(f)]), place)
    cut = {}
    for place, f in spots:
        if first[root(number[tuple(f)])] != place:
            cut.setdefault(place[:3], []).append(place[3])
    return {k: sorted(v) for k, v in cut.items()}


@pytest.mark.parametrize("hashes_at_once, texts_at_once", [(4096, 512), (3, 2), (2, 512)])
def test_matches_brute_force(spark, monkeypatch, hashes_at_once, texts_at_once):
    monkeypatch.setattr(L, "HASHES", hashes_at_once)
    monkeypatch.setattr(L, "TEXTS", texts_at_once)
    rng = random.Random(2)
    words = ["w%da%d" % (i, i * i) for i in range(200)] + ["é" * 3, "ß"]
    lines = [" ".join(rng.choices(words, k=rng.choice([2, 6, 30, 60]))) for _ in range(30)]
    docs = []
    for i in range(50):
        out = []
        for _ in range(rng.randrange(1, 7)):
            t = rng.choice(lines).split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice([words[3], "x", t[0]])
            line = " ".join(t)
            out.append(rng.choice([line, line.upper() + " !!", "", "***", line]))
        docs.append((i, "\n".join(out)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, docs[4][1]), (4, docs[4][1]), (103, "same\nsame\nsame"), (104, "\n".join(lines * 40))]
    rows = [(d, t, r) for r, (d, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_cut int").coalesce(1)
    out = L.dedup_lines(df.withColumnRenamed("n_cut", "at")).collect()
    assert len(out) == len(docs)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    want = brute(docs, hashes)
    assert sum(len(v) for v in want.values()) > 60
    for r in out:
        d, text = docs[r["at"]]
        cut = want.get((d is None, d or 0, hashes[text]), [])
        assert r.cut_lines == cut and r.n_cut == len(cut)
        assert r.n_lines == (0 if text is None else len(text.split("\n")))
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut))


def test_fuzzy_copies_go(spark):
    line = " ".join("word%d" % i for i in range(80))
    near = line.replace("word40", "word41")
    assert (plain_simhash(normal(line)) ^ plain_simhash(normal(near))).bit_count() <= 3
    df = spark.createDataFrame([(1, line), (2, near + "\nown words here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got == {1: line, 2: "own words here"}


@pytest.mark.parametrize("count", [10, 10**6, 10**8, 10**11])
def test_keys_catch_every_radius(count):
    bits = L.masks(count)
    rng = np.random.default_rng(0)
    for _ in range(300):
        change = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not change & m for m in bits)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_find_pairs_beyond_the_radius(spark):
    rng = random.Random(5)
    words = ["w%da%d" % (i, i * i) for i in range(3000)]
    docs, pairs = [], 150
    for k in range(pairs):
        line = rng.choices(words, k=rng.choice([8, 10, 15, 30]))
        near = list(line)
        near[rng.randrange(len(near))] = rng.choice(words)
        docs += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(near))]
    alike = [k for k in range(pairs) if plain_distance(*(t for _, t in docs[2 * k : 2 * k + 2])) <= 0.2 * max(len(t) for _, t in docs[2 * k : 2 * k + 2])]
    sims = simhashes([normal(t) for _, t in docs])
    far = [k for k in alike if (sims[2 * k] ^ sims[2 * k + 1]).bit_count() > 3]
    assert len(far) > 100
    df = spark.createDataFrame([*docs, (10**6, None), (10**6 + 1, "\n*\n")], "doc_id long, text string")
    out = {r.doc_id: r for r in L.dedup_lines(df, bands=L.BANDS).collect()}
    assert len(out) == len(docs) + 2
    cut = {d // 2 for d, r in out.items() if r.n_cut}
    assert cut <= set(alike) and all(out[2 * k].n_cut == 0 for k in range(pairs))
    assert len(cut & set(far)) >= 0.9 * len(far)


@pytest.mark.parametrize("length", [6, 8, 12, 20, 40, 80])
def test_recall_by_length(spark, length):
    """Of unequal lines with one to three changed words and an edit similarity of 0.8, at least 0.9 link."""
    rng = random.Random(length)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 10))) for _ in range(4000)]
    docs, alike = [], []
    for k in range(200):
        line = rng.choices(vocabulary, k=length)
        near = list(line)
        for _ in range(1 + rng.randrange(max(1, min(3, length // 12 + 1)))):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        a, b = " ".join(line), " ".join(near)
        docs += [(2 * k, a), (2 * k + 1, b)]
        if a != b and plain_distance(a, b) <= 0.2 * max(len(a), len(b)):
            alike.append(k)
    out = {r.doc_id: r.n_cut for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), bands=L.BANDS).collect()}
    assert len(alike) > 80
    assert sum(out[2 * k + 1] for k in alike) >= 0.9 * len(alike)


def test_columns_of_the_working_tables_pass_through(spark):
    names = ["key", "d", "th", "line", "x", "y", "c", "n_lines", "cut_lines"]
    df = spark.createDataFrame([(1, "one two three four five six", *names), (2, "one two three four five six", *names)], ["doc_id", "text", *names])
    out = {r.doc_id: r for r in L.dedup_lines(df, bands=L.BANDS).collect()}
    assert out[1].text and out[2].text == "" and all(out[1][n] == n for n in names[:-2]) and out[2].n_lines == 1 and out[2].cut_lines == [0]


def test_query_matches_brute_force(spark):
    from paperloom.llm.queries import q_lines

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    hashes = {r.text: r.h for r in docs}
    want = brute([(r.doc_id, r.text) for r in docs], hashes, L.BANDS)
    got = {r.doc_id: r.cut_lines for r in q_lines.query(spark, sf).collect()}
    assert got == {r.doc_id: want.get((False, r.doc_id, r.h), []) for r in docs}
    plain = brute([(r.doc_id, r.text) for r in docs], hashes)
    assert sum(map(len, want.values())) > sum(map(len, plain.values())) > 100
