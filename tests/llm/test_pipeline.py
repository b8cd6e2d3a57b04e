import re

import pytest

import corpus_pipeline as P
from paperloom.llm import langid, lines, segment
from paperloom.llm.pieces import Vocabulary
import test_lines
import test_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, items):
    ws, hit = words(text), set()
    for item in map(words, items):
        n = min(13, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(ws)


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "x", 0), (900_002, "1234 5678", "en", "x", 9), (900_003, "", None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    outs, now = {}, docs
    for name, stage in P.STAGES:
        now = outs[name] = stage(spark, now, SF).cache()
        if name != P.STAGES[-1][0]:
            assert now.columns == COLUMNS
    before = docs.collect()
    kept = {r.doc_id for r in outs["language_id"].collect()}
    assert kept == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}

    rows = outs["language_id"].collect()
    hashes = {r.text: r.h for r in outs["language_id"].selectExpr("text", "xxhash64(text) h").collect()}
    cut = test_lines.brute([(r.doc_id, r.text) for r in rows], hashes, lines.BANDS)
    want = {}
    for r in rows:
        gone = cut.get((False, r.doc_id, hashes[r.text]), [])
        want[r.doc_id] = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone)
    got = {r.doc_id: r for r in outs["line_dedup"].collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    ids = sorted(want)
    least = test_simhash.brute_components(ids, [test_simhash.plain_fingerprint(want[d]) for d in ids])
    assert {r.doc_id for r in outs["simhash_dedup"].collect()} == set(least.values())

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in set(least.values()) if not contaminated(want[d], items)}
    assert {r.doc_id for r in outs["decontaminate"].collect()} == clean

    vocab = Vocabulary(open(P.MODEL, "rb").read())
    last = outs["sentencepiece"].collect()
    assert {r.doc_id for r in last} == clean
    for r in last:
        assert r.decodes and r.ids == (vocab.processor.encode(want[r.doc_id]) if want[r.doc_id] else [])


def test_run(spark):
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "other words here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in P.one_of_each_group(spark, docs, SF).collect()) == [0, 1]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_reused_ids_are_decided_by_text(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "quite other words than these"), (3, "one more text of its own"), (3, "and a second one under the same number"), (None, "a b c d")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.one_of_each_group(spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted((d or 0, t) for d, t in rows if (d, t) != rows[1])


@pytest.mark.parametrize("module", [langid, segment, P])
def test_docstrings_state_the_cases(module):
    assert "Defined cases" in module.__doc__


def test_other_columns_pass_through(spark):
    names = ["score", "n_cut", "spans", "_hash", "row", "n_hit", "lang_pred", "a b"]
    rows = [(1, "the first text about houses and trees", "en", "s", 5, *names), (1, "quite another text about cars", "en", "s", 5, *names), (2, "a b", "de", "s", 3, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == 3 and all(r[n] == n for r in got for n in names)


def test_very_long_texts(spark):
    long = " ".join(f"word{k % 5000}" for k in range(150_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + "\n" + "x" * 200_000, "en", "s", 1), (3, "a short text of its own", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r for r in P.distinct_lines(spark, docs, SF).collect()}
    assert cut[1].text == long and cut[2].text == "x" * 200_000 and cut[2].n_chars == 200_000
    assert {r.doc_id for r in P.one_of_each_group(spark, docs, SF).collect()} == {1, 3}
    assert {r.doc_id for r in P.known_language(spark, docs, SF).collect()} == {1, 2, 3}
    assert P.clean_of_benchmark(spark, docs, SF).count() == 3


def test_texts_in_no_known_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    one = {r.lang: r.text for r in docs.filter("lang IS NOT NULL AND length(text) BETWEEN 300 AND 600").collect()}
    strange = ["Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "Съешь же ещё этих мягких французских булок", "日本語の文章です", "한국어로 쓴 글입니다"]
    told = [one["de"] + "\n" + one["en"], one["fr"] + " " + strange[0], one["es"][:40]]
    more = spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in enumerate(strange + told, 1_000_000)], docs.schema)
    for labels in (("de", "en", "es", "fr"), ("de", "en")):
        own = docs.filter(docs.lang.isin(*labels))
        kept = {r.doc_id for r in P.known_language(spark, own.unionByName(more), SF).collect()}
        assert kept >= {r.doc_id for r in own.collect() if r.text and any(c.isalpha() for c in r.text)}
        assert not kept & set(range(1_000_000, 1_000_004)) and (len(labels) == 2 or kept >= {1_000_004, 1_000_005, 1_000_006})
