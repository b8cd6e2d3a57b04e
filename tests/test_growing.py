import random

from paperloom.operators import growing as G
from paperloom.operators import search as R


def texts(rng, n):
    words = ["alpha", "beta", "2023년", "보고서는", "x1", "gamma", "delta"] + [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grown_equals_rebuilt(spark, tmp_path):
    rng, path, now = random.Random(1), str(tmp_path / "index"), {}
    asked = spark.createDataFrame([(1, "alpha w3 w3 보고서"), (2, "w1 w2 none"), (3, "")], "qid long, query string")
    assert G.load(spark, path) is None
    for number in range(3):
        own = [(rng.randrange(60), t) for t in texts(rng, 30)] + [(200 + number, None), (300, "alpha " * (number + 1))]
        frame = spark.createDataFrame([*own, own[0], (None, "alpha")], "doc_id long, text string")
        G.write_segment(frame, path, number, partitions=3)
        for i, t in own:
            mine = [x for k, x in own if k == i]
            now[i] = max((x for x in mine if x is not None), default=None)
        whole = spark.createDataFrame(list(now.items()), "doc_id long, text string")
        assert rows(G.search(G.load(spark, path), asked, 5)) == rows(R.lexical_top(whole, asked, 5))
    before = rows(G.load(spark, path).current())
    G.write_segment(frame, path, 2, partitions=2)  # written again
    assert rows(G.load(spark, path).current()) == before
    G.compact(spark, path, str(tmp_path / "one"), partitions=2)
    one = G.load(spark, str(tmp_path / "one"))
    assert [r.segment for r in one.lengths.select("segment").distinct().collect()] == [2]
    assert rows(one.postings.drop("segment")) == rows(G.load(spark, path).current().drop("segment"))
    assert rows(G.search(one, asked, 5)) == rows(R.lexical_top(whole, asked, 5))
    more = spark.createDataFrame([(5, "alpha alpha"), (999, "w1")], "doc_id long, text string")
    G.write_segment(more, str(tmp_path / "one"), 3)
    now |= {5: "alpha alpha", 999: "w1"}
    whole = spark.createDataFrame(list(now.items()), "doc_id long, text string")
    assert rows(G.search(G.load(spark, str(tmp_path / "one")), asked, 5)) == rows(R.lexical_top(whole, asked, 5))


def test_only_asked_terms_are_weighed(spark, tmp_path):
    """Postings of other terms aren't read past the filter on terms; lengths alone tell the mean."""
    path = str(tmp_path / "index")
    G.write_segment(spark.createDataFrame([(i, t) for i, t in enumerate(texts(random.Random(2), 50))], "doc_id long, text string"), path, 0)
    terms = spark.createDataFrame([("alpha",)], "term string")
    got = {r.term for r in G.weights(G.load(spark, path), terms).collect()}
    assert got == {"alpha"}
