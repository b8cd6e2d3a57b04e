import random

from paperloom.llm import components as C


def classes(n, links):
    forest = C.Forest()
    for a, b in links:
        forest.join(a, b)
    return {i: forest.root(i) for i in range(n)}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(100, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    rng.shuffle(links)
    df = spark.createDataFrame(links + [(5, 6)], "a long, b long").repartition(6)
    got = {r.node: r.component for r in C.components(df).collect()}
    want = {n: c for n, c in classes(400, links).items() if n != c}
    assert got == want


def linked(rng):
    links = [(i + 1, i) for i in range(0, 90)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    rng.shuffle(links)
    return links, {n: c for n, c in classes(400, links).items() if n != c}


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Links that one forest holds are not joined with their nodes in round after round."""
    links, want = linked(random.Random(5))
    stored, plans = C.stored, []

    def seen(df, what):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, what)

    monkeypatch.setattr(C, "stored", seen)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    assert {r.node: r.component for r in C.components(df).collect()} == want
    assert plans and not any("Join" in p for p in plans)


def test_rounds_until_few_links_are_left(spark, monkeypatch):
    links, want = linked(random.Random(6))
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    for held in (1, 50, len(want), len(want) + 20):
        monkeypatch.setattr(C, "HELD", held)
        rows = C.components(df).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert C.components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0
