import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import common, compare_variants, grow_index
from paperloom.operators import growing as G
from paperloom.operators import search as R

ROOT = str(Path(__file__).resolve().parent.parent)
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def add(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(folder)


def rebuilt(spark, docs):
    return rows(G.term_counts(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "dl", "term", "tf"))


def test_index_grows_with_its_input(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    add(spark, docs, [(1, "a b a", "s"), (2, "c", "s"), (3, None, "s")])
    assert grow_index.run(spark, docs, out, mark) == {"batches": 1, "rows": 3, "documents": 3}
    first = rows(grow_index.result(spark, out))
    assert first == rebuilt(spark, [(1, "a b a"), (2, "c"), (3, None)])
    assert grow_index.run(spark, docs, out, mark) == {"batches": 0, "rows": 0, "documents": 0}
    assert rows(grow_index.result(spark, out)) == first
    add(spark, docs, [(4, "a d", "s"), (2, "c c e", "s")])  # one new, one replaced
    old = next(p for p in Path(docs).glob("part-*") if "c000" in p.name)
    os.utime(old, (1, 1))  # an old file time doesn't hide a file
    assert grow_index.run(spark, docs, out, mark)["rows"] in (2, 5)
    assert rows(grow_index.result(spark, out)) == rebuilt(spark, [(1, "a b a"), (2, "c c e"), (3, None), (4, "a d")])


def test_index_survives_a_lost_run(spark, tmp_path, monkeypatch):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    add(spark, docs, [(i, f"w{i} x", "s") for i in range(20)])
    write = G.write_segment

    def lost(*args, **more):
        write(*args, **more)
        raise RuntimeError("lost")

    monkeypatch.setattr(G, "write_segment", lost)
    with pytest.raises(Exception, match="lost"):
        grow_index.run(spark, docs, out, mark)
    monkeypatch.setattr(G, "write_segment", write)
    assert grow_index.run(spark, docs, out, mark)["rows"] == 20
    assert rows(grow_index.result(spark, out)) == rebuilt(spark, [(i, f"w{i} x") for i in range(20)])
    asked = spark.createDataFrame([(1, "w3 x")], "qid long, query string")
    whole = spark.createDataFrame([(i, f"w{i} x") for i in range(20)], "doc_id long, text string")
    assert rows(G.search(G.load(spark, out), asked, 5)) == rows(R.lexical_top(whole, asked, 5))


def test_variants_differ_where_names_matter(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    docs = [(i, ("제 1 장 apples\n" if i == 0 else "제 2 장 pears\n" if i == 20 else "") + " ".join(rng.choices(words, k=30)), "book") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    asked = [(1, " ".join(docs[5][1].split()[3:9])), (2, "pears"), (3, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    out = str(tmp_path / "out")
    compare_variants.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), out, {"top_k": 30})
    found = compare_variants.result(spark, out)
    pears = {v: {r.doc_id for r in found.filter(f"variant = '{v}' AND qid = 2").collect()} for v in ("plain", "headed")}
    assert pears == {"plain": {20}, "headed": set(range(20, 40))}  # the section's name reaches its later pages
    values = {(r.variant, r.type, r.metric): r.value for r in found.filter("metric IS NOT NULL").collect()}
    assert values["plain", None, "recall_1"] == 1.0 and values["headed", None, "n"] == 2.0 and values["headed", None, "ties"] + values["headed", None, "losses"] + values["headed", None, "wins"] == 2.0
    before = rows(found)
    compare_variants.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), out, {"top_k": 30})
    assert rows(compare_variants.result(spark, out)) == before
    assert {p.name for p in (tmp_path / "out" / "ranked").glob("variant=*")} == {"variant=plain", "variant=headed"}


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"partitions": 3}))
    assert common.config(spark, str(tmp_path / "c.json"), grow_index.DEFAULTS)["partitions"] == 3
    (tmp_path / "d.json").write_text(json.dumps({"partition": 3}))
    with pytest.raises(ValueError):
        common.config(spark, str(tmp_path / "d.json"), grow_index.DEFAULTS)
    for name, module in (("grow_index", grow_index), ("compare_variants", compare_variants)):
        common.config(spark, f"{ROOT}/jobs/{name}.json", module.DEFAULTS)


def test_command_line(spark, tmp_path):
    """A run in a process of its own leaves what the function leaves."""
    args = [f"--{k}={v}" for k, v in (("documents", f"{SF}/documents.parquet"), ("output", tmp_path / "cli"), ("checkpoint", tmp_path / "mark"), ("config", f"{ROOT}/jobs/grow_index.json"))]
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.grow_index", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 rows" in done.stderr
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert grow_index.result(spark, str(tmp_path / "cli")).exceptAll(G.term_counts(docs).select("doc_id", "dl", "term", "tf")).count() == 0
