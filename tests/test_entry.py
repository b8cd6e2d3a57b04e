from pathlib import Path

import __spark_entry__ as entry
import bench


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(bench.HEADLINE) <= set(queries)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["qid", "doc_id", "score", "rank"] and out.count() > 0


def test_without_llm():
    """The rest works where the llm folder is gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['paperloom.llm'] = None; import __spark_entry__ as e; assert 'hybrid_rrf' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(Path(__file__).parent.parent))


def test_sql_twins_agree(spark):
    """A few of the twins on the smallest tables; the driver runs all of them."""
    import glob
    import os

    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in ("chunk_text", "section_map", "hybrid_filtered_two_phase", "context_pack", "judge_metrics", "section_map_long_ids", "image_cap_ties", "stored_index_search", "dense_only_search", "judge_sample", "latency_window_percentiles"):
        a, b = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
        assert rows(a) == rows(b), name
