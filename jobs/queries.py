"""The jobs as registered queries: each runs twice into one new folder and returns the output after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import compare_variants, grow_index
from paperloom.plans import corpus, sql
from paperloom.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_grow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1_grow_index")
    for _ in range(2):
        grow_index.run(spark, f"{sf_dir}/documents.parquet", f"{out}/index", f"{out}/checkpoint")
    return grow_index.result(spark, f"{out}/index")


def job2_compare_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2_compare_variants")
    for _ in range(2):
        compare_variants.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return corpus.wide(compare_variants.result(spark, out))


def queries() -> dict:
    return {f.__name__: f for f in (job1_grow_index, job2_compare_variants)}


TITLED = f"""given AS (SELECT doc_id, doc_id // 400 AS file, source, coalesce(text, '') AS text, {sql.PAGE_ID} AS page_id FROM documents),
marked AS (SELECT *, {sql.TITLE} AS own FROM given),
sections AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY source, file ORDER BY doc_id ROWS UNBOUNDED PRECEDING), '') AS section FROM marked),
headed AS (SELECT doc_id, concat_ws(' ', substr(string_split(regexp_replace(page_id, '_[0-9]+$', ''), '/')[-1], 1, 80), nullif(section, '')) || chr(10) || text AS text FROM sections)"""


def _ranked(variant: str, source: str) -> str:
    """The ten best pages of each question over the texts of ``source``, and the gold page's place."""
    v = variant
    return f"""{v}_listed AS (SELECT doc_id, {sql.tokens("text")} AS t FROM {source}), {v}_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {v}_listed) GROUP BY ALL),
{v}_whole AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {v}_listed), {v}_df AS (SELECT term, count(*) AS df FROM {v}_tf GROUP BY term),
{v}_weights AS (SELECT tf.doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) AS weight FROM {v}_tf tf JOIN {v}_df USING (term) JOIN {v}_listed USING (doc_id), {v}_whole),
{v}_ranked AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id, round(sum(weight), 6) AS score FROM qterms JOIN {v}_weights USING (term) GROUP BY ALL)) WHERE rank <= 10),
{v}_gold AS (SELECT g.qid, 't' || CAST(g.qid % 3 AS VARCHAR) AS type, r.rank FROM gold_ g LEFT JOIN {v}_ranked r ON r.qid = g.qid AND r.doc_id = g.gold WHERE gold IS NOT NULL),
{v}_metrics AS (SELECT type, {", ".join(sql.metric(k) for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, CAST(count(*) AS DOUBLE) AS n FROM {v}_gold GROUP BY GROUPING SETS ((), (type)) HAVING count(*) > 0)"""


def _report(variant: str) -> str:
    names = [*(f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("recall", "ndcg")), "mrr", "n"]
    return " UNION ALL ".join(f"SELECT '{variant}' AS variant, type, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {variant}_metrics" for n in names)


def oracle_sql() -> dict[str, str]:
    lost = "coalesce({}.rank, 1000000)"
    cases = {"wins": "<", "losses": ">", "ties": "="}
    versus = " UNION ALL ".join(f"SELECT 'headed' AS variant, NULL AS type, '{n}' AS metric, CAST(count(*) FILTER ({lost.format('a')} {op} {lost.format('b')}) AS DOUBLE) AS value FROM headed_gold a JOIN plain_gold b USING (qid)" for n, op in cases.items())
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variant, qid, doc_id, score, rank, NULL AS type, NULL AS metric, NULL AS value FROM {v}_ranked" for v in ("plain", "headed"))
    return {
        "job1_grow_index": f"""WITH listed AS (SELECT doc_id, coalesce({sql.tokens("coalesce(text, '')")}, []) AS t FROM documents)
SELECT doc_id, dl, term, count(term) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS dl, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS term FROM listed) GROUP BY ALL""",
        "job2_compare_variants": f"""WITH {TITLED}, qterms AS (SELECT DISTINCT item_id AS qid, term FROM (SELECT item_id, unnest({sql.tokens("text")}) AS term FROM benchmark)), {sql.GOLD},
{_ranked("plain", "given")}, {_ranked("headed", "headed")}, report AS ({_report("plain")} UNION ALL {_report("headed")} UNION ALL {versus})
{rows} UNION ALL SELECT variant, NULL, NULL, NULL, NULL, type, metric, value FROM report""",
    }
