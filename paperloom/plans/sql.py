"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from paperloom.functions.text import ABSTAIN, CUT_MARK, PARTICLE_END, TABLE_MARK
from paperloom.sources.readers import STOP_PHRASES

KEY = "source || '/d' || CAST(doc_id // 400 AS VARCHAR)"
PAGE_ID = f"{KEY} || '_' || CAST(doc_id % 400 + 1 AS VARCHAR)"
HEAD = """CASE WHEN doc_id % 11 = 1 THEN '제 ' || CAST(doc_id % 9 + 1 AS VARCHAR) || ' 장 개요' || chr(10) WHEN doc_id % 13 = 1 THEN '1. 개요' || chr(10) || '2. 범위' || chr(10)
 WHEN doc_id % 17 = 1 THEN 'a..... 1' || chr(10) || 'b..... 2' || chr(10) || 'c..... 3' || chr(10) WHEN doc_id % 19 = 1 THEN '매출 30명을' || chr(10) ELSE '' END"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    stem = f"regexp_extract(x, '{PARTICLE_END}', 1)"
    parts = f"list_transform(regexp_extract_all(r, '[0-9]+|[a-z]+|[가-힣]+'), lambda x: CASE WHEN length(x) > 2 AND {stem} <> '' THEN [x, {stem}] ELSE [x] END)"
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '[0-9a-z가-힣]+'), lambda r: CASE WHEN regexp_full_match(r, '[0-9]+[가-힣]+') THEN [r, regexp_extract(r, '^[0-9]+')] ELSE flatten({parts}) END))"


PAGES = f"""pages_ AS (SELECT doc_id AS seq, doc_id, {PAGE_ID} AS id, {HEAD} || text AS text,
  CASE WHEN doc_id % 3 = 0 THEN documents.text ELSE '' END AS ocr, doc_id % 4 <> 3 AS has_image, (doc_id * 37 % 1000) / 100000.0 AS ink, {KEY} AS file FROM documents)"""
ROUTED = f"""{PAGES}, routed AS (SELECT *, CASE WHEN length({strip("text")}) >= 1500 THEN 'text' WHEN length({strip("ocr")}) >= 1000 THEN 'ocr' WHEN NOT has_image THEN 'blank'
  WHEN ink < 0.002 THEN 'blank' ELSE 'image' END AS route FROM pages_)"""
CAPPED = f"""{ROUTED}, capped AS (SELECT * REPLACE (CASE WHEN route = 'image' AND sum(CASE WHEN route = 'image' THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) > 20
  THEN 'image_overflow' ELSE route END AS route) FROM routed)"""
CAPTIONS = f"captions AS (SELECT {PAGE_ID} AS page_id, 'caption ' || text AS caption FROM documents WHERE doc_id % 2 = 0)"


def chunk_rows(source: str) -> str:
    read = "CASE WHEN ocr <> '' THEN ocr ELSE text END"
    body = f"CASE route WHEN 'text' THEN text WHEN 'ocr' THEN ocr WHEN 'image' THEN concat_ws(chr(10), nullif({strip('caption')}, ''), nullif({strip(read)}, '')) ELSE {read} END"
    path = r"CASE WHEN route IN ('image', 'ocr') THEN substr(regexp_replace(id, '[^\p{L}\p{N}]', '_', 'g'), 1, 150) || '.png' END"
    return f"""{CAPTIONS}, chunks_ AS (SELECT * FROM (SELECT id AS page_id, route, {body} AS text_for_embedding, id AS source_file, {path} AS image_path, seq AS doc_id
  FROM {source} LEFT JOIN captions ON captions.page_id = id WHERE route <> 'blank') WHERE {strip("text_for_embedding")} <> '')"""


EMPTY = rf"""CASE WHEN {strip("text")} = '' THEN true WHEN len(regexp_extract_all(text, '\.{{5,}}\s*\d+')) >= 3 THEN true WHEN route <> 'image' THEN false
  WHEN regexp_matches(text, '<그림|<표|표\s*:|\d{{1,3}}(?:[,.]\d+)*\s*(?:%|원|건|명|㎥|억|만|점|개|톤|kg|km|억원|만원)') THEN false
  WHEN regexp_matches(text, '\|[^\n]*\|[^\n]*\|') THEN false
  WHEN regexp_matches(text, '(?im)PART\s*\d+|^\s*제\s*\d+\s*[장부편]|^\s*[IVXLCM]{{1,4}}\s*[.\)]|다른\s*내용이\s*없습니다|표지(?:입니다|로 보입니다|를 나타)|cover page') THEN true
  WHEN len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches({strip("l")}, '^(?:#+\s*)?-?\s*\d+\.\s+\S'))) >= 2
    AND len(list_filter(string_split(text, chr(10)), lambda l: {strip("l")} <> '')) <= 20 THEN true
  ELSE length({strip("text")}) < 220 END"""
TITLE = rf"""substr(list_filter(list_transform(string_split(text, chr(10))[1:4], lambda l: {strip(f"regexp_replace({strip('l')}, '^#+', '')")}),
  lambda l: regexp_matches(l, '^(?:제\s*\d+\s*[장절편부]|[IVXLCM]{{1,4}}\s*[.\)]|\d{{1,2}}\.\s*[가-힣A-Za-z]|PART\s*\d+)'))[1], 1, 60)"""
SECTIONS = f"""{ROUTED}, marked_ AS (SELECT id, route, file, seq % 400 + 1 AS page_no, {EMPTY} AS no_content, {TITLE} AS own FROM routed),
sections_ AS (SELECT id, no_content, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY page_no, id ROWS UNBOUNDED PRECEDING), '') AS section_title,
  lag(id) OVER (PARTITION BY file ORDER BY page_no, id) AS prev_id, lead(id) OVER (PARTITION BY file ORDER BY page_no, id) AS next_id FROM marked_)"""

TF = f"listed AS (SELECT doc_id, {tokens('text')} AS t FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM listed) GROUP BY ALL)"
WEIGHTS = f"""{TF}, whole AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM listed), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT tf.doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) AS weight
  FROM tf JOIN df USING (term) JOIN listed USING (doc_id), whole)"""
QUERIES = rf"""asked AS (SELECT item_id AS qid, array_to_string(regexp_split_to_array(trim(b.text), '\s+'), ' ') AS query, CAST(embedding AS DOUBLE[]) AS v
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""
LEXICAL = f"""{WEIGHTS}, {QUERIES}, qterms AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({tokens("query")}) AS term FROM asked)),
lexical_all AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id, round(sum(weight), 6) AS score FROM qterms JOIN weights USING (term) GROUP BY ALL))"""
DENSE = """dense_all AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, vec_id AS doc_id, round(list_inner_product(v, CAST(embedding AS DOUBLE[])), 6) AS score FROM asked, embeddings WHERE vec_id IN (SELECT doc_id FROM documents)))"""


def fused(name: str, fetch: int, keep: str = "true", which: str = "true") -> str:
    """Fusion of the first ``fetch`` ranks over rows where ``keep`` holds, for queries where ``which`` does."""
    return f"""{name} AS (SELECT qid, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, dr NULLS LAST, lr NULLS LAST, doc_id) AS rank
  FROM (SELECT qid, doc_id, coalesce(1.0 / CAST(60 + d.rank AS DOUBLE), 0) + coalesce(1.0 / CAST(60 + l.rank AS DOUBLE), 0) AS s, d.rank AS dr, l.rank AS lr
    FROM (SELECT * FROM dense_all WHERE rank <= {fetch}) d FULL JOIN (SELECT * FROM lexical_all WHERE rank <= {fetch}) l USING (qid, doc_id)) WHERE {keep} AND {which})"""


HYBRID = f"{LEXICAL}, {DENSE}, {fused('fused_all', 10)}, hybrid AS (SELECT * FROM fused_all WHERE rank <= 10)"
RERANKED = f"""{HYBRID}, reranked AS (SELECT * FROM (SELECT qid, doc_id, score, fused_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank) AS rank
  FROM (SELECT h.qid, h.doc_id, h.rank AS fused_rank, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END, 6) AS score
    FROM hybrid h JOIN (SELECT qid, list_distinct({tokens("query")}) AS q FROM asked) USING (qid) JOIN listed USING (doc_id))) WHERE rank <= 5)"""
GOLD = "gold_ AS (SELECT item_id AS qid, min(d.doc_id) AS gold FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"
SYSTEMS = f"""{HYBRID}, systems AS (SELECT qid, 'dense' AS system, doc_id, rank, score FROM dense_all WHERE rank <= 10 UNION ALL SELECT qid, 'hybrid', doc_id, rank, score FROM hybrid
  UNION ALL SELECT qid, 'lexical', doc_id, rank, score FROM lexical_all WHERE rank <= 10)"""
GRADES = """pooled AS (SELECT DISTINCT qid, doc_id FROM systems WHERE rank <= 5), best_label AS (SELECT doc_id, max(2 * quality * (1 - toxic)) AS grade FROM labels GROUP BY doc_id),
grades AS (SELECT qid, doc_id, grade FROM pooled LEFT JOIN best_label USING (doc_id))"""
JUDGED = f"""{SYSTEMS}, {GRADES}, {GOLD}, wanted AS (SELECT qid, 'c' || CAST(qid % 2 AS VARCHAR) AS corpus, 't' || CAST(qid % 3 AS VARCHAR) AS type, gold, gold IS NOT NULL AS expect_answer FROM gold_)"""


FOLLOWING = """pid AS (SELECT doc_id, id FROM pages_), following_ AS (SELECT r.qid, s.next_id AS page_id FROM reranked r JOIN pid USING (doc_id) JOIN sections_ s ON s.id = pid.id
  LEFT JOIN sections_ n ON n.id = s.next_id WHERE r.rank = 1 AND s.next_id IN (SELECT page_id FROM chunks_) AND NOT coalesce(n.no_content, false)
  AND NOT EXISTS (SELECT 1 FROM reranked o JOIN pid p USING (doc_id) WHERE o.qid = r.qid AND p.id = s.next_id))"""


def drawn(rows: str, key: str) -> str:
    """Rows of (type, ``key``, query) with their places in the order of the seeded hash."""
    return f"SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5('20260917:' || CAST({key} AS VARCHAR)), {key}) AS place FROM ({rows})"


def ranks(source: str) -> str:
    return f"(SELECT g.qid, gold, 't' || CAST(g.qid % 3 AS VARCHAR) AS type, 'd' || CAST(g.qid % 4 AS VARCHAR) AS domain, r.rank FROM gold_ g LEFT JOIN {source} r ON r.qid = g.qid AND r.doc_id = g.gold WHERE gold IS NOT NULL)"


def metric(k: int) -> str:
    return f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}"


def place(values: str, share: float) -> str:
    return f"round({values}[CAST(least(floor(len({values}) * {share}), len({values}) - 1) AS BIGINT) + 1], 3)"


def raw_place(values: str, share: float) -> str:
    return f"{values}[CAST(least(floor(len({values}) * {share}), len({values}) - 1) AS BIGINT) + 1]"


def filtered_search(lexical: str, dense: str, keep: str) -> str:
    """Fusion of ten ranks of each list, or of thirty where that leaves a query short, over pages where ``keep`` holds; follows WITH."""
    return f"""{lexical}, {dense}, {fused("near_", 10, keep)}, sizes AS (SELECT qid, count(n.doc_id) AS n FROM asked LEFT JOIN near_ n USING (qid) GROUP BY qid),
{fused("wide_", 30, keep, "qid IN (SELECT qid FROM sizes WHERE n < 10)")}, longer AS (SELECT w.qid FROM wide_ w JOIN sizes USING (qid) GROUP BY w.qid, n HAVING count(*) > n)
SELECT qid, doc_id, score, rank FROM near_ WHERE rank <= 10 AND qid NOT IN (SELECT qid FROM longer) UNION ALL SELECT qid, doc_id, score, rank FROM wide_ WHERE rank <= 10 AND qid IN (SELECT qid FROM longer)"""


def oracles() -> dict[str, str]:
    filing = "'dart/Corp_2023_' || lpad(CAST(doc_id AS VARCHAR), 14, '0') || '_' || CASE WHEN doc_id % 2 = 0 THEN '[Company' || CAST(doc_id % 7 AS VARCHAR) || ']' ELSE 'x' END || 'Report_' || CAST(doc_id % 400 + 1 AS VARCHAR)"
    title = "substr(string_split(regexp_replace(page_id, '_[0-9]+$', ''), '/')[-1], 1, 80)"
    abstain_pieces = rf"list_filter(string_split(regexp_replace(answer, '([.!?\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: NOT contains(s, '{ABSTAIN}'))"
    kept = strip(f"array_to_string({abstain_pieces}, '')")
    chars = f"string_split({strip('answer')}, '')"
    stop = " OR ".join(f"contains(query, '{s}')" for s in STOP_PHRASES)
    sorted_values = "list_sort(list(value))"
    barred = "doc_id % 3 <> 0"
    cut = f"CASE WHEN length(c.text) <= least(2500, p.budget) THEN c.text ELSE substr(c.text, 1, CAST(least(2500, p.budget) AS BIGINT)) || '{CUT_MARK}' END"
    skip = "(p.budget <= 0 OR (c.image_path IS NOT NULL AND list_contains(p.images, c.image_path)))"
    return {
        "route_pages": f"WITH {ROUTED} SELECT id, route FROM routed",
        "route_stats": f"""WITH {CAPPED} SELECT count(*) AS total, count(*) FILTER (route = 'text') AS text_route, count(*) FILTER (route = 'ocr') AS ocr_route, count(*) FILTER (route = 'image') AS image_route,
  count(*) FILTER (route = 'blank') AS blank_skipped, count(*) FILTER (route = 'image_overflow') AS image_overflow_route FROM capped""",
        "image_cap_overflow": f"WITH {CAPPED} SELECT id, route FROM capped",
        "chunk_text": f"WITH {CAPPED}, {chunk_rows('capped')} SELECT page_id, route, text_for_embedding, source_file, image_path FROM chunks_",
        "doc_prefix": rf"""WITH {SECTIONS}, rows_ AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {filing} ELSE {PAGE_ID} END AS page_id, text AS document, nullif(s.section_title, '') AS title FROM documents LEFT JOIN sections_ s ON s.id = {PAGE_ID}),
known AS (SELECT lpad(CAST(doc_id AS VARCHAR), 14, '0') AS r, 'Report ' || CAST(doc_id % 10 AS VARCHAR) || ' (2023.12)' AS nm FROM documents WHERE doc_id % 6 = 0),
named AS (SELECT rows_.*, CASE WHEN page_id LIKE 'dart/%' THEN coalesce(nullif(concat_ws(' ', nullif(regexp_extract(page_id, '(\[[^\]]+\])', 1), ''), nm), ''), {title}) ELSE {title} END AS prefix
  FROM rows_ LEFT JOIN known ON r = regexp_extract(page_id, '^dart/.+?_[0-9]{{4}}_([0-9]{{14}})_', 1))
SELECT doc_id, page_id, prefix, CASE WHEN concat_ws(' ', nullif(prefix, ''), title) <> '' THEN concat_ws(' ', nullif(prefix, ''), title) || chr(10) || document ELSE document END AS lexical_text FROM named""",
        "page_no_content": f"WITH {SECTIONS} SELECT id, no_content FROM marked_",
        "section_title": f"WITH {SECTIONS} SELECT id, own AS section_title FROM marked_",
        "section_map": f"WITH {SECTIONS} SELECT * FROM sections_",
        "section_stats": f"""WITH {SECTIONS}, s AS (SELECT count(*) AS pages, count(*) FILTER (route = 'image') AS image_pages, count(*) FILTER (s.no_content) AS no_content_pages,
  count(*) FILTER (s.no_content AND route = 'image') AS no_content_image_pages, count(*) FILTER (section_title <> '') AS titled_pages FROM routed JOIN sections_ s USING (id))
SELECT *, coalesce(round(no_content_pages / nullif(pages, 0), 4), 0.0) AS no_content_share, coalesce(round(no_content_image_pages / nullif(image_pages, 0), 4), 0.0) AS no_content_image_share FROM s""",
        "term_frequencies": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
        "document_frequencies": f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
        "bm25_weights": f"WITH {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
        "bm25_topk": f"WITH {LEXICAL} SELECT qid, doc_id, score, rank FROM lexical_all WHERE rank <= 10",
        "vector_topk": """SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS qid, e.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
        "hybrid_rrf": f"WITH {HYBRID} SELECT qid, doc_id, score, rank FROM hybrid",
        "hybrid_filtered_two_phase": "WITH " + filtered_search(LEXICAL, DENSE, barred),
        "rerank_topn": f"WITH {RERANKED} SELECT qid, doc_id, score, rank, fused_rank FROM reranked",
        "neighbor_expand": f"WITH {RERANKED}, {SECTIONS}, {chunk_rows('routed')}, {FOLLOWING} SELECT * FROM following_",
        "context_pack": f"""WITH RECURSIVE {RERANKED}, {SECTIONS}, {chunk_rows("routed")}, {FOLLOWING},
given AS (SELECT qid, rank, doc_id FROM reranked UNION ALL SELECT f.qid, 99, p.doc_id FROM following_ f JOIN pid p ON p.id = f.page_id),
ranked AS (SELECT qid, rank, text_for_embedding AS text, source_file, image_path, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM given JOIN chunks_ USING (doc_id)),
own_ AS (SELECT qid, coalesce(list(image_path ORDER BY rank) FILTER (image_path IS NOT NULL AND rank <= 2), []) AS images FROM ranked GROUP BY qid),
shown AS (SELECT o.qid, CASE WHEN r.image_path IS NOT NULL AND NOT list_contains(o.images, r.image_path) AND len(o.images) < 3 THEN list_append(o.images, r.image_path) ELSE o.images END AS images
  FROM own_ o LEFT JOIN ranked r ON r.qid = o.qid AND r.rank = 99),
packed AS (SELECT qid, CAST(0 AS BIGINT) AS n, images, CAST(greatest(CAST(trunc((3396 - 1500 * len(images)) * 1.5) AS BIGINT), 300) AS BIGINT) AS budget, CAST([] AS VARCHAR[]) AS parts FROM shown
  UNION ALL SELECT p.qid, c.n, p.images, CASE WHEN {skip} THEN p.budget ELSE p.budget - length({cut}) END,
    CASE WHEN {skip} THEN p.parts ELSE list_append(p.parts, '[출처: ' || c.source_file || ']' || chr(10) || {cut}) END FROM packed p JOIN ranked c ON c.qid = p.qid AND c.n = p.n + 1)
SELECT qid, array_to_string(parts, chr(10) || chr(10)) AS context, (SELECT string_agg(source_file, ',' ORDER BY n) FROM ranked r WHERE r.qid = p.qid) AS sources, budget AS budget_left
FROM packed p WHERE n = (SELECT max(n) FROM packed m WHERE m.qid = p.qid)""",
        "strip_abstention": f"""WITH said AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 0 THEN text || ' {ABSTAIN}.' WHEN turn % 4 = 1 THEN text || chr(10) || '{ABSTAIN}' WHEN turn % 4 = 2 THEN '{ABSTAIN}. ' || text ELSE text END AS answer FROM conversations)
SELECT conv_id, turn, role, CASE WHEN contains(answer, '{ABSTAIN}') AND length({kept}) >= 40 THEN {kept} ELSE answer END AS answer FROM said""",
        "degenerate_output": f"""WITH said AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 0 THEN text || repeat('@', 5 * length(text) + 8) WHEN turn % 4 = 1 THEN repeat('a', 3 * length(text)) || text ELSE text END AS answer FROM conversations),
cut AS (SELECT *, {strip("answer")} AS s, {chars} AS c FROM said)
SELECT conv_id, turn, role, CASE WHEN length(s) < 8 THEN false ELSE len(list_distinct(c)) <= 2 OR list_max(list_transform(list_distinct(c), lambda k: len(list_filter(c, lambda x: x = k)))) / length(s) > 0.8 END AS degenerate FROM cut""",
        "ir_metrics_by_group": f"""WITH {LEXICAL}, {GOLD}, r AS {ranks("(SELECT * FROM lexical_all WHERE rank <= 10)")}
SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'overall' END AS grouping, type, domain, {", ".join(metric(k) for k in (1, 3, 5, 10))},
  round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (type), (domain)) HAVING count(*) > 0""",
        "judge_pool": f"""WITH {SYSTEMS} SELECT qid, doc_id, arg_min(system, CAST(rank AS VARCHAR) || system) AS first_system, string_agg(system || '=' || CAST(rank AS VARCHAR), ',' ORDER BY system) AS ranks FROM systems WHERE rank <= 5 GROUP BY qid, doc_id""",
        "grade_upsert": f"""WITH {SYSTEMS}, {GRADES}, old AS (SELECT * FROM grades WHERE doc_id % 2 = 0)
SELECT qid, doc_id, CAST(coalesce(old.grade, -1) AS BIGINT) AS grade FROM old FULL JOIN pooled USING (qid, doc_id)""",
        "judge_metrics": f"""WITH {JUDGED}, filled AS (SELECT qid, doc_id, coalesce(grade, 0) AS grade FROM grades),
ideal AS (SELECT qid, sum(grade / log2(p + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS p FROM filled) WHERE p <= 5 GROUP BY qid),
per AS (SELECT system, s.qid, corpus || '/' || type AS bucket, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg, max(CASE WHEN coalesce(grade, 0) >= 2 THEN 1.0 ELSE 0.0 END) AS recall,
  count(*) FILTER (coalesce(grade, 0) = 0) / count(*) AS irrelevant, max(CASE WHEN s.doc_id = gold THEN 1.0 ELSE 0.0 END) AS in_top
  FROM systems s JOIN wanted w ON w.qid = s.qid AND expect_answer LEFT JOIN filled f ON f.qid = s.qid AND f.doc_id = s.doc_id WHERE rank <= 5 GROUP BY ALL)
SELECT system, coalesce(bucket, 'all') AS bucket, count(*) AS n, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg END), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(irrelevant), 6) AS irrelevant,
  round(avg(in_top), 6) AS gold_in_top FROM per LEFT JOIN ideal USING (qid) GROUP BY GROUPING SETS ((system), (system, bucket))""",
        "no_answer_fp": f"""WITH {JUDGED} SELECT system, count(*) AS n, count(*) FILTER (top > 0) AS false_positives FROM (SELECT system, s.qid, max(coalesce(grade, 0)) AS top
  FROM systems s JOIN wanted w ON w.qid = s.qid AND NOT expect_answer LEFT JOIN grades g ON g.qid = s.qid AND g.doc_id = s.doc_id WHERE rank <= 5 GROUP BY ALL) GROUP BY system""",
        "win_loss_tie": f"""WITH {HYBRID}, {GOLD}, a AS {ranks("hybrid")}, b AS {ranks("(SELECT * FROM lexical_all WHERE rank <= 10)")}
SELECT count(*) FILTER (coalesce(a.rank, 1000000) < coalesce(b.rank, 1000000)) AS wins, count(*) FILTER (coalesce(a.rank, 1000000) > coalesce(b.rank, 1000000)) AS losses,
  count(*) FILTER (coalesce(a.rank, 1000000) = coalesce(b.rank, 1000000)) AS ties, count(*) AS n FROM a JOIN b USING (qid)""",
        "abstain_signals": f"""WITH {SYSTEMS}, {GRADES}, l AS (SELECT s.*, g.grade, d.source FROM systems s JOIN documents d USING (doc_id) LEFT JOIN grades g ON g.qid = s.qid AND g.doc_id = s.doc_id WHERE system = 'lexical' AND rank <= 5)
SELECT qid, arg_min(doc_id, rank) AS top_page, arg_min(round(score, 4), rank) AS top_score, CAST(coalesce(max(grade) FILTER (rank = 1), -1) AS BIGINT) AS top_grade, round(max(round(score, 4)) FILTER (rank = 1) - max(round(score, 4)) FILTER (rank = 2), 4) AS margin,
  count(DISTINCT source) AS n_documents, string_agg(coalesce(CAST(grade AS VARCHAR), '-'), ',' ORDER BY rank) AS grades FROM l GROUP BY qid""",
        "latency_percentiles": f"SELECT event_type, count(value) AS n, {place(sorted_values, 0.5)} AS p50, {place(sorted_values, 0.95)} AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
        "latency_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS largest FROM events GROUP BY ALL",
        "sparse_page_stats": f"WITH {PAGES} SELECT file, count(*) AS pages, count(*) FILTER (length({strip('text')}) < 100) AS sparse_pages FROM pages_ GROUP BY ROLLUP (file)",
        "stratified_sample": "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260917:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 5",
        "resume_worklist": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "dedupe_latest": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type <> '' GROUP BY user_id",
        "stop_phrase_filter": f"""SELECT conv_id, turn, length(query) AS n_chars FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '이 표 ' || text WHEN turn % 3 = 1 THEN '  ' || text ELSE text END AS query FROM conversations) WHERE length(trim(query)) > 0 AND NOT ({stop})""",
        "new_filings": """WITH listed AS (SELECT CAST(page_id % 50 AS VARCHAR) AS rcept_no, CASE WHEN page_id % 4 = 0 THEN 'other' ELSE 'annual report' END AS report_nm, 'f' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '.xls' END AS name,
  'https://x.example/a?rcp=' || CAST(page_id % 50 AS VARCHAR) || '&dcm_no=' || CAST(page_id AS VARCHAR) AS url FROM pages),
few AS (SELECT *, row_number() OVER (PARTITION BY rcept_no ORDER BY name, url) AS place FROM listed WHERE contains(report_nm, 'annual') AND lower(name) LIKE '%.pdf')
SELECT url, rcept_no, report_nm, name, place, regexp_extract(url, 'dcm_no=([0-9]+)', 1) AS dcm_no FROM few WHERE place <= 3 AND url NOT IN (SELECT url FROM listed WHERE name LIKE 'f1%')""",
        "ocr_lookup": f"WITH {PAGES} SELECT id, {strip('coalesce(nullif(ocr, $q$$q$), text)')} AS text FROM pages_ WHERE doc_id % 2 = 0".replace("$q$$q$", "''"),
        "table_merge": rf"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || chr(10) || '{TABLE_MARK}' || chr(10) || '| a | b |' ELSE text END AS text,
  string_split({strip("documents.text")}, chr(10))[1] AS first_line FROM documents""",
        "text_budget": "SELECT page_id, i AS images, CAST(greatest(trunc((3396 - 1500 * i) * 1.5), 300) AS BIGINT) AS budget FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<(img|a) ')) AS BIGINT) AS i FROM pages)",
        "image_cap_ties": f"""WITH {ROUTED} SELECT id, CASE WHEN route = 'image' AND sum(CASE WHEN route = 'image' THEN 1 ELSE 0 END) OVER (ORDER BY seq % 50, id ROWS UNBOUNDED PRECEDING) > 20
  THEN 'image_overflow' ELSE route END AS route FROM routed""",
        "section_map_long_ids": f"""WITH {ROUTED}, marked_ AS (SELECT 'long/d' || CAST(seq // 400 AS VARCHAR) AS file, CAST(seq * 1000003 AS VARCHAR) || lpad(CAST(seq AS VARCHAR), 30, '0') AS number, {EMPTY} AS no_content, {TITLE} AS own FROM routed),
sized AS (SELECT *, file || '_' || number AS id, regexp_replace(number, '^0+(.)', '\\1') AS digits FROM marked_)
SELECT id, no_content, coalesce(last_value(own IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), '') AS section_title, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM sized
WINDOW w AS (PARTITION BY file ORDER BY length(digits), digits, id)""",
        "stored_index_search": f"WITH {HYBRID} SELECT qid, doc_id, score, rank FROM hybrid",
        "block_postings_search": f"WITH {LEXICAL} SELECT qid, doc_id, score, rank FROM lexical_all WHERE rank <= 10",
        "stored_filtered_search": f"""WITH paged AS (SELECT {PAGE_ID} AS doc_id, doc_id AS number, text FROM documents), pvec AS (SELECT p.doc_id AS vec_id, embedding FROM embeddings e JOIN paged p ON p.number = e.vec_id),
{filtered_search(LEXICAL.replace("FROM documents", "FROM paged"), DENSE.replace("embeddings WHERE vec_id IN (SELECT doc_id FROM documents)", "pvec") + f", {SECTIONS}", "doc_id NOT IN (SELECT id FROM sections_ WHERE no_content)").replace("SELECT qid, doc_id, score, rank", "SELECT qid, doc_id AS page_id, score, rank")}""",
        "grown_index_search": f"WITH {LEXICAL} SELECT qid, doc_id, score, rank FROM lexical_all WHERE rank <= 10",
        "dense_only_search": f"WITH {QUERIES}, {DENSE} SELECT qid, doc_id, round(1.0 / CAST(60 + rank AS DOUBLE), 9) AS score, rank FROM dense_all WHERE rank <= 10",
        "pool_entries": f"""WITH {SYSTEMS}, {GOLD}, pooled AS (SELECT DISTINCT qid, doc_id FROM systems WHERE rank <= 5)
SELECT qid, p.doc_id, substr(d.text, 1, 1500) AS snippet, coalesce(p.doc_id = gold, false) AS is_gold FROM pooled p LEFT JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN gold_ USING (qid)""",
        "result_urls": f"WITH {ROUTED}, {chunk_rows('routed')} SELECT page_id, CASE WHEN doc_id % 4 <> 1 THEN '/pages/' || image_path END AS image_url FROM chunks_",
        "variant_text": f"""WITH {ROUTED}, {CAPTIONS}, read_ AS (SELECT id, {strip("coalesce(nullif(ocr, $q$$q$), text)")} AS text FROM pages_ WHERE doc_id % 2 = 0)
SELECT r.id AS page_id, CASE WHEN route = 'image' THEN coalesce(nullif(concat_ws(chr(10), nullif({strip("caption")}, $q$$q$), nullif(read_.text, $q$$q$)), $q$$q$), r.text) ELSE r.text END AS document
FROM routed r LEFT JOIN captions ON captions.page_id = r.id AND length(captions.page_id) % 2 = 0 LEFT JOIN read_ ON read_.id = r.id""".replace("$q$$q$", "''"),
        "judge_sample": f"""WITH qa AS ({drawn("SELECT doc_id AS id, coalesce(lang, '-') AS type, text AS query FROM documents", "id")}),
made AS ({drawn(f"SELECT {PAGE_ID} AS page_id, 'image' AS type, 'about ' || text AS query FROM documents WHERE doc_id % 2 = 0", "page_id")}),
every AS (SELECT 1 AS part, 'pages' AS corpus, 'qa' AS source, type, query, CAST(id AS VARCHAR) AS gold, true AS expect_answer, place FROM qa WHERE place <= 5
  UNION ALL SELECT 2, 'pages', 'synthetic', type, query, page_id, true, place FROM made WHERE place <= 15 UNION ALL SELECT 3, 'filings', 'manual', 'manual', 'm' || CAST(i AS VARCHAR), NULL, i > 0, i FROM range(3) t(i))
SELECT CASE WHEN n < 10 THEN 'J0' ELSE 'J' END || CAST(n AS VARCHAR) AS sample_id, corpus, source, type, query, gold, expect_answer
FROM (SELECT *, row_number() OVER (ORDER BY part, type, place) AS n FROM every)""",
        "caption_report": f"""WITH log_ AS (SELECT CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS caption, value FROM events), made AS (SELECT value FROM log_ WHERE coalesce(caption, '') <> '')
SELECT (SELECT count(*) FROM made) AS captioned, (SELECT count(*) FROM log_ WHERE coalesce(caption, '') = '') AS failed, round(avg(value), 6) AS mean_sec, {sorted_values}[CAST(least(floor(len({sorted_values}) * 0.95), len({sorted_values}) - 1) AS BIGINT) + 1] AS p95_sec FROM made WHERE value IS NOT NULL""",
        "filing_window": """WITH listed AS (SELECT page_id, 'c' || CAST(page_id % 5 AS VARCHAR) AS corp, DATE '2022-01-01' + CAST(page_id % 900 AS INTEGER) AS filed FROM pages),
wanted AS (SELECT 'c' || CAST(i % 4 AS VARCHAR) AS corp, 2021 + i % 3 AS year FROM range(12) t(i))
SELECT page_id, corp, CAST(year AS BIGINT) AS year, CAST(CAST(filed AS DATE) AS VARCHAR) AS filed FROM listed JOIN wanted USING (corp) WHERE filed BETWEEN make_date(year + 1, 1, 1) AND make_date(year + 1, 6, 30)""",
        "receipt_dates": """SELECT doc_id, CAST(CAST(try_strptime(CAST(2020 + doc_id % 5 AS VARCHAR) || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 31 + 1 AS VARCHAR), 2, '0'), '%Y%m%d') AS DATE) AS VARCHAR) AS received FROM documents""",
        "encoded_images": "SELECT doc_id, base64(encode(text)) AS content FROM documents",
        "fitted_sizes": f"""WITH s AS (SELECT doc_id, length(text) * 37 % 4000 + 1 AS w, length(text) * 91 % 5000 + 1 AS h, CAST(1280 AS DOUBLE) / greatest(length(text) * 37 % 4000 + 1, length(text) * 91 % 5000 + 1) AS k FROM documents)
SELECT doc_id, {", ".join(f"CASE WHEN greatest(w, h) <= 1280 THEN {x} ELSE greatest(CAST(round_even({x} * k, 0) AS BIGINT), 1) END AS {n}" for x, n in (("w", "width"), ("h", "height")))} FROM s""",
        "first_documents": "SELECT doc_id, length(text) AS n FROM documents ORDER BY doc_id LIMIT 100",
        "windows_of_counts": f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(value) AS n, {raw_place(sorted_values, 0.5)} AS p50, {raw_place(sorted_values, 0.95)} AS p95
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
        "latency_window_percentiles": f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(value) AS n, {raw_place(sorted_values, 0.5)} AS p50, {raw_place(sorted_values, 0.95)} AS p95
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    }
