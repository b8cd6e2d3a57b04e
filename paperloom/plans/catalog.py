"""Registered queries of the retrieval engine and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.functions import sections as S
from paperloom.functions import text as X
from paperloom.operators import blocks as B
from paperloom.operators import context as C
from paperloom.operators import evaluate as E
from paperloom.operators import growing as G
from paperloom.operators import index as I
from paperloom.operators import pages as P
from paperloom.operators import search as R
from paperloom.operators.models import nfkc
from paperloom.params import DEFAULT
from paperloom.plans import corpus as D
from paperloom.plans import sql
from paperloom.session import kept, shared_dir, table
from paperloom.sources import readers
from paperloom.streaming import latency


def route_pages(spark, d):
    return D.routed(spark, d).select("id", "route")


def route_stats(spark, d):
    return P.route_stats(P.cap_images(D.routed(spark, d), 20))


def image_cap_overflow(spark, d):
    return P.cap_images(D.routed(spark, d), 20).select("id", "route")


def chunk_text(spark, d):
    return P.chunks(P.cap_images(D.routed(spark, d), 20), D.captions(spark, d))


def doc_prefix(spark, d):
    docs = table(spark, d, "documents")
    titles = P.section_map(D.records(spark, d)).select("id", "section_title")
    rows = docs.selectExpr("doc_id", f"{D.PAGE_ID} AS id", f"CASE WHEN doc_id % 3 = 0 THEN {D.FILING_ID} ELSE {D.PAGE_ID} END AS page_id", "text AS document").join(titles, "id", "left")
    manifest = docs.filter("doc_id % 6 = 0").selectExpr("lpad(cast(doc_id as string), 14, '0') AS rcept_no", "concat('Report ', doc_id % 10, ' (2023.12)') AS report_nm")
    return P.lexical_text(P.with_prefix(rows, manifest)).select("doc_id", "page_id", "prefix", "lexical_text")


def page_no_content(spark, d):
    return D.records(spark, d).select("id", S.no_content(F.col("document"), F.col("route")).alias("no_content"))


def section_title(spark, d):
    return D.records(spark, d).select("id", S.section_title(F.col("document")).alias("section_title"))


def section_map(spark, d):
    return P.section_map(D.records(spark, d))


def section_stats(spark, d):
    rows = D.records(spark, d)
    return P.section_stats(rows, P.section_map(rows))


def term_frequencies(spark, d):
    return R.term_frequencies(D.documents(spark, d))


def document_frequencies(spark, d):
    return R.document_frequencies(R.term_frequencies(D.documents(spark, d)))


def bm25_weights(spark, d):
    return R.postings(D.documents(spark, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def bm25_topk(spark, d):
    return R.lexical_top(D.documents(spark, d), D.queries(spark, d), DEFAULT.top_k)


def vector_topk(spark, d):
    all_ = table(spark, d, "embeddings")
    asked = all_.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vec"))
    return R.dense_top(all_, asked, DEFAULT.top_k)


def hybrid_rrf(spark, d):
    return R.search(D.documents(spark, d), D.vectors(spark, d), D.queries(spark, d), "doc_id")


def hybrid_filtered_two_phase(spark, d):
    barred = D.documents(spark, d).filter("doc_id % 3 = 0").select("doc_id")
    return R.search(D.documents(spark, d), D.vectors(spark, d), D.queries(spark, d), "doc_id", D.FILTERED, barred)


def _reranked(spark, d):
    found = kept(hybrid_rrf(spark, d).drop("score"), "found")  # of known size: texts stay where they are
    return R.rerank(D.documents(spark, d).join(found, "doc_id").join(D.queries(spark, d).select("qid", "query"), "qid"), "doc_id")


def rerank_topn(spark, d):
    return _reranked(spark, d)


def _page_ids(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{D.PAGE_ID} AS page_id")


def _ranked_pages(spark, d):
    return kept(_reranked(spark, d).join(_page_ids(spark, d), "doc_id"), "ranked")


def _chunks_of(spark, d, ids):
    """Chunks of a few pages: only those are made."""
    return P.chunks(P.route(D.pages(spark, d).join(ids.select(F.col("page_id").alias("id")).distinct(), "id", "left_semi"), D.LONG), D.captions(spark, d))


def _neighbors(spark, d, ranked):
    sections = P.section_map(D.records(spark, d))
    following = ranked.filter("rank = 1").select(F.col("page_id").alias("id")).join(sections, "id").select(F.col("next_id").alias("page_id"))
    return R.add_neighbor(ranked, sections, _chunks_of(spark, d, following).select("page_id"))


def neighbor_expand(spark, d):
    return _neighbors(spark, d, _ranked_pages(spark, d))


def context_pack(spark, d):
    ranked = _ranked_pages(spark, d).select("qid", "rank", "page_id")
    following = kept(_neighbors(spark, d, ranked).select("qid", "page_id"), "following")
    both = C.with_neighbor(ranked, following)
    texts = _chunks_of(spark, d, both).select("page_id", F.col("text_for_embedding").alias("text"), "source_file", "image_path")
    rows = kept(both.join(texts, "page_id"), "packed-chunks")
    own, more = rows.join(following, ["qid", "page_id"], "left_anti"), rows.join(following, ["qid", "page_id"], "left_semi")
    packed = C.pack(rows.drop("page_id"), C.choose_images(own, more))
    return packed.select("qid", "context", F.array_join("sources", ",").alias("sources"), "budget_left")


def strip_abstention(spark, d):
    said = f"CASE WHEN turn % 4 = 0 THEN concat(text, ' {X.ABSTAIN}.') WHEN turn % 4 = 1 THEN concat(text, chr(10), '{X.ABSTAIN}') WHEN turn % 4 = 2 THEN concat('{X.ABSTAIN}. ', text) ELSE text END"
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", f"{said} AS answer")
    return rows.select("conv_id", "turn", "role", X.without_abstention(F.col("answer")).alias("answer"))


def degenerate_output(spark, d):
    said = "CASE WHEN turn % 4 = 0 THEN concat(text, repeat('@', 5 * length(text) + 8)) WHEN turn % 4 = 1 THEN concat(repeat('a', 3 * length(text)), text) ELSE text END"
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", f"{said} AS answer")
    return rows.select("conv_id", "turn", "role", X.degenerate(F.col("answer")).alias("degenerate"))


def _gold_ranks(spark, d, ranked):
    asked = D.gold(spark, d).filter("gold IS NOT NULL").selectExpr("qid", "gold", "concat('t', qid % 3) AS type", "concat('d', qid % 4) AS domain")
    return E.gold_ranks(asked, ranked, "doc_id")


def ir_metrics_by_group(spark, d):
    return E.metrics_by_group(_gold_ranks(spark, d, bm25_topk(spark, d)), "type", "domain")


def _systems(spark, d):
    docs, asked = D.documents(spark, d), D.queries(spark, d)
    dense = kept(R.dense_top(D.vectors(spark, d), asked, DEFAULT.top_k, "doc_id"), "dense")
    lexical = kept(R.lexical_top(docs, asked, DEFAULT.top_k), "lexical")
    fused = R.fuse(dense, lexical, "doc_id", DEFAULT.top_k)
    return kept(R.union([x.select("qid", F.lit(n).alias("system"), "doc_id", "rank", "score") for n, x in (("dense", dense), ("hybrid", fused), ("lexical", lexical))]), "systems")


def judge_pool(spark, d):
    pooled = E.pool(_systems(spark, d), "doc_id")
    ranks = F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return pooled.select("qid", "doc_id", "first_system", ranks.alias("ranks"))


def grade_upsert(spark, d):
    """A stored table of grades, merged with the pool: what it had stays, what is new has no grade."""
    pooled, path = E.pool(_systems(spark, d), "doc_id"), f"{shared_dir(spark)}/grades-{uuid.uuid4().hex}"
    old = D.grades(spark, d, pooled).filter("doc_id % 2 = 0")
    E.upsert_grades(spark, path, old, "doc_id")
    E.set_grades(spark, path, old, "doc_id")
    E.upsert_grades(spark, path, pooled, "doc_id")
    return spark.read.parquet(path).select("qid", "doc_id", F.coalesce("grade", F.lit(-1)).alias("grade"))


def windows_of_counts(spark, d):
    """Percentiles of windows from counters, as a stream leaves them."""
    counts = kept(latency.value_counts(table(spark, d, "events")), "counters")
    return latency.percentiles_of_counts(counts)


def first_documents(spark, d):
    """The first 100 documents in scan order."""
    return readers.head(table(spark, d, "documents"), 100).select("doc_id", F.length("text").alias("n"))


def _judged(spark, d):
    ranked = _systems(spark, d)
    asked = D.gold(spark, d).selectExpr("qid", "concat('c', qid % 2) AS corpus", "concat('t', qid % 3) AS type", "gold", "gold IS NOT NULL AS expect_answer")
    return ranked, D.grades(spark, d, E.pool(ranked, "doc_id")), asked


def pool_entries(spark, d):
    pooled = E.pool(_systems(spark, d), "doc_id")
    return E.pool_entries(pooled, D.documents(spark, d), D.gold(spark, d), "doc_id").select("qid", "doc_id", "snippet", "is_gold")


def judge_metrics(spark, d):
    return E.judge_metrics(*_judged(spark, d), "doc_id")


def no_answer_fp(spark, d):
    return E.false_positives(*_judged(spark, d), "doc_id")


def win_loss_tie(spark, d):
    return E.win_loss(_gold_ranks(spark, d, hybrid_rrf(spark, d)), _gold_ranks(spark, d, bm25_topk(spark, d)))


def abstain_signals(spark, d):
    ranked, grades, _ = _judged(spark, d)
    rows = ranked.filter("system = 'lexical'").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    out = E.abstain_signals(rows, grades, "doc_id", "source")
    text = lambda c, n: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast(n), F.lit("-"))), ",")
    return out.select("qid", "top_page", "top_score", F.coalesce("top_grade", F.lit(-1)).alias("top_grade"), "margin", "n_documents", text("grades", "string").alias("grades"))


def latency_percentiles(spark, d):
    return E.latency_summary(table(spark, d, "events"), "value", "event_type")


def latency_windows(spark, d):
    return latency.windowed(table(spark, d, "events"))


def sparse_page_stats(spark, d):
    return P.sparse_stats(D.pages(spark, d))


def stratified_sample(spark, d):
    return E.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, 20260917)


def resume_worklist(spark, d):
    return E.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


def dedupe_latest(spark, d):
    log = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return E.latest(log, "user_id", "at", "event_type")


def stop_phrase_filter(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 3 = 0 THEN concat('이 표 ', text) WHEN turn % 3 = 1 THEN concat('  ', text) ELSE text END AS query")
    return E.usable_queries(rows, readers.STOP_PHRASES).select("conv_id", "turn", F.length("query").alias("n_chars"))


def new_filings(spark, d):
    listed = table(spark, d, "pages").selectExpr("cast(page_id % 50 as string) AS rcept_no", "CASE WHEN page_id % 4 = 0 THEN 'other' ELSE 'annual report' END AS report_nm", "concat('f', page_id, CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '.xls' END) AS name", "concat('https://x.example/a?rcp=', page_id % 50, '&dcm_no=', page_id) AS url")
    known = listed.filter("name LIKE 'f1%'")
    return readers.new_filings(listed, known, "annual", 3)


def ocr_lookup(spark, d):
    asked = D.captions(spark, d).select(F.col("page_id").alias("id"))
    text = X.strip(F.coalesce(F.nullif("ocr", F.lit("")), "text", F.lit("")))
    return D.pages(spark, d).join(asked, "id", "left_semi").select("id", text.alias("text"))


def table_merge(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "text AS raw", "CASE WHEN doc_id % 2 = 0 THEN '| a | b |' ELSE '' END AS tables")
    return rows.select("doc_id", X.with_tables(F.col("raw"), F.col("tables")).alias("text"), X.first_line(F.col("raw")).alias("first_line"))


def text_budget(spark, d):
    shown = table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<(img|a) ")).alias("images"))
    return shown.select("page_id", "images", C.text_budget(F.col("images")).alias("budget"))


def image_cap_ties(spark, d):
    return P.cap_images(D.routed(spark, d).withColumn("seq", F.expr("seq % 50")), 20).select("id", "route")


def section_map_long_ids(spark, d):
    """Page numbers of up to 40 digits, as in names that end with a receipt number."""
    number = "concat(seq * 1000003, lpad(cast(seq as string), 30, '0'))"
    rows = D.routed(spark, d).selectExpr(f"concat('long/d', cast(floor(seq / 400) as bigint), '_', {number}) AS id", "text AS document", "route")
    return P.section_map(rows)


def _written_index(spark, d, lexical):
    store = D.documents(spark, d).join(D.vectors(spark, d), "doc_id")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.write(path, store, R.postings(D.documents(spark, d)) if lexical else None, P.section_map(D.records(spark, d)), partitions=16)
    return I.load(spark, path)


def stored_index_search(spark, d):
    """Hybrid search from a stored index: vectors, postings and section data are written, then read back."""
    return I.search(_written_index(spark, d, True), D.queries(spark, d), "doc_id")


def dense_only_search(spark, d):
    """The same without postings, as an index from before they were built."""
    return I.search(_written_index(spark, d, False), D.queries(spark, d), "doc_id")


def grown_index_search(spark, d):
    """Lexical search over an index that grew by three segments, the last of which also replaces documents of the first."""
    path, docs = f"{shared_dir(spark)}/grown-{uuid.uuid4().hex}", D.documents(spark, d)
    first = docs.filter("doc_id % 3 = 0").withColumn("text", F.expr("CASE WHEN doc_id % 2 = 0 THEN text ELSE concat('old ', reverse(text)) END"))
    for number, part in enumerate((first, docs.filter("doc_id % 3 = 1"), docs.filter("doc_id % 3 = 2 OR (doc_id % 3 = 0 AND doc_id % 2 <> 0)"))):
        G.write_segment(part, path, number)
    return G.search(G.load(spark, path), D.queries(spark, d), DEFAULT.top_k)


def block_postings_search(spark, d):
    """Lexical search over stored blocks of postings, most of which aren't read."""
    docs, path = D.documents(spark, d), f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    B.write(B.counted(docs, max(1, docs.count() // 64)), path)
    return B.search(B.load(spark, path), D.queries(spark, d), DEFAULT.top_k)


def stored_filtered_search(spark, d):
    """Hybrid search by page id from a stored index of blocks, without the pages that the stored section data call empty."""
    docs, path = D.paged(spark, d), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    store = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(_page_ids(spark, d), "doc_id").drop("doc_id")
    I.write(path, store, sections=P.section_map(D.records(spark, d)), blocks=B.counted(docs, max(1, docs.count() // 64), "page_id"))
    return I.search(I.load(spark, path), D.queries(spark, d), "page_id", D.FILTERED)


def result_urls(spark, d):
    made = P.chunks(D.routed(spark, d), D.captions(spark, d))
    there = D.pages(spark, d).filter("seq % 4 <> 1").select(X.safe_name(F.col("id")).alias("name"))
    return P.with_urls(made.select("page_id", "image_path"), there).select("page_id", "image_url")


def variant_text(spark, d):
    rows = D.records(spark, d).selectExpr("id AS page_id", "route", "document")
    read = ocr_lookup(spark, d).select(F.col("id").alias("page_id"), "text")
    return P.variant_text(rows, D.captions(spark, d).filter("length(page_id) % 2 = 0"), read).select("page_id", "document")


def judge_sample(spark, d):
    qa = table(spark, d, "documents").selectExpr("doc_id AS id", "coalesce(lang, '-') AS type", "text AS query")
    synthetic = table(spark, d, "documents").filter("doc_id % 2 = 0").selectExpr(f"{D.PAGE_ID} AS page_id", "concat('about ', text) AS query")
    manual = spark.range(3).selectExpr("concat('m', id) AS query", "id > 0 AS expect_answer")
    return E.judge_sample(qa, synthetic, manual)


def caption_report(spark, d):
    log = table(spark, d, "events").selectExpr("CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS caption", "value AS elapsed_sec")
    return E.caption_report(log)


def filing_window(spark, d):
    listed = table(spark, d, "pages").selectExpr("page_id", "concat('c', page_id % 5) AS corp", "date_add(date'2022-01-01', cast(page_id % 900 as int)) AS filed")
    wanted = spark.range(12).selectExpr("concat('c', id % 4) AS corp", "cast(2021 + id % 3 as int) AS year")
    return readers.in_window(listed, wanted).select("page_id", "corp", "year", F.col("filed").cast("string").alias("filed"))


def receipt_dates(spark, d):
    number = "concat(2020 + doc_id % 5, lpad(cast(doc_id % 14 as string), 2, '0'), lpad(cast(doc_id % 31 + 1 as string), 2, '0'), lpad(cast(doc_id % 1000000 as string), 6, '0'))"
    return table(spark, d, "documents").select("doc_id", readers.receipt_date(F.expr(number)).cast("string").alias("received"))


def encoded_images(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return rows.select("doc_id", X.encoded(F.col("content")).alias("content"))


def fitted_sizes(spark, d):
    size = X.fitted(F.col("w"), F.col("h"))
    return table(spark, d, "documents").selectExpr("doc_id", "length(text) * 37 % 4000 + 1 AS w", "length(text) * 91 % 5000 + 1 AS h").select("doc_id", size.alias("s")).select("doc_id", "s.width", "s.height")


def latency_window_percentiles(spark, d):
    return latency.window_percentiles(table(spark, d, "events"))


def nfkc_context(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("ＡＢＣ１２３ ﬁ "), "text").alias("text"))
    return rows.select("doc_id", nfkc("text").alias("text"))


QUERIES = [
    route_pages, route_stats, image_cap_overflow, chunk_text, doc_prefix, page_no_content, section_title, section_map, section_stats, term_frequencies, document_frequencies,
    bm25_weights, bm25_topk, vector_topk, hybrid_rrf, hybrid_filtered_two_phase, rerank_topn, neighbor_expand, context_pack, strip_abstention, degenerate_output, ir_metrics_by_group,
    judge_pool, grade_upsert, judge_metrics, no_answer_fp, win_loss_tie, abstain_signals, latency_percentiles, latency_windows, sparse_page_stats, stratified_sample, resume_worklist,
    dedupe_latest, stop_phrase_filter, new_filings, ocr_lookup, table_merge, text_budget, nfkc_context, image_cap_ties, section_map_long_ids, stored_index_search, dense_only_search, grown_index_search, block_postings_search, stored_filtered_search,
    pool_entries, result_urls, variant_text, judge_sample, caption_report, filing_window, receipt_dates, encoded_images, fitted_sizes, latency_window_percentiles, windows_of_counts, first_documents,
]


def queries() -> dict:
    def widened(f):
        return lambda spark, sf_dir: D.wide(f(spark, sf_dir))

    return {f.__name__: widened(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()


