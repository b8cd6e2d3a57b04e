"""Lexical, dense and fused search over batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.params import DEFAULT, Params
from paperloom.session import kept

#: Queries whose terms or vectors are sent to all tasks at once.
BLOCK = 2000


def blocks(queries: DataFrame, key: str = "qid", rows: int = BLOCK) -> list[DataFrame]:
    """Parts of a query set of about ``rows`` each, by a hash of the key."""
    count = max(1, -(-queries.count() // rows))
    return [queries] if count == 1 else [queries.filter(F.pmod(F.xxhash64(key), F.lit(count)) == i) for i in range(count)]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def term_frequencies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, term, tf``. Texts are dealt by id, so that their terms are counted where they are split and
    no row a term is shuffled."""
    return docs.select(id, text).repartition(id).select(id, F.explode(X.tokens(text)).alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text", terms: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """``id, term, tf, weight``: BM25 weights of all terms, or of ``terms`` (a column of that name) only.

    Document lengths and their mean come from all tokens; a term's document count comes from all
    documents. Texts are split once: tokens that aren't asked for fall together in one row a document, in the task
    that has its text, and with a mark a document they give its length. Rows of one id are one document.
    Texts are dealt by id before they are split, so no count is shuffled. These counts are written once and read for weights,
    document counts and mean. Document counts are written, too: Spark then knows their size, and sends them to all tasks
    while they are small, so counts aren't dealt by term to be weighed.
    """
    counted = _counted(docs, id, text, terms)
    sized = kept(counted.withColumn("dl", F.sum("tf").over(Window.partitionBy(id))), "counts")
    whole = sized.filter("term IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    tf = sized.filter("term IS NOT NULL").select(id, "term", "tf", "dl")
    return weighted(tf, kept(document_frequencies(tf), "df"), whole, id, p)


def _counted(docs: DataFrame, id: str, text: str, terms: DataFrame | None) -> DataFrame:
    """``id, term, tf``, dealt by id, with a row of a null term for each document: its tokens that aren't asked for."""
    dealt = docs.select(id, text).repartition(id)
    flat = dealt.select(id, F.explode(F.concat(X.tokens(text), F.array(F.lit(None).cast("string")))).alias("_token"))
    term = F.col("_token")
    if terms is not None:  # null for other tokens
        flat, term = flat.join(terms.select(F.col("term").alias("_token"), F.col("term").alias("_term")).distinct(), "_token", "left"), F.col("_term")
    return flat.groupBy(id, term.alias("term")).agg(F.count("_token").alias("tf"))


def weighted(tf: DataFrame, df: DataFrame, whole: DataFrame, id: str, p: Params = DEFAULT) -> DataFrame:
    """``id, term, tf, weight`` from counts (id, term, tf, dl), document counts (term, df) and one row (n, avgdl)."""
    joined = tf.join(df, "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - p.b + p.b * F.col("dl") / F.col("avgdl")
    return joined.select(id, "term", "tf", (idf * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * length)).alias("weight"))


def top(scored: DataFrame, k: int, id: str, digits: int = 6) -> DataFrame:
    """The ``k`` best rows of each query by rounded score, then id; ``rank`` counts from one."""
    rounded = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id)
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """``qid, term``, each term once."""
    return queries.select("qid", F.explode(F.array_distinct(X.tokens(text))).alias("term"))


def lexical_top(docs: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", text: str = "text", p: Params = DEFAULT) -> DataFrame:
    """``qid, id, score, rank`` of the ``k`` best documents by the sum of the weights of the query's terms."""
    return lexical_tops(docs.select(id, text, F.lit(None).cast("string").alias("variant")), queries, k, [""], id, text, p)[""]


def lexical_tops(parts: DataFrame, queries: DataFrame, k: int, variants: list[str], id: str = "doc_id", text: str = "text", p: Params = DEFAULT) -> dict[str, DataFrame]:
    """As ``lexical_top`` for variants of the same documents, whose texts are split once.

    ``parts`` (``id``, text, variant): a text of all variants (null) or of one; the texts of an id are one document, each on lines of its own.
    """
    terms = kept(query_terms(queries), "terms")
    counts = kept(asked_counts(parts, terms, variants, id, text), "counts")
    out = {}
    for name in variants:
        listed = counts.filter(F.col("variant") == name).drop("variant")
        whole = listed.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
        out[name] = counted_top(listed, whole, terms, k, id, p)
    return out


#: Terms of queries that meet the documents at once, bytes of a block of texts, and what its counts have besides ids and words.
ASKED, TEXT_BYTES = 1 << 17, 1 << 23
COUNTS = (("doc", np.int32), ("v", np.int32), ("dl", np.int64), ("row", np.int32), ("code", np.int32), ("n", np.int64))


def _changes(rows: pa.RecordBatch, key: str = "id") -> np.ndarray:
    """Which rows begin a new ``key``; null is one."""
    codes = pc.fill_null(rows.column(key).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.concatenate(([True], codes[1:] != codes[:-1])) if len(codes) else np.empty(0, bool)


def _pieces(batches, key: str, most: int, size: int):
    """Rows (``key``, text and others; sorted by ``key``) in batches of whole keys: about ``most`` rows or ``size`` bytes of text, or one key."""
    held = None
    for batch in batches:
        rows = batch if held is None or not held.num_rows else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(_changes(rows, key))
        if not len(starts):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        for i in range(1, len(starts)):
            start = int(starts[i])
            if start - at >= most or ends[start - 1] - ends[at] > size or i == len(starts) - 1:
                yield rows.slice(at, start - at)
                at = start
        held = rows.slice(at)  # its last key may go on
    if held is not None and held.num_rows:
        yield held


def asked_counts(parts: DataFrame, terms: DataFrame, variants: list[str], id: str, text: str) -> DataFrame:
    """``variant, id, dl, terms, tfs``: for each variant and document its number of tokens, and which of ``terms`` (a column of
    that name) it has how often.

    Texts (``parts`` of ``lexical_tops``) are dealt by id and counted where they are; blocks of counts meet the terms in the same
    task, so only counts of asked terms leave it.
    """
    kind = parts.schema[id].dataType.simpleString()
    own = parts.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"), "variant")
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # for its time, not its bytes
    dealt = own.repartition(tasks, "id").sortWithinPartitions("id")

    numbers = {n: i for i, n in enumerate(variants)}

    def block(rows):
        """Counts of the texts of whole documents: documents' ids, and for each text its document, variant, length and entries."""
        words, row, code, n = X.count_tokens([x or b"" for x in rows.column("text").to_pylist()])
        new = _changes(rows)
        doc = np.cumsum(new) - 1
        v = np.array([numbers[x] if x is not None else -1 for x in rows.column("variant").to_pylist()], np.int32)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows.column("id").filter(pa.array(new)), words)]
        arrays = doc.astype(np.int32), v, np.bincount(row, weights=n, minlength=len(doc)).astype(np.int64), row.astype(np.int32), code, n.astype(np.int64)
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()]) for x in arrays)], names=["ids", "words", *(x for x, _ in COUNTS)])

    def count(batches):
        for rows in _pieces(batches, "id", BLOCK_DOCS, TEXT_BYTES):
            yield block(rows)

    blocked = dealt.mapInArrow(count, f"ids array<{kind}>, words array<string>, " + ", ".join(f"{x} binary" for x, _ in COUNTS))
    distinct = terms.select("term").distinct()
    shares = max(1, -(-distinct.count() // ASKED))
    asked = distinct.groupBy(F.pmod(F.xxhash64("term"), F.lit(shares)).alias("share")).agg(F.collect_list("term").alias("asked")).select("asked")
    if shares == 1:  # one row, also if there are no terms
        asked = distinct.agg(F.collect_list("term").alias("asked"))

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, v, dl, row, code, n = (np.frombuffer(batch.column(x)[i].as_buffer(), t) for x, t in COUNTS)
                ids, words = batch.column("ids")[i].values, batch.column("words")[i].values
                wanted = pc.is_in(words, value_set=batch.column("asked")[i].values).to_numpy(zero_copy_only=False)[code]
                row, code, n = row[wanted], code[wanted].astype(np.int64), n[wanted]
                for k, name in enumerate(variants):
                    own = (v == -1) | (v == k)
                    mine = own[row]
                    key = doc[row[mine]] * np.int64(max(1, len(words))) + code[mine]
                    order = np.argsort(key, kind="stable")
                    key, tf = key[order], n[mine][order]
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
                    tf, key = np.add.reduceat(tf, first) if len(key) else tf, key[first]
                    sizes = np.bincount(key // max(1, len(words)), minlength=len(ids))
                    lengths = np.bincount(doc[own], weights=dl[own], minlength=len(ids)).astype(np.int64)
                    at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                    lists = (pa.ListArray.from_arrays(at, x) for x in (words.take(pa.array(key % max(1, len(words)))), pa.array(tf)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), ids, pa.array(lengths), *lists], names=["variant", id, "dl", "terms", "tfs"])

    rows = blocked.crossJoin(F.broadcast(asked) if shares == 1 else asked).mapInArrow(meet, f"variant string, `{id}` {kind}, dl long, terms array<string>, tfs array<long>")
    if shares == 1:
        return rows
    joined = rows.groupBy("variant", id).agg(F.first("dl").alias("dl"), F.collect_list(F.struct("terms", "tfs")).alias("_l"))
    return joined.select("variant", id, "dl", F.flatten("_l.terms").alias("terms"), F.flatten("_l.tfs").alias("tfs"))


def counted_top(listed: DataFrame, whole: DataFrame, terms: DataFrame, k: int, id: str, p: Params = DEFAULT) -> DataFrame:
    """As ``lexical_top``, from stored rows a document (``id``, dl, terms, tfs: the asked terms it has, once each), one row (n, avgdl)
    and the queries' terms (qid, term). What a term weighs by its document count goes with the queries, so documents stay where they are."""
    one = F.broadcast(whole)  # one row
    df = kept(listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, "term").crossJoin(one).select("qid", "term", idf.alias("weight"))
    length = 1 - p.b + p.b * F.col("dl") / F.col("avgdl")
    part = F.transform("tfs", lambda tf: tf * (p.k1 + 1) / (tf + p.k1 * length))
    return product_top(listed.filter(F.size("terms") > 0).crossJoin(one).select(id, "terms", part.alias("weights")), asked, k, id)


def by_document(rows: DataFrame, id: str) -> DataFrame:
    """``id, terms, weights``: a row a document (or query) from rows (id, term, weight)."""
    out = rows.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_l"))
    return out.select(id, F.col("_l.term").alias("terms"), F.col("_l.weight").alias("weights"))


def stored_top(index: DataFrame, queries: DataFrame, k: int, id: str = "doc_id") -> DataFrame:
    """As ``lexical_top``, from stored postings (``id``, term, weight): only the queries' terms are joined."""
    terms = kept(query_terms(queries), "terms")
    found = index.select(id, "term", "weight").join(terms.select("term").distinct(), "term", "left_semi")
    return product_top(by_document(found, id), terms.withColumn("weight", F.lit(1.0)), k, id)


#: Documents and queries of a block of term weights, and the most entries of one.
BLOCK_DOCS, BLOCK_QUERIES, BLOCK_ENTRIES = 2048, 512, 1 << 18


def _term_blocks(rows: DataFrame, id: str, name: str, most: int) -> DataFrame:
    """Rows (``id``, terms, weights) as blocks by term: ``{name}_ids``, ``{name}_terms`` (each once), and for the entries in
    the order of terms where each term begins (``{name}_at``), their rows and their weights."""
    kind, entries = rows.schema[id].dataType.simpleString(), BLOCK_ENTRIES
    names = [f"{name}_{x}" for x in ("ids", "terms", "at", "rows", "weights")]

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = min(batch.num_rows, at + most, max(at + 1, int(np.searchsorted(ends, before + entries, "right"))))
                some = batch.slice(at, to - at)
                sizes = pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False)
                coded = some.column(1).flatten().dictionary_encode()
                codes, weights = coded.indices.to_numpy(), some.column(2).flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                begin = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))))).astype(np.int32)
                owner = np.repeat(np.arange(some.num_rows, dtype=np.int32), sizes)[order]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (some.column(0), coded.dictionary)]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()]) for x in (begin, owner, weights[order]))], names=names)
                at = to

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, (f"array<{kind}>", "array<string>", "binary", "binary", "binary")))
    return rows.select(id, "terms", F.col("weights").cast("array<double>")).mapInArrow(run, schema)


def product_top(rows: DataFrame, asked: DataFrame, k: int, id: str) -> DataFrame:
    """``qid, id, score, rank`` of the ``k`` best rows (``id``, terms, weights; one a document) by the sum, over a query's terms
    (qid, term, weight; each once), of the products of both weights, which are positive.

    Exact: a block of documents meets every block of queries in one sparse product, and a task hands on its ``k`` best a query, so no
    pair of a query and a document is shuffled. Blocks of queries are written first: Spark knows their size, and sends them to all
    tasks only if they are small.
    """
    kind, count = rows.schema[id].dataType.simpleString(), asked.select("qid").distinct().count()
    questions = by_document(asked, "qid").coalesce(max(1, -(-count // BLOCK_QUERIES)))
    right = kept(_term_blocks(questions, "qid", "q", BLOCK_QUERIES).withColumn("q_block", F.xxhash64("q_ids")), "asked")
    left = _term_blocks(rows, id, "d", BLOCK_DOCS)

    def product(batches):
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows if k > 0 else 0):
                side = lambda n: (batch.column(f"{n}_ids")[i].values, batch.column(f"{n}_terms")[i].values, *(np.frombuffer(batch.column(f"{n}_{x}")[i].as_buffer(), t) for x, t in (("at", np.int32), ("rows", np.int32), ("weights", np.float64))))  # noqa: B023, E731
                (ids, terms, at, docs, weights), (qids, wanted, q_at, q_rows, q_weights) = side("d"), side("q")
                places = pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy()
                scores = np.zeros((len(qids), len(ids)))
                for j in np.flatnonzero(places >= 0).tolist():
                    own, theirs = slice(q_at[j], q_at[j + 1]), slice(at[places[j]], at[places[j] + 1])
                    scores[q_rows[own, None], docs[None, theirs]] += q_weights[own, None] * weights[None, theirs]
                scores = np.where(scores > 0, np.round(scores, 6), -np.inf)
                _hold(held, batch.column("q_block")[i].as_py(), qids, scores, ids, k)
                if sum(len(h[1]) for h in held.values()) > HELD:
                    yield from _handed(held, id)
        yield from _handed(held, id)

    found = left.crossJoin(right).mapInArrow(product, f"qid {asked.schema['qid'].dataType.simpleString()}, `{id}` {kind}, score double")
    return top(found, k, id).select("qid", id, "score", "rank")


#: Bytes of a block of vectors, most rows of one, and results that a task holds before it hands them on.
BLOCK_BYTES, BLOCK_ROWS, HELD = 1 << 20, 4096, 1 << 20


def _packed(rows: DataFrame, id: str, vector: str, name: str) -> DataFrame:
    """``rows`` as blocks: ``{name}_ids`` and ``{name}`` (the vectors, one after the other), of one ``size`` each.

    A row with a null id or vector, or a null in it, is in no block.
    """
    kind, part = rows.schema[id].dataType.simpleString(), np.float32 if rows.schema[vector].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == size))
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, size * part().itemsize)))
                for at in range(0, own.num_rows, most):
                    some = own.slice(at, most)
                    flat = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(part)
                    ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([int(size)]), ids, pa.array([flat.tobytes()])], names=["size", f"{name}_ids", name])

    whole = F.col(id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return rows.filter(whole).select(id, vector).mapInArrow(run, f"size long, {name}_ids array<{kind}>, {name} binary")


def _best(rows: np.ndarray, scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``k`` best of each row: highest score, then smallest id (nulls first, as Spark orders)."""
    order = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), -scores, rows))
    rows = rows[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], scores[order][kept], ids.take(pa.array(order[kept]))


def _hold(held: dict, key, qids: pa.Array, scores: np.ndarray, ids: pa.Array, k: int) -> None:
    """Take into ``held[key]`` (qids, rows, scores, ids) what is among the ``k`` best of a query (a row of ``scores``) so far; minus infinity is no result."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    old = held.get(key)
    if old is not None:  # a query with k results so far takes better or equal ones only
        full = np.bincount(old[1], minlength=len(scores)) == k
        worst = np.full(len(scores), np.inf)
        np.minimum.at(worst, old[1], old[2])
        least = np.where(full, np.maximum(least, worst), least)
    rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    found = rows, scores[rows, columns], ids.take(pa.array(columns))
    if old is not None:
        found = np.concatenate((old[1], found[0])), np.concatenate((old[2], found[1])), pa.concat_arrays([old[3], found[2]])
    held[key] = (qids, *_best(*found, k))


def _handed(held: dict, id: str):
    """What is held, as batches; afterwards nothing is."""
    for qids, rows, scores, ids in held.values():
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(rows)), ids, pa.array(scores)], names=["qid", id, "score"])
    held.clear()


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", query: str = "query_vec") -> DataFrame:
    """``qid, id, score, rank`` of the ``k`` best vectors by inner product, in double precision.

    Exact: both sides are packed into blocks, every block of vectors meets every block of queries of its size in
    one matrix product, and a task hands on its ``k`` best a query. Blocks of vectors are dealt over as many
    shards as there are shuffle partitions, blocks of queries go to each shard; the plan has one form,
    whatever the number of queries, and Spark broadcasts the queries where they are small.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id].dataType.simpleString()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [np.float32 if df.schema[c].dataType.elementType.simpleString() == "float" else np.float64 for df, c in ((vectors, vector), (queries, query))]

    def product(batches):
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                size, qids, ids = batch.column("size")[i].as_py(), batch.column("q_ids")[i].values, batch.column("v_ids")[i].values
                x = np.frombuffer(batch.column("v")[i].as_buffer(), parts[0]).reshape(-1, size).astype(np.float64)
                q = np.frombuffer(batch.column("q")[i].as_buffer(), parts[1]).reshape(-1, size).astype(np.float64)
                _hold(held, batch.column("q_block")[i].as_py(), qids, np.round(q @ x.T, 6), ids, k)
                if sum(len(h[1]) for h in held.values()) > HELD:
                    yield from _handed(held, id)
        yield from _handed(held, id)

    asked = _packed(queries, "qid", query, "q").withColumn("q_block", F.xxhash64("q_ids", "size"))
    left = _packed(vectors, id, vector, "v").withColumn("shard", F.pmod(F.xxhash64("v_ids"), F.lit(shards)).cast("int"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.join(right, ["shard", "size"]).select("size", "v_ids", "v", "q_ids", "q", "q_block").mapInArrow(product, f"qid {queries.schema['qid'].dataType.simpleString()}, `{id}` {kind}, score double")
    return top(found, k, id).select("qid", id, "score", "rank")


def _ranks(dense: DataFrame, lexical: DataFrame | None, id: str, barred: DataFrame | None) -> DataFrame:
    """``qid, id, dense_rank, lexical_rank`` of pages that aren't barred, for queries with dense results."""
    parts = [dense.select("qid", id, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank"))]
    if lexical is not None:
        parts.append(lexical.select("qid", id, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("lexical_rank")))
    ranks = union(parts).groupBy("qid", id).agg(F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"))
    ranks = ranks.withColumn("_known", F.max(F.col("dense_rank").isNotNull()).over(Window.partitionBy("qid"))).filter("_known").drop("_known")
    return ranks if barred is None else ranks.join(barred.select(id).distinct(), id, "left_anti")


def _fused(dense_rank, lexical_rank, id: str, p: Params):
    """The score of a page and its window order within a query."""
    part = lambda c: F.coalesce(1.0 / (p.rrf_k + c), F.lit(0.0))
    score = F.round(part(dense_rank) + part(lexical_rank), 9)
    return score, Window.partitionBy("qid").orderBy(F.desc(score), dense_rank.asc_nulls_last(), lexical_rank.asc_nulls_last(), id)


def fuse(dense: DataFrame, lexical: DataFrame | None, id: str, k: int, p: Params = DEFAULT, barred: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion: ``qid, id, score, rank``.

    ``barred`` (a column ``id``) are pages left out; they keep their places, so ranks don't close up.
    A query without dense results has none. Ties go to the better dense rank, then the lexical one.
    """
    ranks = _ranks(dense, lexical, id, barred)
    score, order = _fused(F.col("dense_rank"), F.col("lexical_rank"), id, p)
    out = ranks.select("qid", id, score.alias("score"), F.row_number().over(order).alias("rank"))
    return out.filter(F.col("rank") <= k)


def search(docs: DataFrame | None, vectors: DataFrame, queries: DataFrame, id: str, p: Params = DEFAULT, barred: DataFrame | None = None, vector_id: str | None = None, stored=None) -> DataFrame:
    """Hybrid search: ``qid, id, score, rank``. ``queries``: qid, query, query_vec.

    The lexical side is ``stored(queries, k, id)`` (a search of a stored index) if given, else made from ``docs``; with
    neither, search is dense only.

    With ``barred`` and ``p.filter_no_content``, a query that the first ``top_k`` of both lists leave
    short is answered from lists ``overfetch`` times as long, if that gives more. Both answers come
    from one pass: the longer lists hold the shorter ones.
    """
    vid, filtered = vector_id or id, barred is not None and p.filter_no_content
    fetch = p.top_k * (p.overfetch if filtered else 1)
    dense = dense_top(vectors, queries, fetch, vid).withColumnRenamed(vid, id)
    lexical = None
    if p.hybrid and (stored is not None or docs is not None):
        lexical = stored(queries, fetch, id) if stored is not None else lexical_top(docs, queries, fetch, id, p=p)
    if not filtered:
        return fuse(dense, lexical, id, p.top_k, p)
    ranks = _ranks(dense, lexical, id, barred)
    first = lambda c: F.when(F.col(c) <= p.top_k, F.col(c))
    per = Window.partitionBy("qid")
    near = first("dense_rank").isNotNull() | first("lexical_rank").isNotNull()
    counted = ranks.withColumns({"_near": F.count_if(near).over(per), "_wide": F.count("*").over(per), "_dense": first("dense_rank"), "_lexical": first("lexical_rank")})
    widen = (F.col("_near") < p.top_k) & (F.col("_wide") > F.col("_near"))
    chosen = counted.withColumns({"dense_rank": F.when(widen, F.col("dense_rank")).otherwise(F.col("_dense")), "lexical_rank": F.when(widen, F.col("lexical_rank")).otherwise(F.col("_lexical"))})
    chosen = chosen.filter("dense_rank IS NOT NULL OR lexical_rank IS NOT NULL")
    score, order = _fused(F.col("dense_rank"), F.col("lexical_rank"), id, p)
    return chosen.select("qid", id, score.alias("score"), F.row_number().over(order).alias("rank")).filter(F.col("rank") <= p.top_k)


def overlap_score(query: str, text: str):
    """The stand-in for a cross-encoder: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(X.tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, X.tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, id: str, scorer=overlap_score, p: Params = DEFAULT) -> DataFrame:
    """The ``top_n`` of each query's candidates (qid, id, query, text, rank) by ``scorer``; ties keep their order."""
    scored = candidates.withColumnRenamed("rank", "fused_rank").withColumn("score", F.round(scorer("query", "text"), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top_n).select("qid", id, "score", "rank", "fused_rank")


def add_neighbor(ranked: DataFrame, sections: DataFrame, chunk_ids: DataFrame, id: str = "page_id") -> DataFrame:
    """The page after each query's first, if it has content, exists and isn't among the results.

    ``qid, id``. ``sections``: id, no_content, next_id; a next page without an entry counts as content.
    """
    first = ranked.filter("rank = 1").select("qid", F.col(id).alias("_first"))
    following = first.join(sections.select(F.col("id").alias("_first"), F.col("next_id").alias(id)), "_first").filter(F.col(id).isNotNull()).drop("_first")
    known = sections.filter("no_content").select(F.col("id").alias(id))
    return following.join(known, id, "left_anti").join(chunk_ids.select(id), id, "left_semi").join(ranked.select("qid", id), ["qid", id], "left_anti").select("qid", id)
