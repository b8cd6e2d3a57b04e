"""Postings in blocks with an upper bound each, and exact top-k that skips blocks.

Documents are dealt into blocks by a hash of their id. A row holds one term's postings of one block: ids
in order, their weights, and the largest weight, ``bound`` (``blocked``); or their counts, and the largest count and the least
length, which give a bound once the mean length is known (``counted``, made from texts in one pass that shuffles no posting).
No document of a block can score more than the sum of the
bounds of the query's terms there. A search reads what the bounds need first (columns of the stored table), scores the
most promising blocks of each query, for all queries, and then reads those others only whose sum reaches the k-th best score that some
query found. Blocks are scored in sparse products, so that pairs of a query and a document aren't shuffled. The
result is that of ``search.stored_top``, ties included. Ids, weights and counts are plain arrays: Parquet encodes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import search as R
from paperloom.params import DEFAULT, Params
from paperloom.session import kept

#: Blocks of a query that are scored before others are ruled out.
FIRST = 4
#: More than rounding of scores can make up.
SLACK = 1e-6
#: Texts that are counted at once and their bytes, about: a worker's memory follows them.
TEXTS, TEXT_BYTES = 512, 1 << 21


def _block(id: str, count: int):
    return F.pmod(F.xxhash64(id), F.lit(count)).cast("int").alias("block")


def blocked(postings: DataFrame, count: int, id: str = "doc_id") -> DataFrame:
    """``term, block, bound, n, ids, weights`` from postings (id, term, weight), documents dealt into ``count`` blocks.

    A list holds the documents of one block at most, so ``count`` is to grow with the documents.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(id).alias("id"), "weight")))
    rows = postings.select("term", _block(id, count), id, "weight")
    out = rows.groupBy("term", "block").agg(F.max("weight").alias("bound"), F.count("*").alias("n"), listed.alias("_l"))
    return out.select("term", "block", "bound", "n", F.col("_l.id").alias("ids"), F.col("_l.weight").alias("weights"))


def counted(docs: DataFrame, count: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, block, n, tf, dl, ids, tfs, dls`` from texts, documents dealt into ``count`` blocks: a term's ``n`` documents of a
    block, how often each has it and how long each is, and the largest of ``tfs`` and the least of ``dls``.

    A row of a null term has the number of a block's documents and of all their tokens (``tf``). Texts are dealt by block, and all rows of
    a block are made in the task that has its texts, some blocks at a time and these in the order of terms. Rows of one id are one document.
    """
    kind, tasks = docs.schema[id].dataType.simpleString(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # for their time, not their bytes
    dealt = docs.select(_block(id, count), F.col(id).alias("id"), F.col(text).cast("binary").alias("text")).repartition(tasks, "block").sortWithinPartitions("block", "id")
    most, size = TEXTS, TEXT_BYTES

    def run(batches):
        for rows in R._pieces(batches, "block", most, size):
            yield from _listed(rows)

    return dealt.mapInArrow(run, f"term string, block int, n int, tf long, dl int, ids array<{kind}>, tfs array<int>, dls array<int>")


def _listed(rows: pa.RecordBatch):
    """Rows of ``counted`` for whole blocks of texts (block, id, text)."""
    words, row, code, tf = X.count_tokens([x or b"" for x in rows.column("text").to_pylist()])
    new = R._changes(rows, "block") | R._changes(rows)
    doc = np.cumsum(new) - 1
    ids, block = rows.column("id").filter(pa.array(new)), rows.column("block").to_numpy()[new]
    length = np.bincount(doc[row], weights=tf, minlength=len(block)).astype(np.int64)
    batch = lambda *x: pa.RecordBatch.from_arrays(list(x), names=["term", "block", "n", "tf", "dl", "ids", "tfs", "dls"])
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    none = [pa.nulls(len(first), t) for t in (pa.int32(), pa.list_(ids.type), pa.list_(pa.int32()), pa.list_(pa.int32()))]
    yield batch(pa.nulls(len(first), pa.string()), pa.array(block[first]), pa.array(np.diff(first, append=len(block)).astype(np.int32)), pa.array(np.add.reduceat(length, first)), *none)
    if not len(code):
        return
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    key = place[code] * len(block) + doc[row]
    by = np.argsort(key, kind="stable")
    key, tf = key[by], tf[by]
    once = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # rows of one id
    key, tf = key[once], np.add.reduceat(tf, once)
    word, doc = np.divmod(key, len(block))
    dl, own = length[doc], block[doc]
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (own[1:] != own[:-1]))))
    at = pa.array(np.append(first, len(key)), pa.int32())
    lists = [pa.ListArray.from_arrays(at, x) for x in (ids.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int32)))]
    yield batch(words.take(pa.array(order[word[first]])), pa.array(own[first]), pa.array(np.diff(first, append=len(key)).astype(np.int32)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first).astype(np.int32)), *lists)


def write(rows: DataFrame, path: str, partitions: int = 200) -> None:
    """Rows of ``blocked`` sorted by term and block, so that a term's bounds lie together; a frequent term may span files. Rows of ``counted``
    stay in the tasks that made them."""
    if not _counts(rows):
        rows = rows.repartitionByRange(partitions, "term", "block").sortWithinPartitions("term", "block")
    rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _counts(index: DataFrame) -> bool:
    """Whether the rows are those of ``counted``."""
    return "tfs" in index.columns


def _asked(index: DataFrame, queries: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The index, one of counts with the mean length ``avgdl``, and ``qid, term, weight``: what a term weighs besides what the index has of it."""
    terms = kept(R.query_terms(queries), "terms")
    if not _counts(index):
        return index, terms.withColumn("weight", F.lit(1.0))
    whole = kept(index.filter("term IS NULL").agg(F.sum("n").alias("docs"), F.coalesce(F.sum("tf") / F.sum("n"), F.lit(1.0)).alias("avgdl")), "whole")  # one row
    df = index.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = kept(terms.join(df, "term").crossJoin(F.broadcast(whole)).select("qid", "term", idf.alias("weight")), "asked")
    return index.crossJoin(F.broadcast(whole.select("avgdl"))), weighed


def _share(tf, dl, p: Params):
    """What a count weighs, but for how rare the term is."""
    return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * dl / F.col("avgdl")))


def _best(index: DataFrame, blocks: DataFrame, terms: DataFrame, k: int, id: str, p: Params) -> DataFrame:
    """``qid, id, score`` of the ``k`` best documents of ``blocks`` (block) for each query."""
    rows = index.join(terms.select("term").distinct(), "term", "left_semi").join(blocks, "block", "left_semi")
    names, weight = (["tfs", "dls"], _share(F.col("p.tfs"), F.col("p.dls"), p)) if _counts(index) else (["weights"], F.col("p.weights"))
    mean = ["avgdl"] if _counts(index) else []
    flat = rows.select("term", *mean, F.explode(F.arrays_zip("ids", *names)).alias("p")).select("term", F.col("p.ids").alias(id), weight.alias("weight"))
    return R.product_top(R.by_document(flat, id), terms, k, id).drop("rank")


def _ranked(index: DataFrame, terms: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``qid, block, most, at``: blocks with a term of the query by the most that a document of theirs can score."""
    bound = _share(F.col("tf"), F.col("dl"), p) if _counts(index) else F.col("bound")
    most = F.sum(F.col("bound") * F.col("weight") if "weight" in terms.columns else F.col("bound"))
    bounds = index.select("term", "block", bound.alias("bound")).join(terms, "term").groupBy("qid", "block").agg(most.alias("most"))
    return bounds.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "block")))


def _needed(ranked: DataFrame, near: DataFrame, k: int, id: str) -> DataFrame:
    """Blocks beyond the first that may hold a document among the ``k`` best, given the scores ``near``."""
    least = R.top(near, k, id).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = ranked.filter(F.col("at") > FIRST).join(least, "qid", "left")
    return rest.filter(F.col("least").isNull() | (F.col("most") + SLACK >= F.col("least")))


def _first(ranked: DataFrame) -> DataFrame:
    """The first blocks of all queries."""
    return ranked.filter(F.col("at") <= FIRST).select("block").distinct()


def search(index: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", p: Params = DEFAULT) -> DataFrame:
    """``qid, id, score, rank`` of the ``k`` best documents of each query (qid, query)."""
    index, terms = _asked(index, queries, p)
    ranked = kept(_ranked(index, terms, p), "bounds")
    first = kept(_first(ranked), "first")
    near = kept(_best(index, first, terms, k, id, p), "near")
    read = kept(_needed(ranked, near, k, id).select("block").distinct().join(first, "block", "left_anti"), "blocks")
    far = _best(index, read, terms, k, id, p)  # no block is scored twice
    return R.top(near.unionByName(far), k, id).select("qid", id, "score", "rank")


def read_counts(index: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", p: Params = DEFAULT) -> DataFrame:
    """``qid, blocks, read``: blocks that have a term of the query, and those that are read for it."""
    index, terms = _asked(index, queries, p)
    ranked = _ranked(index, terms, p)
    needed = ranked.filter(F.col("at") <= FIRST).select("qid", "block").unionByName(_needed(ranked, _best(index, _first(ranked), terms, k, id, p), k, id).select("qid", "block"))
    return ranked.groupBy("qid").agg(F.count("*").alias("blocks")).join(needed.groupBy("qid").agg(F.count("*").alias("read")), "qid")
