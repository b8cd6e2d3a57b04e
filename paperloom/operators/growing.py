"""A lexical index that grows by segments.

A segment holds the term counts and lengths of the documents that came together, never weights: what
a term weighs depends on all documents, so document counts and the mean length are merged when
the index is read, and weights are made for a query's terms only. A document that comes again
replaces its older version. Both tables are partitioned by ``segment``; writing a segment again replaces that partition only.
A segment counts once its lengths are there, which are written last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import search as R
from paperloom.params import DEFAULT, Params
from paperloom.session import kept
from paperloom.sources import readers


@dataclass(frozen=True)
class Growing:
    """``postings`` (id, term, tf, dl, segment), ``lengths`` (id, dl, segment) of all segments, whatever replaced."""

    postings: DataFrame
    lengths: DataFrame
    id: str

    def newest(self) -> DataFrame:
        """``id, segment`` of the version of each document that counts."""
        return self.lengths.groupBy(self.id).agg(F.max("segment").alias("segment"))

    def current(self) -> DataFrame:
        """Postings of documents as they are now."""
        return self.postings.join(self.newest(), [self.id, "segment"], "left_semi")


def term_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, term, tf, dl`` of documents, one row with a null term for one without terms.

    Of several rows of a document the greatest text counts. Texts are dealt by id once; terms are
    counted where their document is.
    """
    last = Window.partitionBy(id).orderBy(F.col("_text").desc_nulls_last())
    once = docs.filter(F.col(id).isNotNull()).select(id, F.col(text).alias("_text")).withColumn("_at", F.row_number().over(last)).filter("_at = 1")
    sized = once.select(id, X.tokens("_text").alias("_tokens")).select(id, F.size("_tokens").cast("long").alias("dl"), "_tokens")
    flat = sized.select(id, "dl", F.explode_outer("_tokens").alias("term"))
    return flat.groupBy(id, "term").agg(F.count("term").alias("tf"), F.first("dl").alias("dl"))


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)


def write_segment(docs: DataFrame, path: str, segment: int, id: str = "doc_id", text: str = "text", partitions: int = 16) -> None:
    """Write ``docs`` as the segment of that number, or write it again; no other segment is read or touched.

    Postings go to ``partitions`` files, or to as many as there are shuffle partitions if that is more. ``_counts`` holds the
    counts of the last segment written, which no search reads.
    """
    spark, counts = docs.sparkSession, f"{path}/_counts"  # written once: texts are split once for both tables
    term_counts(docs, id, text).withColumn("segment", F.lit(segment)).write.mode("overwrite").parquet(counts)
    counted, parts = spark.read.parquet(counts), max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _replace(counted.repartitionByRange(parts, "term").sortWithinPartitions("term", id), f"{path}/postings")
    _replace(counted.groupBy(id, "segment").agg(F.first("dl").alias("dl")).select(id, "dl", "segment"), f"{path}/lengths")


def load(spark: SparkSession, path: str, id: str = "doc_id") -> Growing | None:
    """The index below ``path``; None before its first segment."""
    if not readers.exists(spark, f"{path}/lengths"):
        return None
    return Growing(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), id)


def weights(index: Growing, terms: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``id, term, tf, weight`` of the documents as they are now, for ``terms`` (a column of that name) only."""
    newest = index.newest()
    lengths = index.lengths.join(newest, [index.id, "segment"], "left_semi")
    whole = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    few = index.postings.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi")
    tf = few.join(newest, [index.id, "segment"], "left_semi").select(index.id, "term", "tf", "dl")
    return R.weighted(tf, R.document_frequencies(tf), whole, index.id, p)


def search(index: Growing, queries: DataFrame, k: int, p: Params = DEFAULT) -> DataFrame:
    """``qid, id, score, rank`` as ``search.lexical_top`` over all current documents would give."""
    id, terms, newest = index.id, kept(R.query_terms(queries), "terms"), index.newest()
    whole = index.lengths.join(newest, [id, "segment"], "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    few = index.postings.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi")
    listed = few.groupBy(id, "segment").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("_l"))
    current = listed.join(newest, [id, "segment"], "left_semi").select(id, "dl", F.col("_l.term").alias("terms"), F.col("_l.tf").alias("tfs"))
    return R.counted_top(kept(current, "counts"), whole, terms, k, id, p)


def compact(spark: SparkSession, path: str, target: str, id: str = "doc_id", partitions: int = 16) -> None:
    """The index as it is now, as one segment in another folder; the segment has the highest number so far, so the copy can grow on."""
    index = load(spark, path, id)
    last = index.lengths.agg(F.max("segment").alias("n")).first()["n"]  # one row
    one = lambda rows: rows.drop("segment").withColumn("segment", F.lit(last))
    _replace(one(index.current()).repartitionByRange(partitions, "term").sortWithinPartitions("term", id), f"{target}/postings")
    _replace(one(index.lengths.join(index.newest(), [id, "segment"], "left_semi")), f"{target}/lengths")
