"""An index run and what it leaves: stored chunks with vectors, postings and section data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import blocks as B
from paperloom.operators import pages as P
from paperloom.operators import search as R
from paperloom.params import DEFAULT, Params
from paperloom.sources import readers, writers


@dataclass(frozen=True)
class Index:
    """Tables of an index; without ``postings`` and ``blocks`` (either does) search is dense only."""

    store: DataFrame
    postings: DataFrame | None
    sections: DataFrame
    blocks: DataFrame | None = None

    def __len__(self) -> int:
        return self.store.count()


def write(path: str, store: DataFrame, postings: DataFrame | None = None, sections: DataFrame | None = None, partitions: int = 200, blocks: DataFrame | None = None) -> None:
    writers.store(store, f"{path}/store")
    if postings is not None:
        writers.postings(postings, f"{path}/postings", partitions)
    if blocks is not None:
        B.write(blocks, f"{path}/blocks", partitions)
    if sections is not None:
        writers.sections(sections, f"{path}/sections")


def load(spark: SparkSession, path: str) -> Index:
    blocks = B.load(spark, f"{path}/blocks") if readers.exists(spark, f"{path}/blocks") else None
    return Index(readers.store(spark, f"{path}/store"), readers.postings(spark, f"{path}/postings"), readers.section_entries(spark, f"{path}/sections"), blocks)


def search(index: Index, queries: DataFrame, id: str = "page_id", p: Params = DEFAULT) -> DataFrame:
    """``qid, id, score, rank`` of hybrid search over a loaded index; blocks of postings are read in preference."""
    barred = index.sections.filter("no_content").select(F.col("id").alias(id)) if p.filter_no_content else None
    stored = partial(B.search, index.blocks, p=p) if index.blocks is not None else partial(R.stored_top, index.postings) if index.postings is not None else None
    return R.search(None, index.store, queries, id, p, barred, stored=stored)


def run(spark: SparkSession, pages: DataFrame, captions: DataFrame, embed, path: str, manifest: DataFrame | None = None, p: Params = DEFAULT, partitions: int = 200) -> DataFrame:
    """From pages to an index at ``path``; a report of one row.

    Pages (id, text, ocr, has_image, ink, seq) are routed, image pages capped, chunks embedded by the
    column function ``embed`` once and stored; postings of their lexical texts and section data are
    made from the stored table. ``failed`` counts image pages without a caption.
    """
    routed = P.cap_images(P.route(pages, p), p.image_cap)
    chunks = P.chunks(routed, captions).withColumn("embedding", embed(F.col("text_for_embedding")))
    write(path, chunks.withColumnRenamed("text_for_embedding", "document"))
    store = load(spark, path).store
    sections = P.section_map(store.select(F.col("page_id").alias("id"), "document", "route"))
    writers.sections(sections, f"{path}/sections")
    filings = manifest if manifest is not None else spark.createDataFrame([], "rcept_no string, report_nm string")
    titled = store.join(sections.select(F.col("id").alias("page_id"), "section_title"), "page_id", "left")
    texts = P.lexical_text(P.with_prefix(titled, filings)).select("page_id", F.col("lexical_text").alias("text"))
    writers.postings(R.postings(texts, "page_id", p=p), f"{path}/postings", partitions)
    missing = routed.filter("route = 'image'").join(captions.select(F.col("page_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("failed"))
    return P.route_stats(routed).crossJoin(store.agg(F.count("*").alias("chunks"))).crossJoin(missing)  # one row each
