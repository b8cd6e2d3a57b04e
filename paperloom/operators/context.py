"""Image choice, text budget and context packing for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import CUT_MARK
from paperloom.params import DEFAULT, Params


def text_budget(images: Column, p: Params = DEFAULT) -> Column:
    """Characters of text beside so many images."""
    tokens = F.lit(p.context_tokens - p.answer_tokens - p.reserved_tokens) - F.lit(p.tokens_per_image) * images
    return F.greatest((tokens * F.lit(p.chars_per_token)).cast("int"), F.lit(p.least_budget))


def choose_images(ranked: DataFrame, neighbors: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """``qid, images``: paths among the first ranks, ``image_most`` at most, then the neighbour's as one of ``image_extra`` more.

    ``ranked``: qid, rank, image_path; ``neighbors``: qid, image_path. The pages of all of these are
    passed over as text, and their number sets the text budget.
    """
    own = ranked.filter((F.col("rank") <= p.image_rank) & F.col("image_path").isNotNull())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "image_path"))), lambda s: s.image_path)
    out = own.groupBy("qid").agg(F.slice(listed, 1, p.image_most).alias("images"))
    if neighbors is None or not p.neighbor:
        return out
    more = neighbors.filter("image_path IS NOT NULL").select("qid", F.col("image_path").alias("_more"))
    none = F.array().cast("array<string>")
    both = out.join(more, "qid", "full").withColumn("images", F.coalesce("images", none))
    fits = F.col("_more").isNotNull() & ~F.array_contains("images", F.coalesce("_more", F.lit(""))) & (F.size("images") < p.image_most + p.image_extra)
    return both.select("qid", F.when(fits, F.array_append("images", F.col("_more"))).otherwise(F.col("images")).alias("images"))


def pack(chunks: DataFrame, images: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``qid, context, sources, budget_left`` from each query's chunks (qid, rank, text, source_file, image_path).

    Chunks fill the budget in rank order; one shown as an image is passed over, a long one is cut
    and marked, and the mark counts. When nothing is left, packing stops. A query has a handful of
    chunks, so the fold is over a short list.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("source_file", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), "image_path")))
    rows = chunks.groupBy("qid").agg(listed.alias("c")).join(images, "qid", "left")
    rows = rows.withColumn("images", F.coalesce("images", F.array().cast("array<string>"))).withColumn("budget", text_budget(F.size("images"), p))
    cut = F.lit(CUT_MARK)

    def step(state, c):
        allowed = F.least(F.lit(p.chars_per_chunk), state.budget)
        text = F.when(F.length(c.text) <= allowed, c.text).otherwise(F.concat(F.substring(c.text, F.lit(1), allowed), cut))
        skip = (state.budget <= 0) | (c.image_path.isNotNull() & F.array_contains(F.col("images"), F.coalesce(c.image_path, F.lit(""))))
        more = F.array(F.concat(F.lit("[출처: "), c.source, F.lit("]\n"), text))
        return F.struct(F.when(skip, state.budget).otherwise(state.budget - F.length(text)).alias("budget"), F.when(skip, state.parts).otherwise(F.concat(state.parts, more)).alias("parts"))

    start = F.struct(F.col("budget"), F.array().cast("array<string>").alias("parts"))
    out = rows.withColumn("packed", F.aggregate("c", start, step))
    return out.select("qid", F.array_join("packed.parts", "\n\n").alias("context"), F.transform("c", lambda c: c.source).alias("sources"), F.col("packed.budget").alias("budget_left"))


def with_neighbor(ranked: DataFrame, following: DataFrame) -> DataFrame:
    """``ranked`` (qid, rank, page_id, ...) and, after its last row, each query's neighbour (qid, page_id, ...)."""
    last = ranked.groupBy("qid").agg((F.max("rank") + 1).alias("rank"))
    return ranked.unionByName(following.join(last, "qid"), allowMissingColumns=True)
