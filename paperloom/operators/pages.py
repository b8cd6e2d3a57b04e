"""Routing, chunk text, prefixes and section maps of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import sections as S
from paperloom.functions import text as X
from paperloom.params import DEFAULT, Params

#: Routes whose page image is kept.
IMAGE_BACKED = ("image", "ocr")


def route(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``pages`` (id, text, ocr, has_image, ink) with ``route``: the first kind of content that is enough."""
    length = lambda c: F.length(X.strip(F.coalesce(F.col(c), F.lit(""))))
    kind = (
        F.when(length("text") >= p.min_text_chars, "text")
        .when(length("ocr") >= p.min_ocr_chars, "ocr")
        .when(~F.col("has_image"), "blank")
        .when(F.col("ink") < p.blank_ink, "blank")
        .otherwise("image")
    )
    return pages.withColumn("route", kind)


def cap_images(routed: DataFrame, cap: int, order: str = "seq", id: str = "id") -> DataFrame:
    """The first ``cap`` image pages by ``order``, then id, stay ``image``; later ones become ``image_overflow``.

    The cut is the place of the last page that stays: one row, found by a bounded top-k, instead of
    a running count over all pages in one task.
    """
    keys = [c for c in (order, id) if c in routed.columns]
    place = F.struct(*keys)
    last = routed.filter("route = 'image'").select(*keys).orderBy(*keys).limit(cap).agg(F.max(place).alias("_last"))
    beyond = F.col("route").eqNullSafe("image") & (F.col("_last").isNull() | (place > F.col("_last")))
    return routed.crossJoin(F.broadcast(last)).withColumn("route", F.when(beyond, "image_overflow").otherwise(F.col("route"))).drop("_last")


def route_stats(routed: DataFrame) -> DataFrame:
    count = lambda r: F.count_if(F.col("route") == r)
    return routed.agg(
        F.count("*").alias("total"), count("text").alias("text_route"), count("ocr").alias("ocr_route"), count("image").alias("image_route"),
        count("blank").alias("blank_skipped"), count("image_overflow").alias("image_overflow_route"),
    )


def chunks(routed: DataFrame, captions: DataFrame) -> DataFrame:
    """One chunk for each page with text: ``page_id, route, text_for_embedding, source_file, image_path``.

    ``captions``: page_id, caption. An image page has its caption and what was read from it; white
    space that was read still counts as read, so its text isn't taken instead.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    read = F.when(full("ocr") != "", full("ocr")).otherwise(full("text"))
    present = lambda c: F.nullif(X.strip(c), F.lit(""))
    chosen = (
        F.when(F.col("route") == "text", full("text"))
        .when(F.col("route") == "ocr", full("ocr"))
        .when(F.col("route") == "image", F.concat_ws("\n", present(F.col("caption")), present(read)))
        .otherwise(read)
    )
    joined = routed.filter("route <> 'blank'").join(captions.select(F.col("page_id").alias("id"), "caption"), "id", "left")
    path = F.when(F.col("route").isin(*IMAGE_BACKED), X.safe_name(F.col("id")))
    out = joined.select(F.col("id").alias("page_id"), "route", chosen.alias("text_for_embedding"), F.col("id").alias("source_file"), path.alias("image_path"))
    return out.filter(X.strip(F.col("text_for_embedding")) != "")


def with_prefix(rows: DataFrame, manifest: DataFrame, page_id: str = "page_id") -> DataFrame:
    """``rows`` with ``prefix``. ``manifest``: rcept_no, report_nm, one row a filing."""
    joined = rows.withColumn("_receipt", X.receipt(F.col(page_id))).join(manifest.select(F.col("rcept_no").alias("_receipt"), F.col("report_nm").alias("_report")), "_receipt", "left")
    return joined.withColumn("prefix", X.prefix(F.col(page_id), F.col("_report"))).drop("_receipt", "_report")


def lexical_text(rows: DataFrame, prefix: str = "prefix", title: str = "section_title", text: str = "document") -> DataFrame:
    """``rows`` with ``lexical_text``: document and section names as a first line, for the lexical index only."""
    head = F.concat_ws(" ", F.nullif(F.col(prefix), F.lit("")), F.nullif(F.col(title), F.lit("")))
    return rows.withColumn("lexical_text", F.when(head != "", F.concat(head, F.lit("\n"), F.col(text))).otherwise(F.col(text)))


def section_map(records: DataFrame) -> DataFrame:
    """``id, no_content, section_title, prev_id, next_id`` of pages (id, document, route) whose id has a number.

    A title holds until the next one in page order; before the first it is empty.
    """
    pages = records.select("id", X.doc_key(F.col("id")).alias("doc_key"), X.page_order(F.col("id")).alias("page_order"), S.no_content(F.col("document"), F.col("route")).alias("no_content"), S.section_title(F.col("document")).alias("own_title")).filter("doc_key IS NOT NULL")
    order = Window.partitionBy("doc_key").orderBy("page_order", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.coalesce(F.last("own_title", ignorenulls=True).over(upto), F.lit(""))
    return pages.select("id", "no_content", title.alias("section_title"), F.lag("id").over(order).alias("prev_id"), F.lead("id").over(order).alias("next_id"))


def section_stats(records: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts and shares of pages without content, over all pages and over image pages."""
    joined = records.select("id", "route").join(sections.select("id", "no_content", "section_title"), "id", "left")
    image, empty = F.col("route") == "image", F.coalesce("no_content", F.lit(False))
    out = joined.agg(
        F.count("*").alias("pages"), F.count_if(image).alias("image_pages"), F.count_if(empty).alias("no_content_pages"), F.count_if(image & empty).alias("no_content_image_pages"),
        F.count_if(F.coalesce("section_title", F.lit("")) != "").alias("titled_pages"),
    )
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    return out.withColumns({"no_content_share": share("no_content_pages", "pages"), "no_content_image_share": share("no_content_image_pages", "image_pages")})


def sparse_stats(pages: DataFrame, file: str = "file", text: str = "text", least: int = 100) -> DataFrame:
    """Pages and pages of little text for each file, and in total (file null)."""
    return pages.rollup(file).agg(F.count("*").alias("pages"), F.count_if(F.length(X.strip(F.coalesce(text, F.lit("")))) < least).alias("sparse_pages"))


def variant_text(rows: DataFrame, captions: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """``rows`` (page_id, route, document) with the documents of image pages rewritten: caption, then what was
    read (``read``: page_id, text) if given; a page that has neither keeps its document."""
    joined = rows.join(captions.select("page_id", "caption"), "page_id", "left")
    parts = [F.nullif(X.strip(F.col("caption")), F.lit(""))]
    if read is not None:
        joined = joined.join(read.select("page_id", F.col("text").alias("_read")), "page_id", "left")
        parts.append(F.nullif(X.strip(F.col("_read")), F.lit("")))
    new = F.nullif(F.concat_ws("\n", *parts), F.lit(""))
    return joined.withColumn("document", F.when(F.col("route") == "image", F.coalesce(new, "document")).otherwise(F.col("document"))).drop("caption", "_read")


def with_urls(results: DataFrame, images: DataFrame, image_path: str = "image_path") -> DataFrame:
    """``results`` with ``image_url`` of those whose image exists (``images``: name)."""
    named = results.withColumn("_name", F.element_at(F.split(F.nullif(F.col(image_path), F.lit("")), "/"), -1))
    known = images.select(F.col("name").alias("_name"), F.lit(True).alias("_known")).distinct()
    return named.join(known, "_name", "left").withColumn("image_url", F.when(F.col("_known"), X.result_url(F.col(image_path)))).drop("_name", "_known")
