"""Readers. All schemas are given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "id STRING, text STRING, ocr STRING"
MANIFEST = "corp STRING, year INT, rcept_no STRING, report_nm STRING, file STRING, url STRING, sha256 STRING, bytes BIGINT, fetched DATE"
CAPTION = "page_id STRING, caption STRING, elapsed_sec DOUBLE"
STORE_META = "id STRING, document STRING, metadata STRUCT<route: STRING, source_file: STRING, image_path: STRING>"
QA = "id STRING, query STRING, answer STRING, type STRING, domain STRING, ground_truth ARRAY<INT>"
SYNTHETIC = "page_id STRING, query STRING"
# Phrases of questions that point at a page the reader can't see.
STOP_PHRASES = ["이 페이지", "이 문서", "위 표", "위 그림", "이 도서", "이 그림", "이 주제", "이 표", "페이지의", "이 자료", "이 사진", "본 자료", "이 연구진", "이 보고서", "본 보고서"]


def pages(spark: SparkSession, path: str, limit: int | None = None, with_image: bool = False) -> DataFrame:
    """Pages of a Parquet corpus; null texts become empty. The image column is read only if asked for,
    from ``image.bytes`` or a plain binary column."""
    df = spark.read.parquet(path)
    full = [F.col("id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "ocr"))]
    if with_image:
        kind = df.schema["image"].dataType
        full.append((F.col("image.bytes") if isinstance(kind, T.StructType) else F.col("image")).alias("image"))
    return head(df, limit).select(*full) if limit is not None else df.select(*full)


def head(df: DataFrame, limit: int) -> DataFrame:
    """The first rows of a Parquet scan in scan order: files by path, rows as they lie in the file.

    The key of the last row is found from file names and row numbers, for which no column is read; then only
    files up to it are listed and scanned.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    last = df.select(at.alias("at")).orderBy("at").limit(limit).agg(F.max("at").alias("at")).first()["at"]  # one row
    if last is None:
        return df.limit(0)
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return df.filter((path <= last["path"]) & ((path < last["path"]) | (row <= last["row"])))


def count_pages(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, content`` of all PDF files below a folder that start as one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.filter(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "length", "content").withColumn("sha256", F.sha2("content", 256))


def pdf_list(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of all PDF files below a folder in the order of their paths; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select("path", "length").orderBy("path")


def pdf_pages(files: DataFrame, reader, prefix: str = "") -> DataFrame:
    """Pages of PDF files by ``reader(content) -> [(text, ocr)]`` or ``[(text, ocr, tables)]``, an adapter around a PDF library.

    ``tables`` are those of the page as Markdown; they follow its text, and a list of them is joined.
    Pages are numbered from 1; a file that the reader can't open gives none.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    found = reader(content)
                except Exception:  # noqa: BLE001  an unreadable file is left out
                    continue
                rows += [{"id": f"{prefix}{stem}_{n}", "text": _with_tables(t or "", *more), "ocr": o or ""} for n, (t, o, *more) in enumerate(found, 1)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.string()), ("text", pa.string()), ("ocr", pa.string())]))

    return files.select("path", "content").mapInArrow(run, PAGE)


def _with_tables(text: str, tables=None) -> str:
    from paperloom.functions.text import TABLE_MARK

    parts = [tables] if isinstance(tables, str) else list(tables or ())
    found = "\n\n".join(x.strip() for x in parts if x and x.strip())
    return f"{text}\n\n{TABLE_MARK}\n{found}" if found else text


def page_images(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Where a row stands in a log: files in the order of their names, rows in the order of the file.
LOG_ORDER = "struct(_metadata.file_path, _metadata.file_block_start, monotonically_increasing_id())"


def manifest(spark: SparkSession, path: str, key: str = "url") -> DataFrame:
    """Filings, one row a URL (or another ``key``, such as rcept_no): the one logged last."""
    rows = json_lines(spark, path, MANIFEST).withColumn("_at", F.expr(LOG_ORDER)).filter(F.col(key).isNotNull())
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("_at", key)]), "_at").alias("_row")
    return rows.groupBy(key).agg(last).select(key, "_row.*")


def store(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks with their vectors."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def postings(spark: SparkSession, path: str) -> DataFrame | None:
    """The lexical index; None if there is none, which means dense search only."""
    return spark.read.parquet(path) if exists(spark, path) else None


def section_entries(spark: SparkSession, path: str) -> DataFrame:
    """Section data of pages; an empty table if none was written."""
    schema = "id STRING, no_content BOOLEAN, section_title STRING, prev_id STRING, next_id STRING"
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def filing_window(year: Column) -> tuple[Column, Column]:
    """First and last day on which the report of a business year is filed."""
    return F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(6), F.lit(30))


def in_window(listed: DataFrame, wanted: DataFrame, filed: str = "filed") -> DataFrame:
    """Of listed reports (corp, ``filed`` date, ...) those of a wanted (corp, year), with that year."""
    first, last = filing_window(F.col("year"))
    days = wanted.select("corp", "year", first.alias("_first"), last.alias("_last")).distinct()
    return listed.join(days, "corp").filter(F.col(filed).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def receipt_date(receipt: Column) -> Column:
    """The day in the first eight digits of a receipt number; null if they are no date."""
    return F.try_to_date(F.substring(receipt, 1, 8), "yyyyMMdd")


def captions(spark: SparkSession, path: str, order: Column | None = None) -> DataFrame:
    """The last caption of each page in an append-only log, whose files are named in order."""
    rows = json_lines(spark, path, CAPTION).withColumn("_at", order if order is not None else F.expr(LOG_ORDER))
    return rows.filter(F.coalesce("caption", F.lit("")) != "").groupBy("page_id").agg(F.max_by("caption", "_at").alias("caption"))


def qa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    out = spark.read.schema(QA).parquet(path)
    return out if limit is None else head(out, limit)


def new_filings(listed: DataFrame, known: DataFrame, keyword: str, most: int = 3) -> DataFrame:
    """Of listed attachments (rcept_no, report_nm, name, url) the PDF files of matching reports, ``most`` a report, not fetched yet."""
    pdf = listed.filter(F.contains("report_nm", F.lit(keyword)) & F.lower("name").endswith(".pdf"))
    first = Window.partitionBy("rcept_no").orderBy("name", "url")
    few = pdf.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    return few.join(known.select("url").distinct(), "url", "left_anti").withColumn("dcm_no", F.expr("parse_url(url, 'QUERY', 'dcm_no')"))
