"""Writers. A table appears whole or not at all, by Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, one row a page."""
    chunks.write.mode("overwrite").parquet(path)


def postings(rows: DataFrame, path: str, partitions: int = 200) -> None:
    """Postings sorted by term, so that a query's terms are read from few row groups."""
    rows.repartitionByRange(partitions, "term").sortWithinPartitions("term", F.desc("weight")).write.mode("overwrite").parquet(path)


def sections(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_captions(rows: DataFrame, path: str) -> None:
    """New captions (page_id, caption, elapsed_sec); empty ones aren't logged."""
    rows.filter(F.coalesce("caption", F.lit("")) != "").withColumn("elapsed_sec", F.round("elapsed_sec", 2)).write.mode("append").json(path)


def report(row: DataFrame, path: str) -> None:
    """A summary as JSON lines, non-ASCII characters kept."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """Newly fetched filings, added to the log."""
    rows.write.mode("append").json(path)


def images(rows: DataFrame, root: str, write) -> DataFrame:
    """``name, written`` after ``write(path, content)`` of each image (name, content) that isn't there yet.

    ``root`` is a folder that all executors share; ``write`` gives False if the file exists.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.column("name").to_pylist()
            done = [bool(write(f"{root}/{n}", c)) for n, c in zip(names, batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_pydict({"name": names, "written": done})

    return rows.select("name", "content").mapInArrow(run, "name string, written boolean")
