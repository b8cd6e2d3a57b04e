"""Take the documents that are new since the last run into a lexical index.

    python -m jobs.grow_index --documents PATH --output PATH --checkpoint PATH [--config FILE]

New files of the documents (Parquet) come as a file stream with its checkpoint; a run takes all that are there and
ends. Each batch becomes the segment of its number (``paperloom.operators.growing``). A batch that was cut off is read again
from the checkpoint and replaces its own partitions, so no run leaves a document twice; a run that
finds no new file changes nothing. Checkpoint and output belong together. A document that comes again, in a new
file, replaces its older version for every search; its old rows stay until ``growing.compact``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from paperloom.operators import growing

log = logging.getLogger("grow_index")
DEFAULTS = {"id": "doc_id", "text": "text", "partitions": 16, "files_per_batch": None}


def _pattern(path: str) -> str:
    """A pattern that only this path fits: a stream takes a folder by its name, but a single file by a pattern only."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Grow the index below ``output``; what was read and written: batches, rows, documents."""
    c = DEFAULTS | (config or {})
    done = {"batches": 0, "rows": 0, "documents": 0}
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFileAge", "36500d")  # files count however old they are
    if c["files_per_batch"]:
        source = source.option("maxFilesPerTrigger", c["files_per_batch"])

    def take(batch: DataFrame, number: int) -> None:
        read = Observation()
        rows = batch.select(c["id"], c["text"]).observe(read, F.count(F.lit(1)).alias("rows"))
        growing.write_segment(rows, output, number, c["id"], c["text"], c["partitions"])
        made = batch.sparkSession.read.parquet(f"{output}/lengths").filter(F.col("segment") == number).count()
        log.info("batch %d: read %d rows of %s, wrote %d documents to segment %d of %s", number, read.get["rows"], documents, made, number, output)
        for k, n in (("batches", 1), ("rows", read.get["rows"]), ("documents", made)):
            done[k] += n

    query = source.parquet(_pattern(documents)).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s", output, done)
    return done


def result(spark: SparkSession, output: str, id: str = "doc_id") -> DataFrame:
    """The whole index as it is now: ``id, dl, term, tf``, a null term for documents without terms."""
    return growing.load(spark, output, id).current().select(id, "dl", "term", "tf")


if __name__ == "__main__":
    main(run, "grow_index", "documents", "output", "checkpoint", defaults=DEFAULTS)
