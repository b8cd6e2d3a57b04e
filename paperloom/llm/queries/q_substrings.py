"""op5: what remains of every document without its repeated 400-byte strings, as digest, spans and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.substrings import remove_repeats
from paperloom.session import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    # A span may end within a character, so what is left is made valid UTF-8 (the hash is of the bytes as they are).
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans", text)
