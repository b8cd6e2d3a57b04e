"""op10: what remains of every document when repeated lines are cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.lines import BANDS, dedup_lines
from paperloom.session import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), bands=BANDS)
    return found.select("doc_id", "n_lines", "n_cut", "cut_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
