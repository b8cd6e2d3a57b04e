"""op7: every document with its personal data and secrets replaced by surrogates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.private_data import surrogate_text
from paperloom.session import table

#: For the registered query only; a real run passes a secret key of its own.
KEY = b"not a secret: the key of the registered query"


def query(spark: SparkSession, sf_dir: str, key: bytes = KEY) -> DataFrame:
    found = surrogate_text(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities", "n_collisions")
