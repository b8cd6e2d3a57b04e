"""op6: SentencePiece tokens of every document and two sampled segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.segment import encode
from paperloom.session import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def digests(found: DataFrame) -> DataFrame:
    """Counts and hashes of the encoding and of each sample, with its scores."""
    sample = lambda s: F.struct(F.size(s.ids).alias("n_tokens"), F.xxhash64(s.ids).alias("ids_xxh64"), s.log_prob.alias("log_prob"), s.value.alias("value"), s.log_inclusion.alias("log_inclusion"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"), "decodes", F.transform("samples", sample).alias("samples"))


def query(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path, samples=2, kept=3_000_000))
