"""op8: unigram token counts of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.token_counts import count_tokens
from paperloom.session import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def query(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, model_path).select("doc_id", "n_pretokens", "n_tokens", "n_characters")
