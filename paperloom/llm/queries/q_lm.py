"""op3: log10 probability of every document under a smoothed unigram and the log-bilinear model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import id_mod
from paperloom.llm.lm import score_held_out
from paperloom.session import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_mod("doc_id", 10)
    found = score_held_out(docs, fold != 0, fold == 0)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
