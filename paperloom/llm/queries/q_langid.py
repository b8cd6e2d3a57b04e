"""op2: predicted language of every document, learned from three quarters of the labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import id_mod
from paperloom.llm.langid import identify, train
from paperloom.session import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = id_mod("doc_id", 4)
    model = train(docs, "doc_id", "text", "lang", fold != 2, fold == 3)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
