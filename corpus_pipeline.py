"""The training-text pipeline over ``documents``: each stage reads what the one before wrote.

Languages are identified and what can't be told goes; repeated lines are cut; of near-duplicate
documents one stays; contaminated documents go; what remains is tokenised. All stages but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where the text changed.

Defined cases: a text that is null or has no letter goes with the first stage; a document may become
empty with its lines, and an empty one is a near-duplicate of other empty ones; of repeated rows one
stays; texts of one id are decided apart; rows without an id stay unless their own text is rejected;
further columns pass through whatever their names, to the last stage; empty tables give empty ones.
Very long texts are handled as the operators state.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import id_mod, stored
from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.langid import UNKNOWN, identify, train
from paperloom.llm.lines import BANDS, dedup_lines
from paperloom.llm.segment import encode
from paperloom.llm.simhash import near_duplicates
from paperloom.session import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A language is told if it is this many times as likely as the least likely one. So texts in two known languages
#: stay, and texts in none go, however many labels there are. A model that tells its own rows no better asks for less.
LEAST_LEAD = 2.0

#: What the stages know of a document; its other columns travel as one.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def others_apart(stage):
    """``stage`` without sight of the other columns of ``docs``, so that none clashes with a name of its own."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in OWN]
        if not others:
            return stage(spark, docs, sf_dir)
        own = [F.col(c) for c in docs.columns if c in OWN]
        out = stage(spark, docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")), sf_dir)
        return out.select(*(F.col(f"_others.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns))

    return run_apart


@others_apart
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, by a model learned from the labelled ones."""
    model = train(docs, "doc_id", "text", "lang", F.lit(True), id_mod("doc_id", 4) == 3)
    found, least = identify(docs, model), min(LEAST_LEAD, model.get("lead", LEAST_LEAD))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least * F.col("least_score"))).select(docs.columns)


@others_apart
def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others have or nearly have, as op10 finds them; a document may end up empty."""
    found = dedup_lines(docs, bands=BANDS)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


@others_apart
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id; rows without an id stay.

    A document is an id and a hash of its text, so different texts of one id are decided apart.
    """
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_hash")).alias("row")
    groups = stored(near_duplicates(keyed.select(row, "text"), "row"), "groups")
    goes = groups.filter("row <> component_id").select("row.doc_id", "row._hash").distinct()
    kept = keyed.join(goes.hint("shuffle_hash"), ["doc_id", "_hash"], "left_anti")
    rows = groups.filter("row = component_id").select("row")
    if rows.groupBy("row").count().filter("count > 1").limit(1).count():  # repeated rows; else no shuffle is needed
        kept = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_hash"]).unionByName(kept.filter("doc_id IS NULL"))
    return kept.select(docs.columns)


@others_apart
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document and two sampled segmentations."""
    return encode(docs.select("doc_id", "text"), MODEL, samples=2).select("doc_id", "ids", "decodes", "samples")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("simhash_dedup", one_of_each_group),
    ("decontaminate", clean_of_benchmark),
    ("sentencepiece", tokens),
]

#: SQL has neither the learned model nor the hashes of the stages; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
