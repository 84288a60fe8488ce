"""From raw documents to token identifiers: five operators, one after the other.

Every stage takes all that its predecessor kept and is written to the shared
folder before the next reads it.

Cases, in every stage: null text counts as empty (and is null in what is kept); a null id or source is
a value like others; rows of one id with different texts are documents of their own; texts of any
length are taken whole; an empty table gives an empty result; further columns are passed on up to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import minhash, mixing, pii, quality, sentencepiece_np
from corvane.llm.store import Scratch
from corvane.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are too frequent on their host; documents without words go."""
    return quality.quality_filter(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; documents without words have no group and stay."""
    return minhash.near_dedup(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; overlapping finds become one, null text stays null."""
    return pii.redact(docs)


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document once at least, those of small sources in several passes; a null source is the source ''."""
    return mixing.mix(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every whole text; null text has none."""
    return sentencepiece_np.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii", pii_redaction),
    ("temperature_mixing", temperature_mixing),
    ("sentencepiece", sentencepiece_encoding),
]

#: SQL can't express the signatures, the near-duplicate groups or the Viterbi search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
