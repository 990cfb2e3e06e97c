"""From raw documents to packed training sequences, one operator per stage.

A null text counts as empty. Empty texts are scored like others; those that stay are one group of near-duplicates, of which
one row stays, and take one token in a sequence. Rows without an id, tied and repeated rows are what the operators' docstrings
say: of rows that agree in id and text one stays. Empty tables pass through. Extra columns pass through to the last
stage but one; those named like a column that an operator returns (score, tokens, sampled ...) hold the operator's values
afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_runs, quality_fm, queries, raking, simhash_gph
from ledgerloom.llm.frames import scratch, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more."""
    machine = quality_fm.train(docs, queries.table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, machine).filter(F.col("score") >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones. No document goes; one that only repeats is left empty."""
    done = line_runs.drop_copies(docs).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash_gph.one_of_each(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of tokens."""
    mixed = raking.mix(docs, dims={"topic": raking.topic_of(F.col("text"))})
    return mixed.filter("sampled").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

# The classifier is fitted by gradient steps and fingerprints are XXH64, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written and read back; what it staged on the way goes when they are."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with scratch(spark):
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
    return docs
