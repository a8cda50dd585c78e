"""A training corpus from ``documents``: rules, line dedup, near-duplicates, decontamination and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowcheck.llm import decontaminate, line_dedup, minhash, mixing, quality
from stowcheck.llm.tables import read_table, ship_code, stored
from stowcheck.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows; n_chars follows the text."""
    return with_length(docs, line_dedup.without_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with similarity 0.8 or more."""
    ship_code(spark)
    return minhash.one_of_each(docs, minhash.Plan(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist mostly of them go."""
    ship_code(spark)
    return with_length(docs, decontaminate.remove_spans(docs, read_table(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes."""
    return mixing.mixed_copies(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mix),
]

# near-duplicates need a search that SQL can't express at size; tests compare with brute force
ORACLE_SQL = None


def with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars, where the table has it, set to the length of its texts."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.length("text").cast(kind))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    spark = configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
