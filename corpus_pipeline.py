"""A training-corpus pipeline: filter, deduplicate, mask and pack documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lymphframe.llm import packing, pii, simhash, suffix_dedup, toxicity
from lymphframe.session import stage, staged, table, unstage_since


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents share are cut out; a document stays even if nothing is left of its text."""
    return suffix_dedup.strip_repeats(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets."""
    return pii.mask_all(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row a piece."""
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("simhash_near_dedup", _near_dedup), ("suffix_array_dedup", _suffix_dedup), ("pii", _pii), ("best_fit_packing", _packing)]

#: No SQL form exists for these stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written as Parquet to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), staged()
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
        unstage_since(before, docs)  # the stage's own tables and the one before it
    return docs
