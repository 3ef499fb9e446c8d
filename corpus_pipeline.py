"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages take documents with nulls in any column, empty and very long texts, repeated rows and extra columns of any name,
pass all columns on (packing: its own) and give an empty table for an empty one. What they do with ties stands in the
operators. This file needs quillspark.llm and goes with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import line_dedup, mixing, near_dups, packing, repetition
from quillspark.llm.common import load, stage
from quillspark.storage import only_last


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and repetition rules keep; null and blank texts have too few words and go."""
    return repetition.keep_by_rules(docs)


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later repeated three-line windows go; documents that lose all lines go with them, null and blank texts stay."""
    return line_dedup.keep_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles stays, and all without a text or an id."""
    return near_dups.keep_representatives(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them; one taken twice is there twice, one without words goes."""
    return mixing.take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the packed sequences; a null text is an empty one."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_windows),
    ("near duplicates", near_duplicates),
    ("source mix", mix_sources),
    ("packing", pack),
]

#: The tokenizer's merges and the packing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES:
        with only_last(spark):  # what a stage wrote for itself goes once its result is written
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
