"""The corpus pipeline: quality rules, near duplicates, repeated passages, PII, packing.

Each stage is a thin use of one training-data operator: it takes what the stage before it
kept and returns documents with the same columns; the last one returns the packing. `run`
writes every stage's table to the shared folder and reads it again, so that a lost machine
repeats one stage at most.

All stages: columns of other names go through, whatever they are called; an empty table
gives no rows; texts of any length are worked on whole; rows without id and rows that occur
twice are rows like any others unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.common import Scratch
from flowloom.llm.minhash_dedup import distinct_documents
from flowloom.llm.packing import packed
from flowloom.llm.pii import redacted
from flowloom.llm.quality_rules import good_documents
from flowloom.llm.substring_dedup import cleaned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and go. Equal texts have equal verdicts.
    """
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Of rows without id, or with one id, one stays. Null, empty and blank texts are in no group.
    """
    return distinct_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that also occur elsewhere go; every document keeps its row.

    A text that loses nothing stays as it is, null included. Equal texts lose equal words.
    """
    return cleaned(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; null texts stay null."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, place of each piece of each document.

    A document without words is one piece of length 0 in no bin. Pieces of equal length go
    in the order of cluster, id and piece.
    """
    return packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: The label model of the first stage and the packing of the last can't be put into SQL;
#: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
