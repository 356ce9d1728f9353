"""A training corpus from ``documents``: good, without repeated lines, near copies and benchmark items, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.decontaminate import decontaminated
from vigil.llm.line_dedup import dedup_lines
from vigil.llm.minhash_dedup import keep_one
from vigil.llm.packing import pack_documents
from vigil.llm.quality import keep_good
from vigil.llm.queries import tokenizer_path
from vigil.llm.session import drop, keep, scratch, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without multi-line passages that stood in an earlier one."""
    return dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id."""
    return keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, and their places in training sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained models and content-defined chunks are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder for the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
