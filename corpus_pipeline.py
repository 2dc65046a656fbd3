"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir); its result, written as Parquet and read again, is the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quincunx.llm import decontam, lines, pieces, quality, runtime, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted on the labelled ones among docs, does not reject."""
    return quality.accepted(docs, runtime.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that the corpus has, nearly or exactly, in an earlier place; a text that was nothing else goes."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item has leaked."""
    return decontam.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the proof that they decode to it."""
    return pieces.encode(docs, with_ids=True)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: A trained model, fuzzy groups and a tokenizer are beyond SQL; tests/llm compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = runtime.table(spark, sf_dir, "documents")
    work = runtime.Workspace(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.put(docs, name)
    return docs
