"""Queries by name, and what many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score, search
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(made):
        QUERIES[name] = made
        if sql is not None:
            ORACLE_SQL[name] = sql
        return made

    return add


def _kept(v: DataFrame) -> DataFrame:
    """What references and queries need of vectors, kept in memory, and on disk beyond it: no features, fine components of queries alone."""
    return v.select("event_id", "label", "q", F.when(F.col("event_id") % 50 == 0, F.col("h")).alias("h")).persist()


def _parts(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    refs = tables.references(v).select(F.col("event_id").alias("id"), "label", "q")
    return refs, tables.asked(v).select(F.col("event_id").alias("qid"), "q", "h", F.col("label").alias("own"))


def split(spark, d) -> tuple[DataFrame, DataFrame]:
    """(references id, label, q; queries qid, q, h, own), both of vectors that are made once and kept, on disk beyond memory."""
    return _parts(_kept(tables.tx_vec(spark, d)))


def index(spark, d, k: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centroids, postings, queries); what a stored index would hold is kept in memory, and on disk beyond it."""
    refs, queries = _parts(_kept(tables.tx_vec(spark, d)))
    cents = score.first_references(refs, k)
    return cents, search.assign(refs, cents).persist(), queries


def r6(x) -> F.Column:
    return F.round(x, 6)


def emb(spark, d) -> DataFrame:
    return tables.emb14(spark, d).withColumnRenamed("vec_id", "id")


def emb_assigned(spark, d) -> tuple[DataFrame, DataFrame]:
    """(centroids, vectors assigned to them) of the table embeddings."""
    e = emb(spark, d)
    cents = score.first_references(e, 32)
    return cents, search.assign(e.select("id", "label", "q"), cents)
