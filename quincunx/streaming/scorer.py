"""Scoring of payload streams. Requests do not depend on each other, so each micro-batch is scored as a batch is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import score, search


def read(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """A stream of JSON lines {event_id, body}."""
    return spark.readStream.schema("event_id LONG, body STRING").option("maxFilesPerTrigger", most_files).json(path)


def start(stream: DataFrame, centroids: DataFrame, postings: DataFrame, out: str, checkpoint: str, **probes):
    """A query that appends each micro-batch's answers to Parquet; it ends when what is there is done.

    A batch has its own folder, so that a repeated one replaces itself, and
    what it holds in memory goes when it is written.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept = search.Kept()
        try:
            score.classify_payloads(batch, centroids, postings, kept=kept, **probes).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            kept.release()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
