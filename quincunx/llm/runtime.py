"""What every operator of this subpackage needs: workers that can import it, and written tables that outlive executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Python workers started from now on can import this package (a cluster submits it with --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key, default, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if (spark.conf.get(key, default) or default).rstrip("b") == default:  # whole texts are long rows; a chosen setting stays
            spark.conf.set(key, ours)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder; a local one only in local mode where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quincunx-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quincunx-{uuid.uuid4().hex}"


#: Rows of a few numbers that are worth a file.
FILE_ROWS = 1 << 14


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, narrow rows without hot keys and about so many, in no more partitions than they are worth.

    Each task that writes a table makes a file, and without Hadoop's native
    library a local file system starts three processes for each.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


class Workspace:
    """Written tables of one operator call, or those under a folder that is given and stays.

    Each put() cuts lineage: a lost executor costs a re-read, not a
    recomputation. drop() removes tables that later steps no longer need.
    """

    def __init__(self, spark: SparkSession, top: str | None = None):
        ship(spark)
        self.spark, self.top = spark, top.rstrip("/") if top else shared_dir(spark)

    def put(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        at = f"{self.top}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(at)
        return self.get(name, df.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of steps that are over."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read, whatever else a table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def small(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about most_bytes each, so that working arrays stay bounded whatever the texts' lengths."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def held_out(mod: int, rest: int):
    """crc32 of the id's decimal text, by remainder; a null id is in no fold and never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, rest: int, most: int) -> DataFrame:
    """(label, text) of at most `most` labelled rows outside the held-out fold.

    The bound is the operator's documented parameter. Rows are taken by the
    hash of their id, so that the choice does not depend on the layout. An id
    labelled more than once counts as its highest label; null labels are left out.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(mod, rest))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(most)
    )
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def by_key(batches, key: str, columns: list[str]):
    """(key, rows) of adjacent rows with equal keys; rows: lists, one for each column. Holds one key's rows at a time."""
    now, held = None, None
    for batch in batches:
        keys = batch[key].to_pylist()
        rows = [batch[c].to_pylist() for c in columns]
        for k, at in enumerate(keys):
            if held is None or at != now:
                if held is not None:
                    yield now, held
                now, held = at, [[] for _ in columns]
            for column, values in zip(held, rows, strict=True):
                column.append(values[k])
    if held is not None:
        yield now, held
