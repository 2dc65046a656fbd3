"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

N-grams of code points (lower case, white space as one blank) are hashed to
2**20 buckets. Document frequencies by class are counted on the executors over
a bounded sample of labelled rows; the buckets with the surest log-count ratios
become features, present or not, scaled by that ratio; a logistic regression is
fitted to them on the driver.

Null and empty texts have no features and get the model's base score; texts of
any length are read whole; of equally sure buckets the lower numbers are taken;
only doc_id and text are read, whatever other columns there are; repeated rows are scored alike; an empty table gives an empty result; without labelled
rows of both classes every score is the smoothed rate of the labels that exist.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: The most labelled rows that a model is fitted on, and the most features it keeps.
TRAIN_ROWS = 20_000
FEATURES = 4096
BUCKET_BITS = 20
ORDERS = (3, 4, 5, 6)
_STEP = np.uint32(0x9E3779B1)


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of the whole text, repeats included."""
    folded = " ".join((text or "").lower().split())
    if not folded:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, rolled = [], codes
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * _STEP + codes[n - 1 :]
        if n in ORDERS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            out.append((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Linear:
    bucket: np.ndarray
    weight: np.ndarray
    base: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.bucket] = self.weight
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def regress(row: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of present features scaled by their ratios: accelerated gradient descent on the whole sample."""
    n, width = len(y), len(ratio)
    value = ratio[col]
    w = seen = np.zeros(width)
    b = seen_b = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    norms = np.bincount(row, value**2, n)
    rate = 1 / (0.25 * (np.percentile(norms, 99) + 1) + l2 / n)
    for k in range(steps):
        error = _sigmoid(np.bincount(row, value * seen[col], n) + seen_b) - y
        new_w = seen - rate * (np.bincount(col, error[row] * value, width) / n + l2 * seen / n)
        new_b = seen_b - rate * error.mean()
        mix = k / (k + 3)
        seen, seen_b = new_w + mix * (new_w - w), new_b + mix * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Linear:
    """A model from at most train_rows rows of `labels.toxic` outside the held-out fold."""
    sample = runtime.labelled(docs, labels, "toxic", 4, 2, train_rows)

    def count(batches):
        found = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        n = [0, 0]
        for batch in batches:
            for part in runtime.small(batch):
                for label, text in zip(part["label"].to_pylist(), part["text"].to_pylist(), strict=True):
                    n[label > 0] += 1
                    found[int(label > 0), np.unique(buckets(text))] += 1
        at = np.flatnonzero(found.any(0))
        yield pa.record_batch([pa.array([*at.tolist(), -1]), pa.array([*found[0, at].tolist(), n[0]]), pa.array([*found[1, at].tolist(), n[1]])], ["bucket", "clean", "toxic"])

    counted = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counted.where("bucket = -1 or clean + toxic >= 4").toArrow().sort_by("bucket")  # at most 2**20 rows
    bucket, clean, toxic = (rows[c].to_numpy().astype(float) for c in ("bucket", "clean", "toxic"))
    if not len(bucket) or not clean[0] or not toxic[0]:
        n0, n1 = (clean[0], toxic[0]) if len(bucket) else (0, 0)
        return Linear(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    p, q = 1 + toxic[1:], 1 + clean[1:]
    ratio = np.log(p / (toxic[0] + 2)) - np.log(q / (clean[0] + 2))
    sure = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    kept = np.sort(np.argsort(-sure, kind="stable")[:features])
    chosen, ratio = bucket[1:][kept].astype(np.int64), ratio[kept]

    def present(batches):
        number = np.full(1 << BUCKET_BITS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        for batch in batches:
            for part in runtime.small(batch):
                found = [number[buckets(t)] for t in part["text"].to_pylist()]
                yield pa.record_batch([part["doc_id"], part["label"], pa.array([np.unique(f[f >= 0]).tolist() for f in found], pa.list_(pa.int32()))], ["doc_id", "label", "f"])

    rows = sample.mapInArrow(present, "doc_id long, label int, f array<int>").toArrow().sort_by("doc_id")
    lists = rows["f"].combine_chunks()
    col = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
    w, b = regress(row, col, ratio, np.array(rows["label"].to_pylist(), float).clip(0, 1))
    return Linear(chosen, w * ratio, b)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, train_rows))  # at most FEATURES weights

    def run(batches):
        weights, base = shared.value.dense(), shared.value.base
        for batch in batches:
            for part in runtime.small(batch):
                z = []
                for text in part["text"].to_pylist():
                    at = buckets(text)
                    z.append(base + float(weights[np.unique(at[weights[at] != 0])].sum(dtype=np.float64)))
                yield pa.record_batch([part["doc_id"], pa.array(_sigmoid(np.array(z, float)))], ["doc_id", "score"])

    scored = runtime.id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", runtime.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels"))
