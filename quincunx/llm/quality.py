"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on the executors; trees are grown on the
driver from a bounded sample of labelled rows and flattened into arrays, which
executors traverse for all rows of a batch at once.

Null and empty texts have all-zero counts and get the score of such a document;
texts of any length are read whole; repeated rows are scored alike; of equally
good splits the first column and the lowest threshold are taken; an empty table gives an empty result; without
labelled rows every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: The most labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
MARKS = b"|#$%&*!@?.,;:<>{}/\\\"'-_=+~"
N_STATS = 22 + len(MARKS)

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARKS = np.frombuffer(MARKS, np.uint8)


def stats(text: str | None) -> np.ndarray:
    """Numbers that describe one whole text, none of which depends on its id, source or language tag."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATS)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size, words, lines = len(raw), raw.split(), raw.split(b"\n")
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    kept = [x for x in lines if x.strip()] or [b""]
    line_sizes = np.fromiter(map(len, kept), np.int64, len(kept))
    share = counts[counts > 0] / size
    marks = counts[_MARKS]
    out[:22] = (
        np.log1p(size),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        counts[_UPPER].sum() / size,
        counts[_LOWER].sum() / size,
        counts[_DIGIT].sum() / size,
        counts[_SPACE].sum() / size,
        counts[128:].sum() / size,
        len(distinct) / n,
        len(distinct) / np.sqrt(n),
        -(share * np.log2(share)).sum(),
        len(kept) / n,
        line_sizes.mean(),
        line_sizes.std() / (line_sizes.mean() + 1),
        len(set(kept)) / len(kept),
        sum(map(len, set(kept))) / max(line_sizes.sum(), 1),
        marks.max() / n,
        marks.sum() / n,
        counts[_UPPER].sum() / max(counts[_UPPER].sum() + counts[_LOWER].sum(), 1),
        (counts[46] + counts[33] + counts[63]) / n,
    )
    out[22:] = marks / n
    return out


@dataclass
class Forest:
    """Complete binary trees, one row each: node i's children are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows go down a tree's level together."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1)) if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 48, rate: float = 0.12, l2: float = 2.0, least: float = 3.0) -> Forest:
    """Newton boosting of the logistic loss; a node's best split comes from gradient histograms of binned columns."""
    n, width = x.shape if x.size else (0, N_STATS)
    inner, leaves = 2**depth - 1, 2**depth
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base if n else 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    offset = np.arange(width) * bins
    flat = (binned + offset).astype(np.int64)
    allowed = np.zeros((width, bins), bool)
    for j, e in enumerate(edges):
        allowed[j, : len(e)] = True
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * least:
                    continue
                keys = flat[rows].ravel()
                gs = np.bincount(keys, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(keys, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[~allowed | (hs < 1e-3) | (ha - hs < 1e-3)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    j, k = divmod(best, bins)
                    feature[node], threshold[node], cut[node] = j, edges[j][k], k
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """Trees from at most train_rows rows of `labels.quality` outside the held-out fold."""

    def measure(batches):
        for batch in batches:
            for part in runtime.small(batch):
                yield pa.record_batch([part["label"], pa.array([stats(t).tolist() for t in part["text"].to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    rows = runtime.labelled(docs, labels, "quality", 3, 1, train_rows).mapInArrow(measure, "label int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, N_STATS)
    y = np.array(rows["label"].to_pylist(), float).clip(0, 1)
    order = np.lexsort([*x.T, y])  # rows come in any order; sums must not depend on it
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x nodes numbers, whatever the input

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                x = np.stack([stats(t) for t in part["text"].to_pylist()])
                yield pa.record_batch([part["doc_id"], pa.array(shared.value.score(x))], ["doc_id", "score"])

    return runtime.id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    runtime.ship(docs.sparkSession)
    scored = score(docs, fit(docs, labels, train_rows))
    return scored.select("doc_id", runtime.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    runtime.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    if "text" not in docs.columns:
        raise ValueError("docs has no column text")

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                x = np.stack([stats(t) for t in part["text"].to_pylist()])
                yield part.filter(pa.array(shared.value.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels"))
