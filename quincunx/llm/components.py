"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, packed

#: So many edges, at most (16 bytes each), are joined on the driver: steps over so few cost nothing but their scheduling.
FEW_EDGES = 1 << 18


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its set, by pointers) after joining a with b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def joined(edges: pa.Table) -> pa.Table:
    """node, root of a small edge list (a, b)."""
    ends = np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()])
    nodes, at = np.unique(ends, return_inverse=True)
    label = unite(np.arange(len(nodes)), at[: len(edges)], at[len(edges) :])
    return pa.table({"node": nodes, "root": nodes[label]})


def components(edges: DataFrame, work: Workspace, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b: longs); root is the component's smallest node.

    Alternates large-star and small-star steps until the edges are stars: no
    node is tied twice, and none that others are tied to is tied itself. A
    node's least neighbour is aggregated, with partial sums before the exchange,
    and written; the join that brings it back then has a plain exchange on
    either side, so that a node with very many neighbours is split as any skewed
    join is. Only one number a step comes to the driver; a list of at most
    FEW_EDGES comes there whole instead. Loops, repeats and rows with a null are
    ignored; an empty list has no components. edges is evaluated once; rows: about
    how many there are, for the files of the list.
    """

    def stars(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre"))
        ends = ends.union(df.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre"))
        return ends.where("tied > 1 or tied = 1 and centre = 1").count() == 0

    def least(df: DataFrame, step: str) -> DataFrame:
        """u, m: each node's least neighbour, or itself."""
        return work.put(df.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), step)

    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")
    at = ordered.where("a > b").distinct()
    at = work.put(at if rows is None else packed(at, rows), f"{name}-0")
    if at.count() <= FEW_EDGES:
        return work.put(work.spark.createDataFrame(joined(at.toArrow()), "node long, root long"), f"{name}-joined")
    k = 0
    while not stars(at):
        k += 1
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both, f"{name}-low")
        large = both.join(low, both.a == low.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = work.put(large.where("a > b").distinct(), f"{name}-large")
        low = least(large, f"{name}-low-2")
        small = large.join(low, large.a == low.u).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        at = work.put(small.where("a > b").distinct(), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}", f"{name}-low", f"{name}-large", f"{name}-low-2")
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
