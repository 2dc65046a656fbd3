"""SimHash near-duplicates by BK-trees.

A document's fingerprint is the bitwise majority of the hashes of its word
shingles. Distinct fingerprints are dealt into shards in which every pair
within the radius meets: of `blocks` bit blocks, at most `radius` can differ, so
some choice of blocks - radius blocks agrees. Each shard's fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent), kept
as arrays; all queries of a batch descend together and follow only the edges
within the radius. A shard above SHARD members is cut into trees of that bound,
each sent to every block of the shard's queries. Trees are sent to the tasks
that query them, and not to all executors, as their total grows with the corpus.

Links within a shard are reduced to a spanning forest before they leave the
task; distributed union-find joins the forests.

Null and empty texts, and those of blanks only, have fingerprint zero and link
as any other; texts of any length are read whole; a bit set in exactly half the
hashes is zero. Only doc_id and text are read, and one_of_each() carries all
other columns along, whatever their names. A null id has a fingerprint and the component of its rows with
ids, or a null one if there are none. Repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .components import components, unite

#: The most members of a tree, about.
SHARD = 1 << 15
#: Fingerprints that may share a choice of blocks by chance, on average; above it, more and longer choices are used.
CHANCE = 256


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    else:
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]  # noqa: B905  fewer ends
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255 * 128):  # sums of bytes first, then of their sums
        part = bits[at : at + 255 * 128]
        for k in range(0, len(part), 255):
            ones += part[k : k + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and print (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                found = np.array([fingerprint(t, words, seed) for t in part["text"].to_pylist()], np.uint64)
                yield pa.record_batch([part["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "print"])

    return runtime.id_and_text(docs).mapInArrow(run, "doc_id long, print long")


def choices(n: int, radius: int, bits: int = 64) -> list[int]:
    """Masks of which at least one agrees on any two fingerprints within the radius; longer ones for more fingerprints."""
    for blocks in range(radius + 1, bits):
        edges = [round(bits * k / blocks) for k in range(blocks + 1)]
        if n / 2 ** min(sum(sorted(b - a for a, b in zip(edges, edges[1:], strict=False))[: blocks - radius]), 62) <= CHANCE or blocks == radius + 5:
            parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
            return [sum(c) for c in combinations(parts, blocks - radius)]
    raise ValueError("radius too large")


class Trees:
    """BK-trees of many groups at once. group: any ids, equal ones adjacent; prints: unsigned 64-bit."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        n = len(prints)
        self.prints = prints
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        self.root_of = dict(zip(group[first].tolist(), first.tolist(), strict=True))
        at = np.repeat(first, np.diff(np.append(first, n)))  # where each waiting member stands
        waiting = np.flatnonzero(at != np.arange(n))
        parents, distances, children = [], [], []
        while len(waiting):
            # Of those that stand at a node with the same distance to it, the first becomes its child; the rest go on to that child.
            d = np.bitwise_count(prints[waiting] ^ prints[at[waiting]]).astype(np.int64)
            slot = at[waiting] * 65 + d
            _, lead, same = np.unique(slot, return_index=True, return_inverse=True)
            chosen = waiting[lead]
            parents.append(at[chosen])
            distances.append(d[lead])
            children.append(chosen)
            at[waiting] = chosen[same]
            waiting = waiting[at[waiting] != waiting]
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        distance = np.concatenate(distances) if parents else parent
        order = np.lexsort((distance, parent))
        self.child = (np.concatenate(children) if parents else parent)[order]
        self.slot = parent[order] * 65 + distance[order]

    def within(self, root: np.ndarray, prints: np.ndarray, radius: int):
        """(query, member) pairs of indexes within the radius, for queries that start at the given roots."""
        query, node = np.arange(len(prints)), root
        found = [], []
        while len(query):
            d = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            found[0].append(query[near])
            found[1].append(node[near])
            low = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), "right") - low
            total = int(count.sum())
            edge = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            query, node = np.repeat(query, count), self.child[edge]
        return (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def forest(group: np.ndarray, member: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each group. Rows are sorted by group, members first; others only query."""
    rows = np.flatnonzero(member)
    trees = Trees(group[rows], prints[rows])
    roots = np.array([trees.root_of.get(g, -1) for g in group.tolist()], np.int64)
    label = np.arange(len(prints))
    sizes = np.unique(group, return_counts=True)[1] if len(group) else np.zeros(0, np.int64)
    step = max(64, 2_000_000 // max(1, int(sizes.max(initial=1))))
    asking = np.flatnonzero(roots >= 0)
    for at in range(0, len(asking), step):
        part = asking[at : at + step]
        q, m = trees.within(roots[part], prints[part], radius)
        label = unite(label, part[q], rows[m])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked], prints[label[linked]]


def links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all that are linked; n: how many there are, about."""
    masks = choices(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("print", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 2 * SHARD).withColumn("cuts", F.ceil(F.col("size") / SHARD).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int")
    dealt = (
        keyed.join(sizes.select("key", "cuts"), "key", "left")
        .withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        .withColumn("own", own)
        # (tree, block of queries): as a member to its tree's row of the grid, as a query to its block's column.
        .withColumn("cell", F.explode(F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("b"), F.lit(True).alias("m")))).otherwise(F.concat(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.col("own").alias("t"), x.alias("b"), F.lit(True).alias("m"))), F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(x.alias("t"), F.col("own").alias("b"), F.lit(False).alias("m")))))))
        .select(F.xxhash64("key", "cell.t", "cell.b").alias("shard"), F.col("cell.m").alias("member"), "print")
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("member").desc(), "print")
    )

    def run(batches):
        held: list[np.ndarray] = []

        def work(rows):
            a, b = forest(rows[0], rows[1].astype(bool), rows[2].view(np.uint64), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch["shard"].to_numpy(), batch["member"].to_numpy(zero_copy_only=False).astype(np.int64), batch["print"].to_numpy()])
            held.append(rows)
            if sum(x.shape[1] for x in held) >= 50_000:
                rows = np.concatenate(held, 1)
                last = int(np.searchsorted(rows[0], rows[0, -1]))  # the last shard may go on
                if last:
                    yield work(np.ascontiguousarray(rows[:, :last]))
                held = [rows[:, last:]]
        if held:
            yield work(np.ascontiguousarray(np.concatenate(held, 1)))

    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, work: runtime.Workspace, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, print and component_id (the smallest doc_id reachable over links) of every row."""
    prints = work.put(fingerprints(docs, words, seed), "prints")
    distinct = work.put(runtime.packed(prints.groupBy("print").agg(F.min("doc_id").alias("low")), prints.count()), "distinct")
    n = distinct.count()
    found = work.put(components(links(distinct.select("print"), n, radius), work, rows=n), "found")
    # What is joined to many rows of a fingerprint or a component is written first, so that such a join can be split.
    joined = distinct.join(found, distinct.print == found.node)
    lowest = work.put(runtime.packed(joined.groupBy("root").agg(F.min("low").alias("component_id")), n), "lowest")
    named = found.join(lowest, "root").select(F.col("node").alias("p"), "component_id")
    low = distinct.join(named, distinct.print == named.p, "left").select(F.col("print").alias("q"), F.coalesce("component_id", "low").alias("component_id"))
    low = work.put(runtime.packed(low, n), "low")
    work.drop("distinct", "found", "lowest")
    return prints.join(low, prints.print == low.q).select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, words: int = 5) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is their component's. Rows that share an id stay or go together; rows without one stay.

    Shingles have five words here, as near-duplicate stages take; four bits find
    the nearest copies only (the README has the share of those of 0.8).
    """
    work = runtime.Workspace(docs.sparkSession)
    gone = classes(docs, work, radius, words).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(runtime.table(spark, sf_dir, "documents"), runtime.Workspace(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
