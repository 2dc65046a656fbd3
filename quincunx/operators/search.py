"""Nearest neighbours: exact, by probed clusters in two tiers, and by grid cells. Votes are always out of five.

Distances are exact integers of fixed-point components; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as c
from ..functions import columns as f

#: Centroids are broadcast: at most so many, of 14 longs each.
MOST_CENTROIDS = 65_536
#: A query set is broadcast up to so many rows.
BROADCAST_ROWS = 50_000
#: About how many rows of a cluster, and how many of its queries, one task holds at once.
PART_ROWS, PART_QUERIES = 262_144, 131_072
#: Comparisons that are made at once without leaves, and the most rows of a leaf and of one of queries.
SMALL, LEAF_ROWS, LEAF_QUERIES = 1_000_000, 256, 32
#: Cells of a grid by their last two parts, km and flags.
FLAGGED = 16 * 8
#: Above all squared distances (of 14 components up to 2e8 apart), and still a float of 32 bits.
FAR = 1e30


class Kept:
    """Frames held in memory, and on disk beyond it, until release()."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return df

    def release(self) -> None:
        for df in self.frames:
            df.unpersist()
        self.frames.clear()


def leaves(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x by leaf, each leaf's first place): halves along the widest dimension until none has more than `most` rows."""
    todo, order, starts = [np.arange(len(x))], [], []
    at = 0
    while todo:
        rows = todo.pop()
        if len(rows) > most:
            part = x[rows]
            wide = (part.max(0) - part.min(0)).argmax()
            half = np.argpartition(part[:, wide], len(rows) // 2)
            todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
            continue
        order.append(rows)
        starts.append(at)
        at += len(rows)
    return np.concatenate(order), np.array(starts)


def nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance) of each a's k nearest in order, ties to the earlier b; whole numbers, exact.

    A matrix product in floating point leaves all that its rounding cannot rule
    out among the k nearest; those are compared in whole numbers. Many rows are
    cut into leaves: one of a meets those of b from the nearest on, and none
    whose box lies beyond the k-th distance that each of its rows has by then.
    """
    if len(a) * len(b) <= SMALL or len(b) <= 4 * LEAF_ROWS:
        step = max(1, 2_000_000 // max(1, len(b)))
        found = [_nearest(a[at : at + step], b, k) for at in range(0, max(len(a), 1), step)]
        return np.concatenate([r + n * step for n, (r, _, _) in enumerate(found)]), *(np.concatenate(v) for v in list(zip(*found, strict=True))[1:])
    of_a, first_a = leaves(a, LEAF_QUERIES)
    of_b, first_b = leaves(b, LEAF_ROWS)
    sorted_b = b[of_b]
    low, high = (side.reduceat(sorted_b, first_b).astype(float) for side in (np.minimum, np.maximum))
    # Leaves in one block of equal sizes, each row with its square; what fills them up is farther than anything.
    place = np.arange(len(b)) - np.repeat(first_b, np.diff(first_b, append=len(b)))
    leaf = np.searchsorted(first_b, np.arange(len(b)), "right") - 1
    block = np.zeros((len(first_b), place.max() + 1, b.shape[1] + 1), np.float32)
    block[:, :, -1] = FAR
    block[leaf, place, :-1] = sorted_b
    block[leaf, place, -1] = (sorted_b.astype(float) ** 2).sum(1)
    reach = np.sqrt(block[leaf, place, -1].max())
    out = []
    for start, end in zip(first_a, np.append(first_a[1:], len(a)), strict=True):
        rows = of_a[start:end]
        whole = a[rows]
        x = whole.astype(float)
        xx = (x**2).sum(1)
        doubt = (np.sqrt(xx) + reach) ** 2 * 2.0**-18
        xs = np.column_stack([-2 * x, np.ones(len(x))]).astype(np.float32)
        apart = (np.maximum(np.maximum(low - x.max(0), x.min(0) - high), 0) ** 2).sum(1) * (1 - 2.0**-40)
        order = np.argsort(apart, kind="stable")
        worst = np.full(len(x), np.inf)
        row, col, dist = (np.empty(0, np.int64) for _ in range(3))
        at, step = 0, 2
        while at < len(order):
            some = order[at : at + step]
            some = some[apart[some] <= worst.max()]
            if not len(some):
                break
            at, step = at + step, min(step * 2, 32)
            if np.isfinite(worst).all():
                # A leaf that is near the rows' box may be too far from each row.
                gap = np.maximum(np.maximum(low[some][:, None] - x, x - high[some][:, None]), 0)
                some = some[(np.einsum("ijk,ijk->ij", gap, gap) * (1 - 2.0**-40) <= worst).any(1)]
                if not len(some):
                    continue
            about = xs @ block[some].reshape(-1, xs.shape[1]).T
            bound = worst - xx + doubt
            if not np.isfinite(worst).all() and about.shape[1] > k:
                bound = np.minimum(bound, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * doubt)
            hit = np.flatnonzero(about <= np.minimum(bound, FAR / 2)[:, None].astype(np.float32))
            r, j = np.divmod(hit, about.shape[1])
            j = first_b[some[j // block.shape[1]]] + j % block.shape[1]
            row, col = np.concatenate([row, r]), np.concatenate([col, of_b[j]])
            dist = np.concatenate([dist, ((whole[r] - sorted_b[j]) ** 2).sum(1)])
            best = np.lexsort((col, dist, row))
            row, col, dist = row[best], col[best], dist[best]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, dist, rank = (v[rank < k] for v in (row, col, dist, rank))
            last = rank == k - 1
            worst[row[last]] = dist[last]
        out.append((rows[row], col, dist))
    row, col, dist = (np.concatenate(v) for v in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], dist[order]


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest() by comparing all."""
    x, y = a.astype(float), b.astype(float)
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    about = x @ (-2 * y.T)
    about += xx[:, None]
    about += yy
    doubt = (np.sqrt(xx.max(initial=0)) + np.sqrt(yy.max(initial=0))) ** 2 * 2.0**-46
    most = np.partition(about, k - 1, axis=1)[:, k - 1 : k] if about.shape[1] > k else about.max(1, keepdims=True)
    row, col = np.nonzero(about <= most + 2 * doubt)
    dist = ((a[row] - b[col]) ** 2).sum(1)
    order = np.lexsort((col, dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], dist[keep]


def first_per(df: DataFrame, key: str, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key; Spark limits each partition before the exchange."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def against_all(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each of a stated query set with every row, as pairs: the smaller side is sent to all tasks only up to BROADCAST_ROWS, in blocks beyond."""
    blocks = max(1, -(-queries.count() // BROADCAST_ROWS))
    if blocks == 1:
        return rows.crossJoin(F.broadcast(queries))
    key = queries.columns[0]
    mine = queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    every = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return every.join(mine, "_block").drop("_block")


def exact(queries: DataFrame, refs: DataFrame, k: int = c.NEIGHBOURS, n: int = c.DIM) -> DataFrame:
    """qid, id, label, dist, rank by comparing every query (qid, q) with every reference (id, label, q): a stated query set against all rows.

    All are one cluster, cut into parts for all cores: pairs are never rows.
    """
    one = F.lit(0).alias("cid")
    return probe(queries, queries.select("qid", one), refs.select("id", "label", "q", one), False, k, n, 2 * refs.sparkSession.sparkContext.defaultParallelism)


def votes(queries: DataFrame, near: DataFrame, name: str = "votes") -> DataFrame:
    """qid and the labels' sum among its neighbours; a query without neighbours has 0."""
    return queries.select("qid").join(near.groupBy("qid").agg(F.sum("label").alias(name)), "qid", "left").select("qid", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def _table(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cids, components) on the driver, of at most MOST_CENTROIDS."""
    rows = centroids.select("cid", "c").orderBy("cid").limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError("too many centroids")
    return np.array([r["cid"] for r in rows], np.int32), np.array([r["c"] for r in rows], np.int64).reshape(-1, c.DIM)


def ranked_centroids(queries: DataFrame, centroids: DataFrame, most: int, fine: bool = True) -> DataFrame:
    """qid, cid, dist, rank of the nearest centroids (cid, c); fine: by h against scaled centroids, else by q.

    A batch of queries is compared with all centroids in whole numbers and sends
    on `most` rows a query: with thousands of centroids, pairs are never rows.
    """
    asked, times = ("h", c.FINE // c.SCALE) if fine else ("q", 1)
    cids, table = _table(centroids)
    table = table * times
    step = max(1, 2_000_000 // max(1, len(cids)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows if len(cids) else 0, step):
                part = batch.slice(at, step)
                x = part[asked].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, c.DIM)
                row, col, dist = nearest(x, table, most)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.record_batch([part["qid"].take(pa.array(row)), pa.array(cids[col]), pa.array(dist), pa.array(rank.astype(np.int32))], ["qid", "cid", "dist", "rank"])

    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("cid", T.IntegerType()), T.StructField("dist", T.LongType()), T.StructField("rank", T.IntegerType())])
    return queries.select("qid", asked).mapInArrow(run, schema)


def assign(points: DataFrame, centroids: DataFrame, q: str = "q") -> DataFrame:
    """points with cid and dist of the nearest centroid, ties to the lowest cid.

    Centroids (at most MOST_CENTROIDS) come to the driver and go to all tasks.
    A batch of points is compared with all of them by one matrix product, exact
    because fixed-point distances stay far below 2**53; the points are neither
    multiplied nor moved, which with thousands of centroids a join would do.
    """
    cids, table = _table(centroids)
    table = table.astype(float)
    norms = (table**2).sum(1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part[q].flatten().to_numpy(zero_copy_only=False), float).reshape(part.num_rows, -1)
                dist = (x**2).sum(1)[:, None] - 2 * (x @ table.T) + norms
                best = dist.argmin(1)
                yield pa.record_batch([*part.columns, pa.array(cids[best], pa.int32()), pa.array(dist[np.arange(len(x)), best].astype(np.int64))], [*part.schema.names, "cid", "dist"])

    schema = T.StructType([*points.schema.fields, T.StructField("cid", T.IntegerType()), T.StructField("dist", T.LongType())])
    return points.mapInArrow(run, schema)


def probe(queries: DataFrame, probes: DataFrame, postings: DataFrame, fine: bool, k: int = c.NEIGHBOURS, dim: int = c.DIM, least: int = 1) -> DataFrame:
    """Neighbours of queries (qid, h, q) among the postings (cid, id, label, q) of their probed clusters (qid, cid), by the first dim components.

    A cluster and the queries that ask for it are cut into parts of about
    PART_ROWS and PART_QUERIES rows, its postings into `least` parts at least, by
    hash and by counts (one row a cluster, at most MOST_CENTROIDS, broadcast). A task compares one part of each in Arrow
    batches and sends on k rows a query at most: pairs are never rows.
    """
    asked, times = ("h", c.FINE // c.SCALE) if fine else ("q", 1)
    spark = queries.sparkSession
    # The comparisons are the work, not the bytes: a set number of partitions keeps them from being coalesced.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = lambda x, most: F.ceil(x / most).cast("int")
    sizes = postings.groupBy("cid").agg(F.greatest(parts(F.count("*"), PART_ROWS), F.lit(least)).alias("rows"))
    sizes = F.broadcast(sizes.join(probes.groupBy("cid").agg(parts(F.count("*"), PART_QUERIES).alias("queries")), "cid"))
    of = lambda key, most: F.pmod(F.xxhash64(key), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    key = ["cid", "i", "j"]
    mine = probes.select("qid", "cid").join(queries.select("qid", F.col(asked).alias("asked")), "qid").join(sizes, "cid")
    mine = mine.withColumn("j", of("qid", "queries")).select("cid", every("rows").alias("i"), "j", "qid", "asked")
    listed = postings.select("cid", "id", "label", "q").join(sizes, "cid").withColumn("i", of("id", "rows")).select("cid", "i", every("queries").alias("j"), "id", "label", "q")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda column: column.combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(column), -1)[:, :dim]
        right = right.sort_by("id")
        who = which = far = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            who, which, far = nearest(matrix(left["asked"]), matrix(right["q"]) * times, k)
        who, which = pa.array(who), pa.array(which)
        return pa.table({"qid": left["qid"].take(who), "id": right["id"].take(which), "label": right["label"].take(which), "dist": pa.array(far)})

    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), *[T.StructField(x, postings.schema[x].dataType) for x in ("id", "label")], T.StructField("dist", T.LongType())])
    found = mine.repartition(n, *key).groupBy(*key).cogroup(listed.repartition(n, *key).groupBy(*key)).applyInArrow(compare, schema)
    return first_per(found, "qid", ["dist", "id"], k)


def check_probes(quick: int, expanded: int) -> tuple[int, int]:
    """Both within bounds: expanded from 1 to MOST_PROBES, quick from 1 to expanded."""
    expanded = min(max(expanded, 1), c.MOST_PROBES)
    return min(max(quick, 1), expanded), expanded


def two_tier(queries: DataFrame, centroids: DataFrame, postings: DataFrame, quick: int = c.QUICK_PROBES, expanded: int = c.EXPANDED_PROBES, kept: Kept | None = None) -> DataFrame:
    """qid, first, second, votes, path: two or three votes of the quick tier are asked again of more clusters, by the quantized query, and replaced.

    Queries are made and centroids ranked once, for both tiers. kept: holds what
    is read more than once, for the caller to release when the result is read.
    """
    kept = kept or Kept()
    quick, expanded = check_probes(quick, expanded)
    queries = kept(queries.select("qid", "q", "h"))
    ranked = kept(ranked_centroids(queries, centroids, expanded).select("qid", "cid", "rank"))
    first = kept(votes(queries, probe(queries, ranked.where(F.col("rank") <= quick), postings, True), "first"))
    unsure = first.where(F.col("first").isin(2, 3)).select("qid")
    again = queries.join(unsure, "qid", "left_semi")
    second = votes(again, probe(again, ranked.join(unsure, "qid", "left_semi"), postings, False), "second")
    both = first.join(second, "qid", "left")
    return both.select("qid", "first", "second", F.coalesce("second", "first").alias("votes"), F.when(F.col("second").isNull(), 0).otherwise(2).alias("path"))


def warm(centroids: DataFrame, postings: DataFrame, samples: int = 8, kept: Kept | None = None) -> DataFrame:
    """Reads all postings into memory, asks for up to `samples` centroids spread over all of them, and returns cid and votes of each."""
    kept = kept or Kept()
    postings = kept(postings)
    postings.count()
    n = centroids.count()
    step = max(1, n // samples)
    order = F.row_number().over(W.orderBy("cid")) - 1  # a row a centroid, of which there are at most MOST_CENTROIDS
    some = centroids.withColumn("at", order).where((F.col("at") % step == 0) & (F.col("at") < step * samples))
    asked = some.select(F.col("cid").alias("qid"), F.col("c").alias("q"), F.transform("c", lambda x: x * (c.FINE // c.SCALE)).alias("h"))
    return two_tier(asked, centroids, postings, kept=kept).select(F.col("qid").alias("cid"), "votes")


def checksum(listed: DataFrame, stride: int = 128) -> DataFrame:
    """One number a cluster over every stride-th posting (cid, pos, id, q): cheap, and different where a file is not the one written."""
    some = listed.where(F.col("pos") % stride == 0)
    total = F.aggregate("q", F.lit(0).cast("long"), lambda x, y: x + y)
    return some.groupBy("cid").agg(F.count("*").alias("pages"), F.sum(total).alias("checksum"))


def coarse(queries: DataFrame) -> DataFrame:
    """qid, q, fine, cell, phase: a query's own cell in its first three parts, and the km and flags of the cells that may hold neighbours.

    Phase 0: adjacent km under its own flags; phase 1: its own km under the other flags.
    """
    a, r, last, km, flags = (F.col(x) for x in ("a", "r", "t", "k", "g"))
    parts = queries.select("qid", "q", *[p.alias(x) for p, x in zip(f.grid_parts(F.col("q")), "artkg", strict=True)])
    near = F.sequence(F.greatest(km - 1, F.lit(0)), F.least(km + 1, F.lit(15)))
    other = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda g: g != flags)
    at = lambda cell, phase: F.struct((cell % FLAGGED).cast("int").alias("cell"), F.lit(phase).alias("phase"))
    both = F.concat(F.transform(near, lambda w: at(f.grid_key(a, r, last, w, flags), 0)), F.transform(other, lambda g: at(f.grid_key(a, r, last, km, g), 1)))
    return parts.select("qid", "q", F.floor(f.grid_key(a, r, last, km, flags) / FLAGGED).cast("int").alias("fine"), F.explode(both).alias("at")).select("qid", "q", "fine", "at.cell", "at.phase")


def adjacent(fine: int) -> list[int]:
    """The first three parts, as one number, of cells next to this one and of itself: a vector without a last transaction is next to none with one."""
    a, r, last = fine // 72, fine // 9 % 8, fine % 9
    near = lambda x, top: range(max(x - 1, 0), min(x + 1, top) + 1)
    return [(x * 8 + y) * 9 + z for x in near(a, 15) for y in near(r, 7) for z in (near(last, 8) if last else [0])]


def grid(queries: DataFrame, postings: DataFrame, k: int = c.NEIGHBOURS) -> DataFrame:
    """Neighbours by cells: adjacent ones, and only if they hold fewer than k rows also those of other flags. postings: bucket, id, label, q.

    Cells of equal km and flags meet in a task, in parts as in probe(); there a
    query is compared with its cells' rows and sends on k at most of each phase.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    k, spark = min(k, c.NEIGHBOURS), queries.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked, listed = coarse(queries), postings.select((F.col("bucket") % FLAGGED).cast("int").alias("cell"), F.col("bucket").cast("long").alias("bucket"), "id", "label", "q")
    parts = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = F.broadcast(parts(listed, PART_ROWS, "rows").join(parts(asked, PART_QUERIES, "queries"), "cell"))
    of = lambda key, most: F.pmod(F.xxhash64(key), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    key = ["cell", "i", "j"]
    mine = asked.join(sizes, "cell").withColumn("j", of("qid", "queries")).select("cell", every("rows").alias("i"), "j", "qid", "fine", "phase", F.col("q").alias("asked"))
    theirs = listed.join(sizes, "cell").withColumn("i", of("id", "rows")).select("cell", "i", every("queries").alias("j"), "bucket", "id", "label", "q")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda column: column.combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(column), -1)
        who = which = far = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            # In order of bucket and id, which is that of equal distances.
            right = right.sort_by([("bucket", "ascending"), ("id", "ascending")])
            a, p, fine = matrix(left["asked"]), matrix(right["q"]), right["bucket"].to_numpy() // FLAGGED
            own = left["fine"].to_numpy().astype(np.int64) * 2 + left["phase"].to_numpy()
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            found = []
            for some in np.split(order, starts[1:]):
                cell, phase = divmod(int(own[some[0]]), 2)
                cells = np.array([cell] if phase else adjacent(cell))
                begin, end = np.searchsorted(fine, cells), np.searchsorted(fine, cells, "right")
                places = np.concatenate([np.arange(x, y) for x, y in zip(begin, end, strict=True)])
                if len(places):
                    row, col, dist = nearest(a[some], p[places], k)
                    found.append((some[row], places[col], dist))
            if found:
                who, which, far = (np.concatenate(v) for v in zip(*found, strict=True))
        who, which = pa.array(who), pa.array(which)
        return pa.table({"qid": left["qid"].take(who), "phase": left["phase"].take(who), **{x: right[x].take(which) for x in ("id", "label", "bucket")}, "dist": pa.array(far)})

    kinds = [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("phase", T.IntegerType()), *[T.StructField(x, postings.schema[x].dataType) for x in ("id", "label")]]
    schema = T.StructType([*kinds, T.StructField("bucket", T.LongType()), T.StructField("dist", T.LongType())])
    found = mine.repartition(n, *key).groupBy(*key).cogroup(theirs.repartition(n, *key).groupBy(*key)).applyInArrow(compare, schema)
    # Each phase by itself keeps k rows at most, so that the count of the main one needs no pass of its own.
    some = found.withColumn("n", F.row_number().over(W.partitionBy("qid", "phase").orderBy("dist", "bucket", "id"))).where(F.col("n") <= k)
    some = some.withColumn("main", F.sum(F.when(F.col("phase") == 0, 1).otherwise(0)).over(W.partitionBy("qid")))
    return first_per(some.where((F.col("phase") == 0) | (F.col("main") < k)), "qid", ["dist", "phase", "bucket", "id"], k)
