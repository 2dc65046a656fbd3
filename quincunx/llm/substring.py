"""Substring dedup by a log-structured fingerprint index.

A window is WINDOW consecutive words of a document. Its fingerprint is the least
hash of the GRAM-word sequences in it, so that equal windows have equal
fingerprints and neighbours mostly share theirs. Documents are kept in segments
of about SEGMENT bytes. The segments' distinct fingerprints enter the index in
batches: a batch, sorted by hash within each bucket of the hash space, is
merge-joined with every sorted immutable run of history; whatever is met in two
segments or more is told to those segments; the batch then becomes a run, and
runs are compacted once there are more than RUNS. Verification takes from each
segment the windows whose fingerprint it was told of (or has in two documents),
and joins 96-bit digests of their whole word sequences: of each digest the
smallest doc_id, which decides.

What one segment, or one bucket of one run, sends about a fingerprint or digest
is a single entry, however many of its documents share it, so that passages in a
large part of all documents do not gather in one task.

History is an index that outlives a call: a folder with the segments' texts, the
runs, the digests met so far, and a manifest that names what holds. Each add()
looks at a new batch of documents against all of history and commits it.

Null texts have no words. Documents without an id can neither lose words nor
take them from others. Rows that share an id lose only what also starts under a
smaller one. Texts under WINDOW words lose nothing; texts of any length are read
whole, and one above SEGMENT bytes is a segment by itself. An empty table gives
an empty result. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

WINDOW, GRAM, SEGMENT, BATCHES, RUNS = 13, 5, 4 << 20, 4, 2
#: Numbers of segments that a generation has.
GENERATION = 10**12
#: In a run, the segment of a fingerprint that several segments have.
MANY = -1


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, equal places of its numbers together."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Segment:
    """Some documents' words; word k of document d is number first[d] + k."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.flat = [w for words in self.words for w in words]

    def fingerprints(self, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every window."""
        digest = xxhash.xxh3_64_intdigest
        h = np.fromiter(map(digest, self.flat), np.uint64, len(self.flat))
        n = len(h) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g = np.zeros(len(h) - gram + 1, np.uint64)
        for k in range(gram):
            g += h[k : k + len(g)] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
        low, width, reach = g, 1, window - gram + 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[reach - width : reach - width + n])
        inside = np.zeros(len(self.flat) + 1, np.int64)
        at = self.first[:-1]
        long = self.counts >= window
        inside[at[long]] += 1
        inside[(at + self.counts - window + 1)[long]] -= 1
        starts = np.flatnonzero(inside.cumsum()[:n] > 0)
        return starts, low[starts]

    def digests(self, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """96-bit digests (high: unsigned 64-bit, low: unsigned 32-bit) of the windows' words joined by blanks."""
        line = b" ".join(self.flat)
        ends = np.cumsum(np.fromiter(map(len, self.flat), np.int64, len(self.flat)) + 1) - 1
        begin = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(line[a:b])[:12] for a, b in zip(begin[starts].tolist(), ends[starts + window - 1].tolist(), strict=True)])
        return np.frombuffer(raw, DIGEST)


DIGEST = np.dtype([("high", "<u8"), ("low", "<u4")])


def spread(values: np.ndarray, bucket: np.ndarray, n: int):
    """(bucket, its values) for values in order within each bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(cut[:-1] < cut[1:]).tolist():
        yield k, order[cut[k] : cut[k + 1]]


class Index:
    """Sorted immutable runs of fingerprint hashes, by bucket, in written tables."""

    SCHEMA = "bucket int, run int, segment long, hashes binary, segments binary"

    def __init__(self, work: runtime.Workspace, n_buckets: int, most_runs: int = RUNS, runs: list[str] | None = None, made: int = 0):
        self.work, self.n_buckets, self.most_runs = work, n_buckets, most_runs
        self.runs, self.made = list(runs or []), made

    def add(self, batch: DataFrame) -> DataFrame:
        """Merges a batch (bucket, segment, hashes) into the index: segment and hashes that it has in common with others, told once each."""
        compact = len(self.runs) >= self.most_runs

        def merge(batches):
            for bucket, (runs, segments, hashes, owners) in runtime.by_key(batches, "bucket", ["run", "segment", "hashes", "segments"]):
                told_h, told_s = [], []
                new = [(unpack(h, "<u8"), s) for r, s, h in zip(runs, segments, hashes, strict=True) if r < 0]
                old = [(unpack(h, "<u8"), unpack(o, "<i8")) for r, h, o in zip(runs, hashes, owners, strict=True) if r >= 0]
                h = np.concatenate([x for x, _ in new] or [np.zeros(0, np.uint64)])
                s = np.concatenate([np.full(len(x), o, np.int64) for x, o in new] or [np.zeros(0, np.int64)])
                order = np.lexsort((s, h))
                h, s = h[order], s[order]
                begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.append(begins, len(h)))
                keys, many = h[begins], size > 1
                for run_h, run_s in old:  # both are sorted: a merge by positions
                    at = np.searchsorted(run_h, keys)
                    at[at == len(run_h)] = 0
                    met = run_h[at] == keys if len(run_h) else np.zeros(len(keys), bool)
                    owner = run_s[at[met]]
                    many |= met
                    alone = owner != MANY
                    told_h.append(keys[met][alone])
                    told_s.append(owner[alone])
                shared = np.repeat(many, size)
                told_h.append(h[shared])
                told_s.append(s[shared])
                own = np.where(many, MANY, s[begins])
                if compact:
                    everything = np.concatenate([keys, *(x for x, _ in old)])
                    owner = np.concatenate([own, *(x for _, x in old)])
                    order = np.lexsort((owner, everything))  # MANY comes first
                    everything, owner = everything[order], owner[order]
                    first = np.concatenate([[True], everything[1:] != everything[:-1]]) if len(everything) else np.zeros(0, bool)
                    keys, own = everything[first], owner[first]
                th, ts = np.concatenate(told_h), np.concatenate(told_s)
                order = np.lexsort((th, ts))
                th, ts = th[order], ts[order]
                fresh = np.concatenate([[True], (th[1:] != th[:-1]) | (ts[1:] != ts[:-1])]) if len(th) else np.zeros(0, bool)
                th, ts = th[fresh], ts[fresh]
                names, begins = np.unique(ts, return_index=True)
                told = [(int(n), pack(x)) for n, x in zip(names, np.split(th, begins[1:]), strict=True)] if len(th) else []
                m = len(told)
                yield pa.record_batch(
                    [pa.array([bucket] * (m + 1), pa.int32()), pa.array([0] + [-1] * m, pa.int32()), pa.array([None, *(n for n, _ in told)], pa.int64()), pa.array([pack(keys), *(x for _, x in told)], pa.binary()), pa.array([pack(own)] + [None] * m, pa.binary())],
                    ["bucket", "run", "segment", "hashes", "segments"],
                )

        rows = batch.select("bucket", F.lit(-1).alias("run"), "segment", "hashes", F.lit(None).cast("binary").alias("segments"))
        for k, name in enumerate(self.runs):
            rows = rows.union(self.work.get(name).where("run = 0").select("bucket", F.lit(k).alias("run"), "segment", "hashes", "segments"))
        name = f"run-{self.made}"
        self.made += 1
        done = self.work.put(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, self.SCHEMA), name)
        self.runs = [name] if compact else [*self.runs, name]
        return done.where("run = -1").select("segment", "hashes")


SEGMENTS = "is_text boolean, batch int, segment long, bucket int, body binary, sizes binary, ids array<long>"


def segments(docs: DataFrame, work: runtime.Workspace, n_buckets: int, batches: int = BATCHES, generation: int = 0) -> DataFrame:
    """Writes the segments: rows of texts (is_text), and rows of fingerprints by bucket. Those of a later generation have larger numbers."""
    n_parts = max(1, docs.rdd.getNumPartitions())

    def run(rows):
        import zstandard
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(3)
        ids: list = []
        texts: list[bytes] = []

        def close():
            nonlocal made
            segment = generation * GENERATION + part * 1_000_000 + made
            made += 1
            known = [t if d is not None else b"" for d, t in zip(ids, texts, strict=True)]
            h = np.unique(Segment(known).fingerprints()[1])
            bucket = (h >> np.uint64(24)) % np.uint64(n_buckets)
            took = [(k, pack(h[at])) for k, at in spread(h, bucket, n_buckets)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            n = len(took)
            return pa.record_batch(
                [
                    pa.array([True] + [False] * n),
                    pa.array([part * batches // n_parts] * (n + 1), pa.int32()),
                    pa.array([segment] * (n + 1), pa.int64()),
                    pa.array([None, *(k for k, _ in took)], pa.int32()),
                    pa.array([packer.compress(b"".join(texts)), *(x for _, x in took)], pa.binary()),
                    pa.array([pack(sizes)] + [None] * n, pa.binary()),
                    pa.array([ids] + [None] * n, pa.list_(pa.int64())),
                ],
                ["is_text", "batch", "segment", "bucket", "body", "sizes", "ids"],
            )

        size = 0
        for batch in rows:
            for piece in runtime.small(batch):
                for d, t in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    ids.append(d)
                    texts.append((t or "").encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                    if size >= SEGMENT or len(ids) >= 100_000:
                        yield close()
                        ids, texts, size = [], [], 0
        if ids:
            yield close()

    return work.put(runtime.id_and_text(docs).mapInArrow(run, SEGMENTS), f"segments-{generation}", ("is_text", "batch"))


def _read(body: bytes, sizes: bytes) -> list[bytes]:
    import zstandard

    ends = np.cumsum(unpack(sizes, "<i8"))
    raw = zstandard.ZstdDecompressor().decompress(body)
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _candidates(segment: Segment, ids: list, told: np.ndarray):
    """(first word, document) of windows whose fingerprint other segments or two documents here have."""
    starts, prints = segment.fingerprints()
    doc = np.searchsorted(segment.first, starts, "right") - 1
    known = np.array([d is not None for d in ids], bool)
    kept = known[doc]
    starts, prints, doc = starts[kept], prints[kept], doc[kept]
    order = np.lexsort((doc, prints))
    p, d = prints[order], doc[order]
    twice = np.zeros(len(p), bool)
    if len(p):
        begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        ends = np.append(begins[1:], len(p))
        twice = np.repeat(d[begins] != d[ends - 1], ends - begins)
    local = np.zeros(len(p), bool)
    local[order] = twice
    told = np.sort(told)
    at = np.searchsorted(told, prints)
    at[at == len(told)] = 0
    wanted = local | (told[at] == prints if len(told) else False)
    return starts[wanted], doc[wanted]


def _lowest(digests: np.ndarray, doc_ids: np.ndarray):
    """Distinct digests, sorted, and each one's smallest id."""
    order = np.lexsort((doc_ids, digests["low"], digests["high"]))
    x, d = digests[order], doc_ids[order]
    first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    return x[first], d[first]


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deduplicate(docs: DataFrame, work: runtime.Workspace, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with_text adds kept: the kept words joined by blanks."""
    n_buckets = 8 * max(1, docs.rdd.getNumPartitions())
    index = Index(work, n_buckets)
    stored = segments(docs, work, n_buckets, batches)
    told = _told(stored, index, work, batches)
    work.drop("segments-0/is_text=false", *[f"run-{k}" for k in range(index.made)])
    work.release()
    return _decided(stored.where("is_text"), told, work, n_buckets, with_text)


def _told(stored: DataFrame, index: Index, work: runtime.Workspace, batches: int, generation: int = 0) -> DataFrame:
    """Takes the stored batches into the index, one after the other: what segments are told (segment, hashes)."""
    told = None
    for k in range(batches):
        new = index.add(stored.where(~F.col("is_text") & (F.col("batch") == k)).select("bucket", "segment", F.col("body").alias("hashes")))
        told = new if told is None else told.union(new)
    return work.put(told, f"told-{generation}")


def _decided(texts: DataFrame, told: DataFrame, work: runtime.Workspace, n_buckets: int, with_text: bool, generation: int = 0, before: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The result for a generation's segments. before: older segments of which some are told; seen: the digests that earlier generations met.

    With seen, what is met now is written for the next generation.
    """
    least_segment = generation * GENERATION
    texts = texts.select("segment", "body", "sizes", "ids")
    looked = texts if before is None else texts.union(before.where("is_text").select("segment", "body", "sizes", "ids").join(told.select("segment").distinct(), "segment", "left_semi"))

    def beside(rows: DataFrame, texts: DataFrame) -> DataFrame:
        """Segments with what is told to them right before them: rows of segment, kind (below 1), hashes."""
        none = [F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("array<long>").alias("ids")]
        asked = rows.select("segment", "kind", F.col("hashes").alias("body"), *none)
        every = asked.union(texts.select("segment", F.lit(1).alias("kind"), "body", "sizes", "ids"))
        return every.repartition("segment").sortWithinPartitions("segment", "kind")

    columns = ["kind", "body", "sizes", "ids"]

    def windows(rows):
        for segment, (kinds, bodies, sizes, ids) in runtime.by_key(rows, "segment", columns):
            ids = ids[-1]
            told = np.concatenate([np.zeros(0, np.uint64), *(unpack(b, "<u8") for k, b in zip(kinds, bodies, strict=True) if k == 0)])
            part = Segment(_read(bodies[-1], sizes[-1]))
            starts, doc = _candidates(part, ids, told)
            x, d = _lowest(part.digests(starts), np.array([i if i is not None else 0 for i in ids], np.int64)[doc])
            bucket = (x["high"] >> np.uint64(24)) % np.uint64(n_buckets)
            took = [(k, x[at].tobytes(), pack(d[at])) for k, at in spread(x, bucket, n_buckets)]
            yield pa.record_batch([pa.array([t[0] for t in took], pa.int32()), pa.array([segment] * len(took), pa.int64()), pa.array([t[1] for t in took], pa.binary()), pa.array([t[2] for t in took], pa.binary())], ["bucket", "segment", "digests", "lowest"])

    def decide(rows):
        for _, (names, digests, lowest) in runtime.by_key(rows, "bucket", ["segment", "digests", "lowest"]):
            x = np.frombuffer(b"".join(digests), DIGEST)
            d = np.concatenate([unpack(b, "<i8") for b in lowest])
            s = np.repeat(np.array(names, np.int64), [len(b) // DIGEST.itemsize for b in digests])
            order = np.lexsort((d, x["low"], x["high"]))
            x, d, s = x[order], d[order], s[order]
            begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            least = np.repeat(d[begins], np.diff(np.append(begins, len(x))))
            later = (d > least) & (s >= least_segment)
            x, s = x[later], s[later]
            order = np.argsort(s, kind="stable")
            x, s = x[order], s[order]
            names, begins = np.unique(s, return_index=True)
            parts = np.split(x, begins[1:]) if len(x) else []
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "hashes"])

    asked = told.select("segment", F.lit(0).alias("kind"), "hashes")
    met = beside(asked, looked).mapInArrow(windows, "bucket int, segment long, digests binary, lowest binary")
    if seen is not None:
        met = work.put(met, f"met-{generation}").union(seen.select("bucket", F.lit(MANY).cast("long").alias("segment"), "digests", "lowest"))
    earlier = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decide, "segment long, hashes binary")
    earlier = work.put(earlier, f"earlier-{generation}")
    work.release()

    def finish(rows):
        # A segment's fingerprints are told again, so that the same windows are looked at; what starts earlier elsewhere comes as digests.
        for _, (kinds, bodies, sizes, ids) in runtime.by_key(rows, "segment", columns):
            ids = ids[-1]
            told = np.concatenate([np.zeros(0, np.uint64), *(unpack(b, "<u8") for k, b in zip(kinds, bodies, strict=True) if k == 0)])
            gone = np.frombuffer(b"".join([b for k, b in zip(kinds, bodies, strict=True) if k == -1]), DIGEST)
            part = Segment(_read(bodies[-1], sizes[-1]))
            starts, doc = _candidates(part, ids, told)
            own = np.array([i if i is not None else 0 for i in ids], np.int64)[doc]
            digests = part.digests(starts)
            x, d = _lowest(digests, own)
            least = np.where(_among(x, gone), np.iinfo(np.int64).min, d)
            order = np.lexsort((digests["low"], digests["high"]))
            number = np.zeros(len(digests), np.int64)
            if len(digests):
                s = digests[order]
                number[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            cut = starts[least[number] < own]
            covered = np.zeros(len(part.flat) + WINDOW + 1, np.int64)
            np.add.at(covered, cut, 1)
            np.add.at(covered, cut + WINDOW, -1)
            covered = covered.cumsum()[: len(part.flat)] > 0
            removed = np.concatenate([[0], covered.cumsum()])
            n_removed = removed[part.first[1:]] - removed[part.first[:-1]]
            kept = []
            for k, words in enumerate(part.words):
                if n_removed[k]:
                    words = [w for w, c in zip(words, covered[part.first[k] : part.first[k + 1]].tolist(), strict=True) if not c]
                kept.append(b" ".join(words))
            out = [pa.array(ids, pa.int64()), pa.array(part.counts), pa.array(n_removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if with_text:
                out.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
            yield pa.record_batch(out, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    first = earlier.select("segment", F.lit(-1).alias("kind"), "hashes")
    again = asked.where(F.col("segment") >= least_segment)
    return beside(first.union(again), texts).mapInArrow(finish, SCHEMA + ", kept string" * with_text)


def _among(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of these distinct digests are among others, too; whole digests are compared."""
    both = np.concatenate([x, others])
    order = np.lexsort((both["low"], both["high"]))
    same = both[order[1:]] == both[order[:-1]]
    hit = np.zeros(len(both), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit[: len(x)]


class History:
    """An index in a folder that later calls, and later sessions, open again.

    path: a folder that all executors share. The manifest's last version names
    the tables that hold; a call that fails before it commits leaves history as
    it was, and what it wrote is written over by the next. One writer at a time.
    """

    SEEN = "bucket int, digests binary, lowest binary"
    MANIFEST = "n_buckets int, made int, runs array<string>, seen array<string>, texts array<string>, generation int"

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64):
        from pyspark.errors import AnalysisException

        self.spark, self.work = spark, runtime.Workspace(spark, path)
        self.n_buckets, self.made, self.runs, self.seen, self.texts, self.generation = n_buckets, 0, [], [], [], 0
        try:
            last = spark.read.schema(f"{self.MANIFEST}, version int").parquet(f"{self.work.top}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last:
            self.n_buckets, self.made, self.generation = last["n_buckets"], last["made"], last["generation"]
            self.runs, self.seen, self.texts = list(last["runs"]), list(last["seen"]), list(last["texts"])

    def _commit(self) -> None:
        row = [(self.n_buckets, self.made, self.runs, self.seen, self.texts, self.generation)]
        self.work.put(self.spark.createDataFrame(row, self.MANIFEST).coalesce(1), f"manifest/version={self.generation}")

    def _tables(self, names: list[str], schema: str | None = None) -> DataFrame | None:
        out = None
        for name in names:
            table = self.work.get(name, schema)
            out = table if out is None else out.unionByName(table)
        return out

    def add(self, docs: DataFrame, batches: int = 1, with_text: bool = False) -> DataFrame:
        """What deduplicate() gives for docs, with all documents added before taken into account, which themselves stay as they were.

        With ids above all earlier ones, calls over parts equal one call over
        all. The result can be read until the next add() or compact().
        """
        g, work = self.generation, self.work
        index = Index(work, self.n_buckets, runs=self.runs, made=self.made)
        stored = segments(docs, work, self.n_buckets, batches, g)
        told = _told(stored, index, work, batches, g)
        seen = self._tables(self.seen, self.SEEN)
        if seen is None:
            seen = self.spark.createDataFrame([], self.SEEN)
        out = _decided(stored.where("is_text"), told, work, self.n_buckets, with_text, g, self._tables(self.texts, SEGMENTS), seen)
        old = [*set(self.runs).difference(index.runs), *(f"{x}-{g - 1}" for x in ("told", "earlier"))]
        unlisted = [f"run-{k}" for k in range(self.made, index.made) if f"run-{k}" not in index.runs]
        self.made, self.runs, self.generation = index.made, index.runs, g + 1
        self.seen, self.texts = [*self.seen, f"met-{g}"], [*self.texts, f"segments-{g}"]
        self._commit()
        work.drop(f"segments-{g}/is_text=false", *old, *unlisted)
        return out

    def compact(self) -> None:
        """One run instead of several, and of each digest met its smallest doc_id once."""
        if not self.generation:
            return
        g, work = self.generation, self.work
        index = Index(work, self.n_buckets, 0, self.runs, self.made)
        index.add(self.spark.createDataFrame([], "bucket int, segment long, hashes binary"))

        def merge(rows):
            for bucket, (digests, lowest) in runtime.by_key(rows, "bucket", ["digests", "lowest"]):
                x, d = _lowest(np.frombuffer(b"".join(digests), DIGEST), np.concatenate([unpack(b, "<i8") for b in lowest]))
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([x.tobytes()]), pa.array([pack(d)])], ["bucket", "digests", "lowest"])

        every = self._tables(self.seen, self.SEEN)
        work.put(every.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, digests binary, lowest binary"), f"seen-{g}")
        old = [*self.runs, *self.seen, *(f"{x}-{g - 1}" for x in ("told", "earlier"))]
        self.made, self.runs, self.seen, self.generation = index.made, index.runs, [f"seen-{g}"], g + 1
        self._commit()
        work.drop(*set(old).difference(self.runs, self.seen))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(runtime.table(spark, sf_dir, "documents"), runtime.Workspace(spark))


#: The same result by brute force.
ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM words WHERE len(w) >= 13),
keyed AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) AS k FROM windows),
cut AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS least FROM keyed) WHERE least < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS p FROM cut) GROUP BY doc_id),
kept AS (SELECT words.doc_id, w, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
