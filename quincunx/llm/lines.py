"""Fuzzy line dedup by MinHash.

A line's character shingles (SHINGLE code points of the lower-cased line; a
shorter line is one shingle) give a one-permutation MinHash signature of BANDS x
ROWS bins, empty bins filled from the next full one. Lines that agree in a band
are candidates; candidates are verified by exact Jaccard similarity of their
shingle sets; verified links join lines into components by distributed
union-find. Of a component's occurrences the one with the smallest (doc_id,
line number) stays.

Band hashes travel packed, a bucket of the hash space at a time. Lines that meet
within one task are tied to the least of them there, which alone stands for them
in the bucket, so that a band shared by a large part of all lines reaches its
bucket once a task, not once a line. Each line is first compared with the line it
is tied to. In a band where any of that failed, any two lines that are not yet of
one component may still be alike. If at most FEW lines are outside the band's
commonest component, they meet all lines of the band. Else they meet the line
with most links, and what is still apart is compared where two lines of different
components have a rare shingle in common.
So no two similar lines of a band stay apart.

Null and empty texts have no lines; blank lines are never removed. Rows equal in
doc_id and text count as one document and get the same result; null ids come
last. Ties between equal lines go to the smaller doc_id, then the earlier line.
Texts and lines of any length are read whole. A document keeps its line breaks
between kept lines. An empty table gives an empty result. Columns of docs other
than doc_id and text are carried along, whatever their names; only text_kept and
n_gone are replaced by without(). Lines are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .components import FEW_EDGES, components

SHINGLE, BANDS, ROWS, SIMILAR = 8, 14, 5, 0.8
#: Bits (2 to this power) of the filter for lines whose text is wanted, and how many a line sets.
FILTER_BITS, FILTER_HASHES = 26, 3
#: Shingles are counted in so many cells (2 to this power) where groups are compared shingle by shingle.
SKETCH_BITS = 20
#: These cells travel in so many slices, each of at most 2**16 cells.
SKETCH_SLICES = 256
#: So many lines of a band, at most, are compared with all of its lines.
FEW = 8
BINS = BANDS * ROWS
_EMPTY = np.uint32(0xFFFFFFFF)
#: What a blank line is made of: all that str.strip() takes off.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def line_id(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def shingles(line: str) -> set[str]:
    low = line.lower()
    return {low[k : k + SHINGLE] for k in range(max(1, len(low) - SHINGLE + 1))}


def packed_shingles(line: str) -> np.ndarray | None:
    """The same set, sorted, a byte to a code point; None for a line that has others or less than a shingle."""
    try:
        low = line.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(low) < SHINGLE:
        return None
    values = np.sort(np.ndarray(len(low) - SHINGLE + 1, np.uint64, low, strides=(1,)))
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_id(shingle: str) -> int:
    """The value that packed_shingles has for it; a hash where it would have none."""
    try:
        if len(shingle) == SHINGLE:
            return int.from_bytes(shingle.encode("latin-1"), "little")
    except UnicodeEncodeError:
        pass
    return xxhash.xxh3_64_intdigest(shingle.encode("utf-32-le", "surrogatepass"))


def jaccard(a: str, b: str, pack=packed_shingles, plain=shingles) -> float:
    """pack, plain: makers of b's shingles, which may keep what they made."""
    x, y = packed_shingles(a), pack(b)
    if x is None or y is None:
        x, y = shingles(a), plain(b)
        both = len(x & y)
    else:
        merged = np.sort(np.concatenate([x, y]))
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both / (len(x) + len(y) - both)


def signatures(lines: list[str]) -> np.ndarray:
    """One row of BINS values for each (non-empty) line."""
    low = [x.lower() for x in lines]
    low = [x if len(x) >= SHINGLE else x + "\n" * (SHINGLE - len(x)) for x in low]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = codes * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(16)
    width = 1
    while width < SHINGLE:
        step = np.uint32(pow(0x01000193, width, 1 << 32))
        h = h[:-width] * step + h[width:]
        width *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    cell = np.repeat(np.arange(0, len(low) * BINS, BINS), sizes)[: len(h)]
    cell += (h >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16)
    h *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):  # windows over a line's end count as empty
        across = ends - k
        h[across[across < len(h)]] = _EMPTY
    out = np.full(len(low) * BINS, _EMPTY, np.uint32)
    np.minimum.at(out, cell, h)
    out = out.reshape(-1, BINS)
    original = out != _EMPTY
    full = original.copy()
    for shift in range(1, BINS):  # only bins that were full at first give their values away
        if full.all():
            break
        donor = np.roll(original, -shift, 1) & ~full
        if donor.any():
            out[donor] = (np.roll(out, -shift, 1) + np.uint32(shift * 0x9E3779B1 & 0xFFFFFFFF))[donor]
            full |= donor
    return out


def bands(lines: list[str]) -> np.ndarray:
    """One row of BANDS hashes (unsigned 64-bit) for each line."""
    s = signatures(lines).reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for k in range(ROWS):
        h = (h ^ s[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _portions(lines: list[str], most: int = 100_000):
    """Runs of lines whose working arrays stay in the processor's cache, as far as a single line lets them."""
    start = size = 0
    for k, line in enumerate(lines):
        size += len(line)
        if size >= most:
            yield lines[start : k + 1]
            start, size = k + 1, 0
    if start < len(lines):
        yield lines[start:]


def numbered(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text: rid tells documents apart."""
    return runtime.id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """line, doc_id, rid, pos of every line that is not blank."""

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                found, places, times = [], [], []
                for text in part["text"].to_pylist():
                    split = (text or "").split("\n")
                    kept = [pos for pos, line in enumerate(split) if line.strip()]
                    found += [line_id(split[pos]) for pos in kept]
                    places += kept
                    times.append(len(kept))
                row = pa.array(np.repeat(np.arange(len(times)), times))
                yield pa.record_batch([pa.array(found, pa.int64()), part["doc_id"].take(row), part["rid"].take(row), pa.array(places, pa.int32())], ["line", "doc_id", "rid", "pos"])

    return numbered(docs).mapInArrow(run, "line long, doc_id long, rid long, pos int")


def _distinct(batches, most: int):
    """Lists of about `most` lines that a task has not met lately."""
    seen: set[int] = set()
    held: dict[int, str] = {}
    size = 0
    for batch in batches:
        for part in runtime.small(batch):
            for text in part["text"].to_pylist():
                for line in (text or "").split("\n"):
                    if line.strip():
                        key = line_id(line)
                        if key not in seen:
                            seen.add(key)
                            held[key] = line
                            size += len(line)
                if size >= most:
                    yield held
                    held, size = {}, 0
                    if len(seen) > 300_000:
                        seen.clear()
    if held:
        yield held


def groups(docs: DataFrame, work: runtime.Workspace) -> DataFrame:
    """band, line, lead: of every band shared by two lines or more, what each line is tied to (a smaller one, so that all hang together)."""
    n_buckets = 16 * max(1, docs.rdd.getNumPartitions())  # a bucket holds what a part of an input split sends
    names = ["bucket", "bands", "lines", "leads"]

    def tied(band, line):
        """Of rows in order of band and line: where bands begin, each row's least line, and which rows are not that line."""
        first = np.concatenate([[True], band[1:] != band[:-1]])
        start = np.flatnonzero(first)
        lead = np.repeat(line[start], np.diff(np.append(start, len(band))))
        return start, lead, line != lead

    def run(batches):
        for held in _distinct(batches, 6_000_000):
            ids = np.fromiter(held, np.int64, len(held))
            values = list(held.values())
            band = np.concatenate([bands(part) for part in _portions(values)]).ravel()
            line = np.repeat(ids, BANDS)
            order = np.lexsort((line, band))
            band, line = band[order], line[order]
            start, lead, others = tied(band, line)
            # What meets here goes out as tied; the least line stands for it elsewhere.
            if others.any():
                yield pa.record_batch([pa.array([-1], pa.int32()), *(pa.array([x[others].tobytes()]) for x in (band, line, lead))], names)
            band, line = band[start], line[start]
            bucket = (band >> np.uint64(20)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
            took = [(k, order[cut[k] : cut[k + 1]]) for k in range(n_buckets) if cut[k] < cut[k + 1]]
            packed = [pa.array([x[o].tobytes() for _, o in took], pa.binary()) for x in (band, line)]
            yield pa.record_batch([pa.array([k for k, _ in took], pa.int32()), *packed, pa.nulls(len(took), pa.binary())], names)

    def meet(batches):
        now, held = None, ([], [], [])

        def close():
            band, line = (np.frombuffer(b"".join(h), t) for h, t in zip(held, (np.uint64, np.int64), strict=False))
            if now >= 0:
                order = np.lexsort((line, band))
                band, line = band[order], line[order]
                _, lead, others = tied(band, line)
                band, line, lead = band[others], line[others], lead[others]
            else:
                lead = np.frombuffer(b"".join(held[2]), np.int64)
            return pa.record_batch([pa.array(band.view(np.int64)), pa.array(line), pa.array(lead)], ["band", "line", "lead"])

        for batch in batches:
            for bucket, *packed in zip(*(batch[n].to_pylist() for n in names), strict=True):
                if now is not None and (bucket != now or now < 0):
                    yield close()
                    held = ([], [], [])
                now = bucket
                for column, value in zip(held, packed, strict=True):
                    column.append(value)
        if now is not None:
            yield close()

    packed = numbered(docs).select("text").mapInArrow(run, "bucket int, bands binary, lines binary, leads binary")
    dealt = packed.repartition(F.when(F.col("bucket") < 0, F.xxhash64("bands")).otherwise(F.xxhash64("bucket"))).sortWithinPartitions("bucket")
    return work.put(dealt.mapInArrow(meet, "band long, line long, lead long").distinct(), "groups")


def _filter_cells(ids: np.ndarray) -> np.ndarray:
    """The cells of a filter for each line: a row each of FILTER_HASHES."""
    h = ids.view(np.uint64)
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(FILTER_HASHES)]
    return np.stack([(h * x) >> np.uint64(64 - FILTER_BITS) for x in odd]).astype(np.int64)


def line_filter(wanted: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, set for the wanted lines: it passes all of them, and of the others fewer the fewer are wanted."""
    slices, cells = 64, 1 << (FILTER_BITS - 6)

    def mark(batches):
        held = np.zeros((slices, cells // 8), np.uint8)
        for batch in batches:
            at = np.unique(_filter_cells(batch["line"].to_numpy()))
            cut = np.searchsorted(at, np.arange(slices + 1) * cells)
            for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                bits = np.zeros(cells, bool)
                bits[at[cut[k] : cut[k + 1]] - k * cells] = True
                held[k] |= np.packbits(bits, bitorder="little")
        took = np.flatnonzero(held.any(1)).tolist()
        yield pa.record_batch([pa.array(took, pa.int32()), pa.array([held[k].tobytes() for k in took], pa.binary())], ["slice", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["slice"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                bits = np.frombuffer(raw, np.uint8)
                held[k] = held[k] | bits if k in held else bits
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "bits"])

    kind = "slice int, bits binary"
    found = wanted.select("line").mapInArrow(mark, kind).repartition("slice").mapInArrow(merge, kind).toArrow()
    out = np.zeros((slices, cells // 8), np.uint8)
    for k, raw in zip(found["slice"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def texts(docs: DataFrame, wanted: DataFrame, work: runtime.Workspace) -> DataFrame:
    """line and text of the wanted lines. What passes a filter of fixed size travels, compressed together by bucket; the bucket's requests decide."""
    shared = docs.sparkSession.sparkContext.broadcast(line_filter(wanted))  # 2**FILTER_BITS bits, whatever the input
    n_buckets = 8 * max(1, docs.rdd.getNumPartitions())

    def pack(batches):
        import zstandard

        packer, passes = zstandard.ZstdCompressor(1), shared.value
        for held in _distinct(batches, 16_000_000):
            ids = np.fromiter(held, np.int64, len(held))
            cells = _filter_cells(ids)
            ids = ids[(passes[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(0)]
            values = [held[i].encode("utf-8", "surrogatepass") for i in ids.tolist()]
            bucket = ids.view(np.uint64) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
            took = [(k, order[cut[k] : cut[k + 1]]) for k in range(n_buckets) if cut[k] < cut[k + 1]]
            yield pa.record_batch([pa.array([k for k, _ in took], pa.int32()), pa.array([ids[o].tobytes() for _, o in took], pa.binary()), pa.array([packer.compress(b"\n".join([values[i] for i in o.tolist()])) for _, o in took], pa.binary())], ["bucket", "ids", "body"])

    def ask(batches):
        for batch in batches:
            ids = batch["line"].to_numpy()
            bucket = ids.view(np.uint64) % np.uint64(n_buckets)
            took = [(int(k), ids[bucket == k].tobytes()) for k in np.unique(bucket)]
            yield pa.record_batch([pa.array([k for k, _ in took], pa.int32()), pa.array([x for _, x in took], pa.binary()), pa.array([None] * len(took), pa.binary())], ["bucket", "ids", "body"])

    def answer(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        now, need = None, set()
        for batch in batches:  # requests of a bucket come before its lines
            lines, found = [], []
            for bucket, ids, body in zip(batch["bucket"].to_pylist(), batch["ids"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if bucket != now:
                    now, need = bucket, set()
                ids = np.frombuffer(ids, np.int64).tolist()
                if body is None:
                    need.update(ids)
                elif need:
                    hit = [k for k, i in enumerate(ids) if i in need]
                    if hit:
                        values = unpack.decompress(body).split(b"\n")
                        for k in hit:
                            need.discard(ids[k])
                            lines.append(ids[k])
                            found.append(values[k].decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(lines, pa.int64()), pa.array(found, pa.string())], ["line", "text"])

    kind = "bucket int, ids binary, body binary"
    rows = numbered(docs).select("text").mapInArrow(pack, kind).union(wanted.select("line").mapInArrow(ask, kind))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("body").isNotNull())
    return work.put(dealt.mapInArrow(answer, "line long, text string"), "texts")


def verified(pairs: DataFrame, lines: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """pairs (a, b) with the column ok: is their exact similarity at least `similar`?"""

    def run(batches):
        kept = [lru_cache(2000)(f) for f in (packed_shingles, shingles)]  # a leader meets many lines
        for batch in batches:
            for part in runtime.small(batch):
                ok = [jaccard(x, y, *kept) >= similar for x, y in zip(part["x"].to_pylist(), part["y"].to_pylist(), strict=True)]
                yield pa.record_batch([part["a"], part["b"], pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    a, b = lines.select(F.col("line").alias("a"), F.col("text").alias("x")), lines.select(F.col("line").alias("b"), F.col("text").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, ok boolean")


def _shingle_values(text: str) -> np.ndarray:
    packed = packed_shingles(text)
    return np.fromiter(map(shingle_id, shingles(text)), np.uint64) if packed is None else packed


def _cell(values: np.ndarray) -> np.ndarray:
    """Which counter of the sketch a shingle is counted in."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_counts(rooted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each of 2**SKETCH_BITS cells: in how many lines its shingles are (0 if all those lines have one root), and a root of many of them.

    The root is found by majority votes in each task, of which the surest is
    taken. Any root will do: it is only what spares most comparisons. A task
    sends its cells packed, a row for each of SKETCH_SLICES slices of the sketch,
    whatever the lines; those who merge them hold a slice at a time.
    """
    size = 1 << SKETCH_BITS
    width = size // SKETCH_SLICES
    sent = np.dtype([("cell", np.uint16), ("n", np.int32), ("main", np.int64), ("votes", np.int32), ("mixed", np.bool_)])
    told = np.dtype([("cell", np.uint16), ("n", np.int32), ("main", np.int64)])

    def run(batches):
        n, main, votes, mixed = np.zeros(size, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, bool)
        for batch in batches:
            for part in runtime.small(batch, 1 << 20):
                for root, text in zip(part["root"].to_pylist(), part["text"].to_pylist(), strict=True):
                    at = np.unique(_cell(_shingle_values(text)))
                    same = main[at] == root
                    mixed[at] |= ~same & (n[at] > 0)  # while all have one root, it is the main one
                    n[at] += 1
                    votes[at] += np.where(same, 1, -1).astype(np.int32)
                    lost = at[votes[at] < 0]
                    main[lost], votes[lost] = root, 1
        at = np.flatnonzero(n)
        cells = np.empty(len(at), sent)
        for name, values in zip(sent.names, (at % width, n[at], main[at], votes[at], mixed[at]), strict=True):
            cells[name] = values
        cut = np.searchsorted(at, np.arange(SKETCH_SLICES + 1) * width)
        took = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
        yield pa.record_batch([pa.array(took, pa.int32()), pa.array([cells[cut[k] : cut[k + 1]].tobytes() for k in took], pa.binary())], ["slice", "cells"])

    def merge(batches):
        now, held = None, None

        def close():
            n, _, main, _, mixed = held
            at = np.flatnonzero(mixed)
            cells = np.empty(len(at), told)
            for name, values in zip(told.names, (at, np.minimum(n[at], 2**31 - 1), main[at]), strict=True):
                cells[name] = values
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["slice", "cells"])

        for batch in batches:
            for k, raw in zip(batch["slice"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield close()
                    now, held = k, (np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1, np.int32), np.zeros(width, bool))
                n, first, main, votes, mixed = held
                cells = np.frombuffer(raw, sent)
                at = cells["cell"]
                first[at] = np.where(n[at] > 0, first[at], cells["main"])
                mixed[at] |= cells["mixed"] | (first[at] != cells["main"])
                n[at] += cells["n"]
                surer = (cells["votes"] > votes[at]) | ((cells["votes"] == votes[at]) & (cells["main"] > main[at]))
                main[at[surer]], votes[at[surer]] = cells["main"][surer], cells["votes"][surer]
        if now is not None:
            yield close()

    kind = "slice int, cells binary"
    packed = rooted.select("root", "text").mapInArrow(run, kind).repartition("slice").sortWithinPartitions("slice")
    found = packed.mapInArrow(merge, kind).toArrow()  # at most 2**SKETCH_BITS cells
    count, main = np.zeros(size, np.int32), np.zeros(size, np.int64)
    for k, raw in zip(found["slice"].to_pylist(), found["cells"].to_pylist(), strict=True):
        cells = np.frombuffer(raw, told)
        at = cells["cell"].astype(np.int64) + k * width
        count[at], main[at] = cells["n"], cells["main"]
    return count, main


def sharing_prefixes(rooted: DataFrame, work: runtime.Workspace, similar: float) -> DataFrame:
    """Pairs (a, b) of the rows (line, root, text) of different roots that can be similar; none that is similar is missing.

    Shingles are put in order, those in few of these lines first. Sets x and y
    of a similarity of at least t have at least c = t / (1 + t) * (|x| + |y|) in
    common, so the first common one stands at most |x| - c and |y| - c down, and
    a line sends out only its first shingles. Any order does; theirs is by the
    counts of a sketch of fixed size, which is broadcast. Shingles of one root
    only come first and are left out. Of a shingle's lines, those of the root
    that the sketch names meet the others only. Lines are dealt out evenly
    first, as taking them apart is the work.
    """
    rooted = rooted.select("line", "root", "text").repartition("line")
    shared = rooted.sparkSession.sparkContext.broadcast(shingle_counts(rooted))  # 12 bytes a cell

    def run(batches):
        count, main = shared.value
        for batch in batches:
            for part in runtime.small(batch, 1 << 20):
                sizes, places, tokens, mains = [], [], [], []
                for root, text in zip(part["root"].to_pylist(), part["text"].to_pylist(), strict=True):
                    values = _shingle_values(text)
                    cells = _cell(values)
                    first = np.arange(len(values) - math.ceil(similar * len(values) - 1e-9) + 1)
                    order = np.lexsort((values, count[cells]))[first]
                    kept = count[cells[order]] > 0
                    sizes.append(len(values))
                    places.append(first[kept])
                    tokens.append(values[order][kept])
                    mains.append(main[cells[order][kept]] == root)
                times = [len(x) for x in tokens]
                columns = [np.repeat(part[c].to_numpy(), times) for c in ("line", "root")]
                numbers = [np.repeat(np.array(sizes, np.int32), times), np.concatenate(places).astype(np.int32), np.concatenate(tokens).view(np.int64)]
                yield pa.record_batch([pa.array(x) for x in (*columns, *numbers, np.concatenate(mains))], ["line", "root", "size", "place", "token", "main"])

    places = rooted.mapInArrow(run, "line long, root long, size int, place int, token long, main boolean")
    places = work.put(places, "placed")  # so that a frequent shingle's join is split
    x, y = places.where("not main").alias("x"), places.alias("y")
    least = F.ceil(similar / (1 + similar) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    other = (F.col("y.main") | (F.col("x.line") > F.col("y.line"))) & (F.col("x.root") != F.col("y.root"))
    near = (F.col("x.token") == F.col("y.token")) & other & (F.col("x.place") + least <= F.col("x.size")) & (F.col("y.place") + least <= F.col("y.size"))
    return x.join(y, near).select(F.greatest("x.line", "y.line").alias("a"), F.least("x.line", "y.line").alias("b")).distinct()


def extended(known: DataFrame, edges: DataFrame, work: runtime.Workspace, name: str) -> DataFrame:
    """known (node, root) with more edges (a, b): only roots take part in what joins components, the others follow theirs; a small list is joined anew."""
    if known.count() <= FEW_EDGES:
        every = known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges.select("a", "b"))
        return work.put(components(every, work, f"{name}-top"), name)

    def up(df: DataFrame, end: str) -> DataFrame:
        roots = known.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return df.join(roots, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_root", end)).drop("_node", "_root")

    top = components(up(up(edges.select("a", "b"), "a"), "b"), work, f"{name}-top").toDF("below", "top")
    every = known.union(top.select("below", F.col("below").alias("root"))).distinct()
    return work.put(every.join(top, F.col("root") == F.col("below"), "left").select("node", F.coalesce("top", "root").alias("root")), name)


def linked(docs: DataFrame, work: runtime.Workspace, similar: float = SIMILAR) -> DataFrame:
    """(node, root) of every line that has a fuzzy copy."""
    pairs = groups(docs, work)
    work.release()
    lines = texts(docs, pairs.select("line").union(pairs.select("lead")).distinct(), work)
    work.release()
    tested = work.put(verified(pairs.select(F.col("line").alias("a"), F.col("lead").alias("b")).distinct(), lines, similar), "tested")
    known = work.put(components(tested.where("ok"), work, "first"), "known")
    failed = tested.where("not ok").select("a", "b")
    torn = work.put(pairs.join(failed, (F.col("line") == F.col("a")) & (F.col("lead") == F.col("b")), "left_semi").select("band").distinct(), "torn")
    if not torn.take(1):
        work.drop("groups", "texts", "tested", "torn")
        return known
    members = pairs.join(torn, "band").select("band", F.explode(F.array("line", "lead")).alias("line")).distinct()
    members = work.put(members.join(known, members.line == known.node, "left").select("band", "line", F.coalesce("root", "line").alias("root")), "members")
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band")
    sizes = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("apart"))
    mixed = work.put(sizes.where("apart > 0 and n > 2").select("band", "main", "apart"), "mixed")
    apart = work.put(members.join(mixed, "band").where("root <> main").select("band", "line", "root", (F.col("apart") <= FEW).alias("few")), "apart")
    # Few lines apart: at most FEW pairs for each line of the band.
    x, y = apart.where("few").alias("x"), members.alias("y")
    meet = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root")))
    direct = meet.select(F.greatest("x.line", "y.line").alias("a"), F.least("x.line", "y.line").alias("b")).distinct()
    direct = verified(direct.join(failed, ["a", "b"], "left_anti"), lines, similar).where("ok").select("a", "b")
    # Many: the line with most links first, as what the others are tied to may be a variant of it.
    links = tested.where("ok").select(F.explode(F.array("a", "b")).alias("linked")).groupBy("linked").agg(F.count("*").alias("n"))
    rest = apart.where("not few").select("band", "line")
    crowded = work.put(rest.select("band").distinct(), "crowded")
    hubs = members.join(crowded, "band").join(links, F.col("line") == F.col("linked"), "left").groupBy("band")
    lead = work.put(hubs.agg(F.max_by("line", F.struct(F.coalesce("n", F.lit(0)), "line")).alias("lead")), "lead")
    asked = rest.join(lead, "band").where("line <> lead").select(F.greatest("line", "lead").alias("a"), F.least("line", "lead").alias("b")).distinct()
    edges = direct.union(verified(asked, lines, similar).where("ok").select("a", "b"))
    known = extended(known, edges, work, "joined")
    work.drop("groups", "tested", "torn", "mixed", "apart", "lead")
    if not crowded.take(1):
        work.drop("texts", "members", "crowded")
        return known
    again = members.join(crowded, "band").select("band", "line")
    again = work.put(again.join(known, again.line == known.node, "left").select("band", "line", F.coalesce("root", "line").alias("root")), "again")
    left = again.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band")
    left = work.put(again.join(left, "band").select("line", "root").distinct(), "left")
    late = verified(sharing_prefixes(left.join(lines, "line"), work, similar), lines, similar).where("ok")
    known = extended(known, late, work, "all")
    work.drop("texts", "members", "crowded", "left", "again", "placed", "joined", "known")
    return known


def removals(docs: DataFrame, work: runtime.Workspace, similar: float = SIMILAR) -> DataFrame:
    """rid, doc_id and the numbers of the lines that go, for each document that loses any."""
    found = linked(docs, work, similar)
    work.release()
    where = work.put(occurrences(docs), "occurrences")
    each = where.groupBy("line").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    each = work.put(each.join(found, each.line == found.node, "left").select("line", F.coalesce("root", "line").alias("root"), "doc_id", "n"), "each")
    first = each.groupBy("root").agg(F.min("doc_id").alias("first"), F.sum("n").alias("many")).where("many > 1").select("root", "first")
    first = work.put(first, "first")
    # Lines that recur, alike or nearly so, are written by themselves: the one that very many documents have can then be split.
    kept = work.put(each.join(first, "root").select("line", "root", "first"), "kept")
    met = work.put(where.join(kept, "line").select("rid", "doc_id", "pos", "root", (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("later")), "met")
    # In the first document itself, its first line of the component stays; without an id, that of the least rid.
    own = met.where("not later")
    stays = work.put(own.groupBy("root").agg(F.min(F.struct("rid", "pos")).alias("at")).select("root", "at"), "stays")
    own = own.join(stays, "root").where(F.struct("rid", "pos") != F.col("at"))
    gone = met.where("later").select("rid", "doc_id", "pos").union(own.select("rid", "doc_id", "pos")).distinct()
    out = work.put(gone.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "gone")
    work.drop("occurrences", "each", "first", "kept", "met", "stays")
    return out


def without(docs: DataFrame, work: runtime.Workspace, similar: float = SIMILAR, kept: str = "text_kept", n_gone: str = "n_gone") -> DataFrame:
    """All rows and columns of docs with text_kept (the text without the lines that go) and n_gone (how many); columns of these two names are replaced."""
    gone = removals(docs, work, similar)
    work.release()
    rid, own, lost = (runtime.fresh(docs, x) for x in ("rid", "own", "lost"))
    gone = gone.select(F.col("rid").alias(rid), F.col("doc_id").alias(own), F.col("gone").alias(lost))
    same = (F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")) == F.col(rid)) & docs["doc_id"].cast("long").eqNullSafe(F.col(own))
    joined = docs.join(gone, same, "left")
    columns = [docs[runtime.quoted(c)] for c in docs.columns if c not in (kept, n_gone)]
    split = F.when(F.col(lost).isNotNull(), F.split(docs["text"].cast("string"), "\n", -1))
    apart = joined.select(*columns, lost, split.alias(rid))
    stays = F.array_except(F.sequence(F.lit(0), F.size(rid) - 1), lost)  # linear in the lines, however many go
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda k: F.get(rid, k)), "\n"))
    names = [runtime.quoted(c) for c in docs.columns if c not in (kept, n_gone)]
    return apart.select(*names, text.alias(kept), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n_gone))


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with the kept text in its place; a document of which nothing but blanks stays goes, if it lost any line. n_chars, if there, follows."""
    work = runtime.Workspace(docs.sparkSession)
    kept, n_gone = runtime.fresh(docs, "kept"), runtime.fresh(docs, "n_gone")
    out = without(docs, work, similar, kept, n_gone)
    out = out.where((F.col(n_gone) == 0) | (F.ltrim(F.col(kept), F.lit(BLANKS)) != ""))
    changed = {"text": F.col(kept).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(n_gone) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(runtime.quoted(c))).alias(c) for c in docs.columns))


def line_count(text):
    """How many lines of a text (null: empty) are not blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256 of every document."""
    docs = runtime.id_and_text(runtime.table(spark, sf_dir, "documents"))
    found = without(docs, runtime.Workspace(spark))
    return found.select("doc_id", line_count(F.col("text")).alias("n_lines"), F.col("n_gone").alias("n_removed"), F.sha2(F.coalesce("text_kept", F.lit("")), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]], similar: float = SIMILAR) -> dict:
    """What the query gives, by comparing every pair of lines; for tests on small tables."""
    where: dict[str, list] = {}
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip():
                where.setdefault(line, []).append((doc_id is None, doc_id or 0, pos))
    names = list(where)
    sets = [shingles(x) for x in names]
    parent = list(range(len(names)))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    index: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        near: dict[int, int] = {}
        for x in s:
            for j in index.get(x, ()):
                near[j] = near.get(j, 0) + 1
            index.setdefault(x, []).append(k)
        for j, n in near.items():
            if n / (len(s) + len(sets[j]) - n) >= similar:
                parent[top(k)] = top(j)
    kept: dict[int, tuple] = {}
    for k, line in enumerate(names):
        kept[top(k)] = min(kept.get(top(k), (True, 1 << 62, 0)), *where[line])
    out = {}
    of = {line: kept[top(k)] for k, line in enumerate(names)}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for pos, x in enumerate(lines) if not x.strip() or of[x] == (doc_id is None, doc_id or 0, pos)]
        out[doc_id] = (sum(bool(x.strip()) for x in lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out
