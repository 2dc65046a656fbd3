"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks where the
content says so; a chunk is named by the BLAKE2b digest of its bytes and stored
once. A document's recipe lists its chunks; the recipe's Merkle root names the
document, and roots of equal recipes are rebuilt once.

File format, under one folder: `dealt/is_chunk=true` (name: key, body: zstd of
little-endian unsigned 16- or 32-bit ids; sorted by key within a file), `recipes` (rid,
part, doc_id, n_tokens, root, keys; ascending doc_id, null ids first, ties by
root) and `manifest`, which holds one Merkle root per part of recipes over its rows.
streams() and checksums() check every chunk against its key and every recipe
against its root, positions() the parts against the manifest, and read() the
recipes' numbers of ids against the ids read; all fail on a difference.

A null text is an empty one, whose only id is the end id; texts of any length
are encoded whole; repeated rows have recipes of their own and share chunks; an
empty table gives an empty store. Only doc_id and text are read, whatever other
columns there are.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime

KEY_BYTES = 16
#: A chunk ends where the rolling hash has CUT_BITS zero bits, has at least LEAST ids and at most MOST.
CUT_BITS, LEAST, MOST, REACH = 12, 512, 16384, 16
#: The most words (or pieces) that a worker remembers between batches, and the most chunk keys that a task remembers having written.
CACHE_WORDS = 300_000
SEEN_KEYS = 200_000
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters take the short way: lower case maps them one to one, NFC leaves them, and which of them are letters is fixed.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: The pre-tokenizer that the short way knows; a file with another one has every word encoded whole.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet by its public rule: visible bytes stand for themselves, the others follow from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174):
            out[b] = 256 + n
            n += 1
    return out


class _Kept(dict):
    """What a function gave for the first keys met; when it had to be asked for others very often, it begins anew."""

    def __init__(self, made, most: int):
        self.made, self.most, self.missed = made, most, 0

    def __missing__(self, key):
        value = self.made(key)
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > 8 * self.most:
                self.clear()
                self.missed = 0
        return value


class Encoder:
    """Ids of whole texts by the tokenizers library.

    With by_word, a text is first cut at ASCII white space, which this kind of
    vocabulary drops and never joins across. Distinct words are kept in a
    bounded cache; a word of plain letters and signs is cut into
    the pre-tokenizer's pieces, whose letter runs go straight to the library's
    model and are kept too.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.words = _Kept(self._word, CACHE_WORDS)
        self.pieces = _Kept(self._piece, CACHE_WORDS)
        self.signs = _Kept(lambda piece: self._whole([piece.decode()])[0], 10_000)
        self.alphabet = _byte_letters()
        made = json.loads(self.tokenizer.to_str())
        splits = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lowers = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.short = splits[:1] == [_PATTERN] and lowers == ["NFC", "Replace", "Lowercase"]

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a letter run in lower case."""
        shown = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _word(self, word: bytes) -> bytes:
        if self.short:
            low = word.lower()
            if low.isalpha():  # bytes: ASCII letters only
                return self.pieces[low]
            if low[:-1].isalpha() and low[-1] in b".,":
                return self.pieces[low[:-1]] + self.signs[low[-1:]]
            text = word.decode("utf-8", "surrogatepass")
            if "<|" not in text and _PLAIN.fullmatch(text):
                return b"".join([self.pieces[p.encode()] if _LETTERS.fullmatch(p) else self.signs[p.encode()] for p in _PIECE.findall(text.lower())])
        return self._whole([word.decode("utf-8", "surrogatepass")])[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.frombuffer(raw, self.kind) for raw in self._whole(texts)]
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, t.encode("utf-8", "surrogatepass").split())), self.kind) for t in texts]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """One encoder per worker and file."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream: a multiplicative rolling hash of the last REACH ids decides."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolled = mixed.copy()
    width = 1
    while width < REACH:  # doubling: a window's hash from those of its halves
        step = pow(0x01000193, width, 1 << 32)
        rolled[width:] = rolled[width:] + rolled[:-width] * np.uint32(step)
        width *= 2
    places = np.flatnonzero((rolled >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for at in [*places.tolist(), n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or at == n and at > last:
            out.append(at)
            last = at
    return out


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=KEY_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; leaves and inner nodes are hashed apart, an odd node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=KEY_BYTES).digest() for x in leaves] or [bytes(KEY_BYTES)]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + level[k] + level[k + 1], digest_size=KEY_BYTES).digest() for k in range(0, len(level) - 1, 2)]
        level = up + level[len(up) * 2 :]
    return level[0]


def split_keys(raw: bytes) -> list[bytes]:
    return [raw[k : k + KEY_BYTES] for k in range(0, len(raw), KEY_BYTES)]


@dataclass
class Store:
    """The tables of a written store; kind: numpy's name of an id's type."""

    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    kind: str


def write(docs: DataFrame, work: runtime.Workspace, tokenizer: str | None = None, end_id: int | None = END_ID, by_word: bool = True) -> Store:
    """Encodes whole texts and writes a store."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import zstandard

        enc, packer, seen = encoder(path, by_word), zstandard.ZstdCompressor(3), set()
        for batch in batches:
            for part in runtime.small(batch, 4 << 20):
                rows, chunks = [], []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), enc.encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                    if end_id is not None:
                        ids = np.append(ids, enc.kind.type(end_id))
                    keys, last = [], 0
                    for at in cuts(ids):
                        raw = ids[last:at].tobytes()
                        key, last = digest(raw), at
                        keys.append(key)
                        if key not in seen:
                            if len(seen) >= SEEN_KEYS:
                                seen.clear()
                            seen.add(key)
                            chunks.append((key, packer.compress(raw)))
                    rows.append((doc_id, len(ids), merkle(keys), b"".join(keys)))
                n, m = len(rows), len(chunks)
                yield pa.record_batch(
                    [
                        pa.array([False] * n + [True] * m),
                        pa.array([r[0] for r in rows] + [None] * m, pa.int64()),
                        pa.array([r[1] for r in rows] + [None] * m, pa.int64()),
                        pa.array([r[2] for r in rows] + [c[0] for c in chunks], pa.binary()),
                        pa.array([r[3] for r in rows] + [c[1] for c in chunks], pa.binary()),
                    ],
                    ["is_chunk", "doc_id", "n_tokens", "name", "body"],
                )

    coded = runtime.id_and_text(docs).mapInArrow(run, "is_chunk boolean, doc_id long, n_tokens long, name binary, body binary")

    def once(batches):
        last = None
        for batch in batches:
            keep = []
            for is_chunk, name in zip(batch["is_chunk"].to_pylist(), batch["name"].to_pylist(), strict=True):
                keep.append(not is_chunk or name != last)
                last = name if is_chunk else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    # One exchange puts equal chunks side by side; a recipe goes wherever its id does.
    dealt = coded.withColumn("to", F.when(F.col("is_chunk"), F.xxhash64("name")).otherwise(F.xxhash64("doc_id", "name"))).repartition("to").sortWithinPartitions("is_chunk", "name").drop("to")
    work.put(dealt.mapInArrow(once, coded.schema), "dealt", ("is_chunk",))
    dealt = work.get("dealt", coded.schema)
    recipes = (
        dealt.where(~F.col("is_chunk"))
        .select("doc_id", "n_tokens", F.col("name").alias("root"), F.col("body").alias("keys"))
        .orderBy(F.col("doc_id").asc_nulls_first(), "root")
        .select(F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("part"), "*")
    )
    recipes = work.put(recipes, "recipes")
    return Store(dealt.where("is_chunk").select(F.col("name").alias("key"), "body"), recipes, work.put(_manifest(recipes), "manifest"), encoder_kind(path))


def encoder_kind(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"


def _manifest(recipes: DataFrame) -> DataFrame:
    """Per part: rows, ids and the Merkle root over its recipes' roots in order.

    A part is one range of the sort. Leaves are first hashed in runs of 4096
    rows, so that no row gathers more than such a run or one part's runs.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for batch in batches:
            for part, n, root in zip(batch["part"].to_pylist(), batch["n_tokens"].to_pylist(), batch["root"].to_pylist(), strict=True):
                s = state.setdefault(part, [0, 0, [], []])
                s[0] += 1
                s[1] += n
                s[2].append(root)
                if len(s[2]) == 4096:
                    s[3].append(merkle(s[2]))
                    s[2] = []
        done = [(p, s[0], s[1], merkle([*s[3], *([merkle(s[2])] if s[2] else [])])) for p, s in sorted(state.items())]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], ["part", "n_rows", "n_ids", "root"])

    ordered = recipes.select("part", "rid", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "rid")
    return ordered.mapInArrow(run, "part int, n_rows long, n_ids long, root binary")


def positions(store: Store) -> DataFrame:
    """rid, doc_id, n_tokens, root and start: ids of all documents before it. Offsets of parts are one number a part."""
    found = {r["part"]: r for r in _manifest(store.recipes).collect()}
    kept = {r["part"]: r for r in store.manifest.collect()}
    if found != kept:
        raise ValueError("recipes differ from their manifest")
    offsets, total = [], 0
    for part in sorted(kept):
        offsets.append((part, total))
        total += kept[part]["n_ids"]
    spark = store.recipes.sparkSession
    before = spark.createDataFrame(offsets, "part int, before long")
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("rid").rowsBetween(W.unboundedPreceding, -1))
    return store.recipes.join(F.broadcast(before), "part").select("rid", "doc_id", "n_tokens", "root", (F.col("before") + F.coalesce(within, F.lit(0))).alias("start"))


def streams(store: Store) -> DataFrame:
    """root and body (ids as bytes) of every distinct recipe, rebuilt from its chunks and verified."""
    return _rebuilt(store, lambda raw: (raw,), [("body", pa.binary(), "binary")])


def _rebuilt(store: Store, take, columns: list[tuple]) -> DataFrame:
    """root and what `take` gives of each distinct recipe's bytes; columns: names, Arrow types, Spark types."""
    recipes = store.recipes.select("root", "keys").dropDuplicates(["root"])

    def unfold(batches):
        for batch in batches:
            for part in runtime.small(batch, 1 << 20):
                keys = [split_keys(k) for k in part["keys"].to_pylist()]
                root = [r for r, ks in zip(part["root"].to_pylist(), keys, strict=True) for _ in ks]
                yield pa.record_batch([pa.array(root, pa.binary()), pa.array([j for ks in keys for j in range(len(ks))], pa.int32()), pa.array([k for ks in keys for k in ks], pa.binary())], ["root", "seq", "key"])

    wanted = recipes.mapInArrow(unfold, "root binary, seq int, key binary")
    parts = wanted.join(store.chunks, "key", "left").select("root", "seq", "key", "body").repartition("root").sortWithinPartitions("root", "seq")

    def join(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        root, keys, body = None, [], []

        def close():
            if merkle(keys) != root:
                raise ValueError("a recipe differs from its root")
            return root, *take(b"".join(body))

        def rows(out):
            kinds = [pa.binary(), *(kind for _, kind, _ in columns)]
            return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["root", *(name for name, _, _ in columns)])

        for batch in batches:
            out = []
            for r, k, b in zip(batch["root"].to_pylist(), batch["key"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if r != root:
                    if root is not None:
                        out.append(close())
                    root, keys, body = r, [], []
                raw = unpack.decompress(b) if b is not None else b""
                if digest(raw) != k:
                    raise ValueError("a chunk is missing or differs from its key")
                keys.append(k)
                body.append(raw)
            yield rows(out)
        if root is not None:
            yield rows([close()])

    return parts.mapInArrow(join, ", ".join(["root binary", *(f"{name} {kind}" for name, _, kind in columns)]))


def checksums(store: Store) -> DataFrame:
    """root, read_tokens and ids_crc32 (ids as little-endian unsigned 32-bit) of every distinct recipe."""
    kind = store.kind

    def take(raw: bytes):
        ids = np.frombuffer(raw, kind).astype("<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    return _rebuilt(store, take, [("read_tokens", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long")])


def read(store: Store, work: runtime.Workspace) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from ids that were read and counted."""
    found = work.put(checksums(store), "checksums")
    work.release()
    both = positions(store).join(found, "root", "left")
    n = F.when(F.col("read_tokens") == F.col("n_tokens"), F.col("read_tokens")).otherwise(F.raise_error(F.lit("a recipe's number of ids is not that of the ids read")).cast("long"))
    return both.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = runtime.Workspace(spark)
    store = write(runtime.table(spark, sf_dir, "documents"), work)
    work.release()
    return read(store, work)
