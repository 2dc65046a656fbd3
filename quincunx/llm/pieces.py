"""SentencePiece models run by the tokenizers library.

read_model() parses the model's protobuf by hand; backend() rebuilds its
normaliser, metaspace marker and pieces as a Tokenizer: unigram scores for
unigram models, merges ranked by piece score for BPE models, with byte fallback.

A text is split where no piece can reach across (before a marker that follows
another character, and before a closing sign that follows a letter; both are
checked against the vocabulary), each distinct part is encoded once by a
multithreaded batch and kept in a bounded cache. Each new part, a tail without a
marker too, is compared with the sentencepiece library's ids; where they differ
it takes the library's and is counted. Models whose pieces reach across markers
have whole texts encoded, and compared.

Null and empty texts have no ids; texts of any length are encoded whole;
repeated rows give repeated results; where two segmentations have one score, the
library's choice stands; an empty table gives an empty result. Only doc_id and
text are read, whatever other columns there are. The marker U+2581 itself
decodes as a blank, which is the only change that a round trip may make; exact
says whether there is none.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import runtime

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The most units, and the most parts of units, that a worker remembers.
CACHE_UNITS = 300_000
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes):
    """(number, value) of a protobuf message: ints, or bytes for fixed and delimited ones."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        else:
            if wire == 2:
                size, at = _varint(raw, at)
            else:
                size = {1: 8, 5: 4}[wire]
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def read_model(raw: bytes) -> Model:
    """Field numbers are those of sentencepiece's public model format."""
    import struct

    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    m.unk_id = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    m.byte_fallback = m.byte_fallback or any(p[2] == BYTE for p in m.pieces)
    return m


def backend(m: Model, whole: bool = True):
    """The model as a Tokenizer, of whole texts with normaliser and marker, or of units that already carry theirs."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, byte_fallback=m.byte_fallback))
    elif m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        usable = {p for p, _, kind in m.pieces if kind in (NORMAL, USER)}
        ranked = sorted((i for i, p in enumerate(m.pieces) if p[0] in usable), key=lambda i: (-m.pieces[i][1], i))
        merges = [(p[:k], p[k:]) for i in ranked for p in [m.pieces[i][0]] for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        t = Tokenizer(models.BPE(vocab, merges, unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError(f"model kind {m.kind} is not supported")
    if whole:
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if m.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Codec:
    """Encodes and decodes whole texts with one model; check: compare with the sentencepiece library."""

    def __init__(self, path: str, threads: int = 2, check: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        with open(path, "rb") as f:
            self.model = read_model(f.read())
        self.split = not any(MARK in p.lstrip(MARK) for p, _, _ in self.model.pieces)
        self.tokenizer = backend(self.model, whole=not self.split)
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = np.dtype("<u2" if len(self.model.pieces) <= 65536 else "<u4")
        #: Ids of marker + word, of stems (a word up to a closing sign, with its marker) and of other units.
        self.words: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.odd: set[str] = set()  # parts on which backend and library differ
        joined = "\n".join(p for p, _, _ in self.model.pieces)
        self.closers = "".join(c for c in ".,;:!?" if not re.search(rf"{_LETTER}{re.escape(c)}", joined))
        self.stem = re.compile(rf"(.*?{_LETTER})([{self.closers}].*)", re.S) if self.closers and self.split else None
        self.letter = self.library.encode("a") if self.library else []
        self.charsmap = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self.charsmap = normalizers.Precompiled(self.model.charsmap)
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.model.add_dummy_prefix:
            text = f" {text}"
        return text.replace(" ", MARK) if self.model.escape_whitespaces else text

    def units(self, text: str) -> list[str]:
        text = self.normalise(text)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def _learn(self, parts: set[str]) -> None:
        """Ids of parts not seen before, by one batch, each compared with the library's."""
        new = [u for u in parts if u not in self.cache]
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache = {u: self.cache[u] for u in parts if u in self.cache}
        if not new:
            return
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.cache.update((unit, array(self.kind.char, e.ids).tobytes()) for unit, e in zip(new, found, strict=True))
        if self.library and self.model.add_dummy_prefix:
            # The library puts a marker in front itself; a part of nothing else cannot be asked for, and a tail is asked for behind a letter.
            marked = [u for u in new if u[0] == MARK != u]
            tails = [u for u in new if self.closers and u[0] in self.closers]
            self._compare(marked, [u[1:] for u in marked], 0)
            self._compare(tails, [f"a{u}" for u in tails], len(self.letter))

    def _compare(self, parts: list[str], asked: list[str], skipped: int) -> None:
        """Where the library's ids, but for the first few, are others than a part's, they take their place."""
        for part, ids in zip(parts, self.library.encode(asked, num_threads=1) if asked else [], strict=True):
            expected = array(self.kind.char, ids[skipped:]).tobytes()
            if self.cache[part] != expected:
                self.cache[part] = expected
                self.odd.add(part)

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = self.library.encode(texts, num_threads=1) if self.library else found
        return [(np.array(y, self.kind), int(x != y)) for x, y in zip(found, ids, strict=True)]

    def _parts(self, unit: str) -> tuple[str, ...]:
        found = self.stem.fullmatch(unit) if self.stem else None
        return found.groups() if found else (unit,)

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """(ids, parts that took the library's answer) of each text."""
        if not self.split:
            return self._whole(texts)
        # Words between single blanks are kept by themselves; anything else is cut into units with their markers.
        quick = self.model.add_dummy_prefix and self.model.escape_whitespaces and not self.charsmap
        odd = re.compile(f"  |^ | $|{MARK}")
        easy = [bool(quick and t and not odd.search(t)) for t in texts]
        split = [t.split(" ") if e else self.units(t) for t, e in zip(texts, easy, strict=True)]
        need = set().union(*(s for s, e in zip(split, easy, strict=True) if e))
        new = need.difference(self.words)
        if len(self.words) + len(new) > CACHE_UNITS:  # what this batch has stays, with it the frequent words
            self.words = {w: self.words[w] for w in need if w in self.words}
        parts = {w: self._parts(MARK + w) for w in new}
        other = {u: self._parts(u) for s, e in zip(split, easy, strict=True) if not e for u in s}
        self._learn({x for ps in (*parts.values(), *other.values()) for x in ps})
        join = lambda ps: b"".join(map(self.cache.__getitem__, ps))
        self.words.update((w, join(ps)) for w, ps in parts.items())
        other = {u: join(ps) for u, ps in other.items()}
        out = []
        for units, e in zip(split, easy, strict=True):
            ids = np.frombuffer(b"".join(map((self.words if e else other).__getitem__, units)), self.kind)
            out.append((ids, sum(x in self.odd for u in units for x in self._parts(MARK + u if e else u)) if self.odd else 0))
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text


_codecs: dict[tuple, Codec] = {}


def codec(path: str, check: bool = True) -> Codec:
    """One codec per worker and model."""
    if (path, check) not in _codecs:
        _codecs[path, check] = Codec(path, check=check)
    return _codecs[path, check]


SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, text_sha256 string, decoded_sha256 string, exact boolean, n_repaired long"


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """For each row: number and crc32 of its ids (little-endian unsigned 32-bit), digests of the text and of what its ids decode to.

    with_ids adds the column ids.
    """
    runtime.ship(docs.sparkSession)
    path = model or default_model()
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in runtime.small(batch, 2 << 20):
                texts = [t or "" for t in part["text"].to_pylist()]
                coded = c.encode_batch(texts)
                back = [c.decode(ids) for ids, _ in coded]
                sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                cols = [
                    part["doc_id"],
                    pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids, _ in coded], pa.int64()),
                    pa.array(sha),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array([b == t for b, t in zip(back, texts, strict=True)]),
                    pa.array([n for _, n in coded], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([ids.astype(np.int32) for ids, _ in coded], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names)

    return runtime.id_and_text(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(runtime.table(spark, sf_dir, "documents"))
