"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

payload_images() turns texts into images losslessly (64 RGB pixels a row, 8-bit
samples, Netpbm P6) and stores them in a written table; digests() reads that
table back, writes NPY tiles with difference hashes of the decoded arrays, and
reads those. A null text is an empty one, which is one row of blanks; texts of
any length are one image; equal texts give equal values; repeated rows give
repeated results; neighbouring cells that are equal give a zero bit; an empty
table gives an empty result. Bytes that are no image, have no pixels or lack
samples raise ValueError in decode(); features() gives them nulls and the
error's text, carries all other columns along and replaces those that have the
names of its own. Other operators read only doc_id and text.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

ROW = 192
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")
_HEADER_BITS = re.compile(rb"P([14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_netpbm(image: np.ndarray) -> bytes:
    """P6 for height x width x 3, P5 for height x width; 8-bit samples."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6, up to 16 bits a sample; bitmaps give 0 for black and 255 for white, as do grey images."""
    m = (_HEADER_BITS if raw[1:2] in b"14" else _HEADER).match(raw)
    if not m:
        raise ValueError("no Netpbm header")
    kind, width, height = (int(x) for x in m.groups()[:3])
    if not width or not height:
        raise ValueError("no pixels")
    if (width * height + 7) // 8 > len(raw):
        raise ValueError("samples are missing")
    if kind in (1, 4):
        if kind == 4:
            stride = (width + 7) // 8
            body = np.frombuffer(raw, np.uint8, stride * height, m.end()).reshape(height, stride)
            bits = np.unpackbits(body, axis=1)[:, :width]
        else:
            bits = np.array([c for c in raw[m.end() :] if c in b"01"][: width * height], np.uint8).reshape(height, width) - 48
        return (1 - bits) * np.uint8(255)
    top = int(m[4] or 0)
    if not 0 < top < 65536:
        raise ValueError("no maximum sample value")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if n * (1 + (top > 255)) > len(raw) - m.end():
        raise ValueError("samples are missing")
    if kind >= 5:
        kept = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", n, m.end())
    else:
        kept = np.array(raw[m.end() :].split()[:n], np.int64)
    if len(kept) != n:
        raise ValueError("samples are missing")
    if kept.max(initial=0) > top or kept.min(initial=0) < 0:
        raise ValueError("a sample is out of range")
    if top != 255:
        kept = (kept.astype(np.int64) * 255 + top // 2) // top
    return kept.astype(np.uint8, copy=False).reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of a height x width x 3 array, rows from the bottom."""
    height, width = image.shape[:2]
    stride = (3 * width + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : 3 * width] = image[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP with 8 (palette), 24 or 32 bits a pixel, either row order."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("no BMP header")
    start, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("BMP form not supported")
    stride, rows = (width * depth // 8 + 3) // 4 * 4, abs(height)
    if start + stride * rows > len(raw):
        raise ValueError("samples are missing")
    body = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * depth // 8]
    if depth == 8:
        colours = np.frombuffer(raw, np.uint8, max(0, start - 14 - size) // 4 * 4, min(14 + size, len(raw))).reshape(-1, 4)
        if body.max() >= len(colours):
            raise ValueError("a colour is missing from the palette")
        image = colours[body][:, :, 2::-1]
    else:
        image = body.reshape(rows, width, depth // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, parts of pixels weighted, by differences of a bilinearly read integral image."""
    grey = image.astype(np.float64)
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1, *grey.shape[2:]))
    table[1:, 1:] = grey.cumsum(0).cumsum(1)

    def cut(t: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, len(t) - 1, n + 1)
        low = np.minimum(at.astype(np.int64), len(t) - 2)
        share = (at - low).reshape(-1, *[1] * (t.ndim - 1))
        return np.diff(t[low] * (1 - share) + t[low + 1] * share, axis=0)

    sums = np.swapaxes(cut(np.swapaxes(cut(table, height), 0, 1), width), 0, 1)
    return sums / (grey.shape[0] / height * grey.shape[1] / width)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([299.0, 587.0, 114.0]) / 1000


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each cell of an 8 x 9 grey reduction brighter than the cell to its right?"""
    cells = np.round(resize(grey(image), 8, 9), 6)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, side: int = 16) -> bytes:
    """An NPY file of the image reduced to side x side, 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.floor(resize(image, side, side) + 0.5).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def features(media: DataFrame, side: int = 16) -> DataFrame:
    """For a table with a binary column media: its columns, height, width, tile (NPY), dhash and error."""
    runtime.ship(media.sparkSession)
    taken = {"height", "width", "tile", "dhash", "error"} & set(media.columns)
    if taken:
        media = media.drop(*taken)

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                rows = []
                for raw in part["media"].to_pylist():
                    try:
                        image = decode(raw or b"")
                        rows.append((image.shape[0], image.shape[1], tile(image, side), difference_hash(image), None))
                    except ValueError as e:
                        rows.append((None, None, None, None, str(e)))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([*part.columns, *cols], [*part.schema.names, "height", "width", "tile", "dhash", "error"])

    return media.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields] + ["height int, width int, tile binary, dhash string, error string"]))


def payload_images(docs: DataFrame, work: runtime.Workspace) -> DataFrame:
    """doc_id, n_bytes and the P6 image of each text, as read back from the written table."""

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]
                padded = [r.ljust(max(1, -(-len(r) // ROW)) * ROW, b" ") for r in raw]
                media = [encode_netpbm(np.frombuffer(p, np.uint8).reshape(-1, ROW // 3, 3)) for p in padded]
                yield pa.record_batch([part["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return work.put(runtime.id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def digests(images: DataFrame, work: runtime.Workspace | None = None) -> DataFrame:
    """What is read back, by its digests; feature: the difference hash, and the crc32 of the NPY tile as read from the written tiles."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary"

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                rows = []
                for raw in part["media"].to_pylist():
                    image = decode(raw)
                    payload = image.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(image), tile(image)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.record_batch([part["doc_id"], part["n_bytes"], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [x.split()[0] for x in schema.split(", ")])

    tiles = (work or runtime.Workspace(images.sparkSession)).put(images.mapInArrow(run, schema), "tiles")
    feature = F.concat_ws(":", "dhash", F.lower(F.lpad(F.hex(F.crc32("tile")), 8, "0")))
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = runtime.Workspace(spark)
    return digests(payload_images(runtime.table(spark, sf_dir, "documents"), work), work)
