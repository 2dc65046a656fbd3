"""Personal data: base patterns, and an offset-preserving pass over disguised identifiers.

Base spans come from the four patterns on the text as it stands. The second
pass runs transducers (homoglyphs and zero-width characters; spelled digits;
at/dot disguises) that rewrite the text and remember, for every character of
the rewritten text, the source characters it stands for. The same detectors run
on the rewritten text; what they find is mapped back and added unless a base span
of its kind contains it, so that an identifier of which the base patterns see a
part is there as a whole too. Base spans always stay.

A null text is an empty one; empty texts have no spans; whole texts are read,
in time linear in their length; repeated rows give repeated results; an empty
table gives an empty result. Spans of one kind are in order of start, then end.
Only doc_id and text are read, whatever other columns there are. Counts n_* are
of base spans, n_added of the rest.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import runtime

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match of [0-9]+... always starts where a run of digits does, as the one before it ends with a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Spans of the email pattern: from each @ back over its local part, then forward; every character is seen a bounded number of times."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), sorted; offsets are code points."""
    out = []
    if "@" in text:
        out += [(0, *x) for x in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУабвеѕіјкмнорстхуԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχι",
        "ABESIJKMHOPCTXYabвesijkмhopctxydhqwABEZHIKMNOPTYXavopuxi",
        strict=True,
    )
)
_LOOKALIKES = {k: v for k, v in _LOOKALIKES.items() if v.isascii()}
_ZERO_WIDTH = "​‌‍⁠﻿­"


def _plain(c: str) -> str:
    """What a single character stands for in an identifier."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _ZERO_WIDTH:
        return ""
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    if c in "。｡․":
        return "."
    value = unicodedata.digit(c, None)
    return c if value is None else str(value)


_NUMBER_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORD = "|".join(sorted(_NUMBER_WORDS, key=len, reverse=True))
_POINT = r"dot|point|punkt|punto"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:(?:{_WORD}|[0-9])(?!\w)(?:[ ,-]{{1,2}}|[ ]+(?:{_POINT})[ ]+)){{3,}}(?:{_WORD}|[0-9])(?!\w)", re.I)
_TOKEN = re.compile(rf"plus|{_POINT}|{_WORD}|[0-9]", re.I)

# A run of blanks is tried from its begin only, so that long ones cost no more than their length.
_OPEN, _CLOSE = r"(?<! )[ ]*[\[({<][ ]*", r"[ ]*[\])}>][ ]*"
_AT = re.compile(rf"{_OPEN}(?:at|@){_CLOSE}|(?<! )[ ]+at[ ]+", re.I)
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|(?<! )[ ]+dot[ ]+)"
_DOTS = re.compile(_DOT, re.I)
_RIGHT = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.I)
_ODD = re.compile(rf"[^\x00-\xbfÀ-ɏḀ-ỿ‐-‧‰-⁞]|[{_ZERO_WIDTH}․]")
_PAIR = rf"(?<!\w)(?:(?:{_WORD})(?!\w)(?:[ ,-]{{1,2}}|[ ]+(?:{_POINT})[ ]+)(?:{_WORD}|[0-9])|[0-9](?:[ ,-]{{1,2}}|[ ]+(?:{_POINT})[ ]+)(?:{_WORD}))(?!\w)"
_HINT = re.compile(rf"[\[({{<][ ]*(?:at|@)[ ]*[\])}}>]|(?<!\w)dot(?!\w)|(?:(?<!\w)(?:{_WORD})(?!\w)[ ,-]+){{2}}|{_PAIR}", re.I)


class Rewritten:
    """A text and, for each of its characters, the source span it stands for, kept as pieces."""

    def __init__(self, text: str):
        self.text, self.starts, self.pieces = text, [0], [(0, len(text), True)]

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replaces (start, end, by) of this text, sorted and apart, and composes the maps."""
        out, at, text = Rewritten(""), 0, []
        starts, pieces, size = [], [], 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                k = bisect_right(self.starts, a) - 1
                s, e, same = self.pieces[k]
                stop = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                starts.append(size)
                pieces.append((s + a - self.starts[k], s + stop - self.starts[k], True) if same else (s, e, False))
                size += stop - a
                a = stop

        for a, b, by in edits:
            keep(at, a)
            text += [self.text[at:a], by]
            if by:
                starts.append(size)
                pieces.append((self.source(a, b)[0], self.source(a, b)[1], False))
                size += len(by)
            at = b
        keep(at, len(self.text))
        out.text, out.starts, out.pieces = "".join([*text, self.text[at:]]), starts, pieces
        return out

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The span of source characters for characters a to b (exclusive) of this text."""
        k, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        s, _, same = self.pieces[k]
        first = s + a - self.starts[k] if same else s
        s, e, same = self.pieces[j]
        return first, s + b - self.starts[j] if same else e


def _dots_before(text: str, end: int, least: int, dots: dict[int, int]):
    """Disguised dots (start, end) of the local part that ends at `end`, from there back as far as it goes, but not before `least`."""
    at = end
    while True:
        while at > least and text[at - 1] in _LOCAL:
            at -= 1
        start = dots.get(at, -1)
        if start <= least or text[start - 1] not in _LOCAL or text[start - 1] == ".":
            return
        yield start, at
        at = start


def rewrite(text: str) -> Rewritten | None:
    """The text without its disguises; None if it has no sign of any."""
    if not _ODD.search(text) and not _HINT.search(text):
        return None
    r = Rewritten(text)
    edits = [(m.start(), m.end(), by) for m in _ODD.finditer(text) if (by := _plain(m[0])) != m[0]]
    if edits:
        r = r.apply(edits)
    edits = []
    for m in _SPELLED.finditer(r.text):
        if re.search(_WORD, m[0], re.I):
            parts = _TOKEN.findall(m[0])
            edits.append((*m.span(), "".join("+" if p.lower() == "plus" else p if p.isdigit() else str(_NUMBER_WORDS[p.lower()]) if p.lower() in _NUMBER_WORDS else "." for p in parts)))
    if edits:
        r = r.apply(edits)
    edits, last, dots = [], 0, None
    for m in _AT.finditer(r.text):
        if m.start() < last or not m.start() or r.text[m.start() - 1] not in _LOCAL:
            continue
        right = _RIGHT.match(r.text, m.end())
        plain = not re.search(r"[\[({<]", m[0])
        if not right or plain and not _DOTS.search(right[0]):
            continue
        if dots is None:
            dots = {d.end(): d.start() for d in _DOTS.finditer(r.text)}
        edits += [(*d, ".") for d in _dots_before(r.text, m.start(), last, dots)]
        edits.append((*m.span(), "@"))
        edits += [(d.start() + right.start(), d.end() + right.start(), ".") for d in _DOTS.finditer(right[0])]
        last = right.end()
    at = r.text.find("@")
    while at > 0:  # a plain @ before a domain with disguised dots
        right = _RIGHT.match(r.text, at + 1)
        if right and r.text[at - 1] in _LOCAL and _DOTS.search(right[0]):
            edits += [(d.start() + right.start(), d.end() + right.start(), ".") for d in _DOTS.finditer(right[0])]
        at = r.text.find("@", at + 1)
    if edits:
        done: list[tuple[int, int, str]] = []
        for e in sorted(set(edits)):
            if not done or e[0] >= done[-1][1]:
                done.append(e)
        r = r.apply(done)
    return None if r.text == text else r


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and those of disguised identifiers, both sorted by kind and start."""
    text = text or ""
    base = sorted(detect(text))
    found = rewrite(text)
    if found is None:
        return base, base
    taken = {k: [x for x in base if x[0] == k] for k in range(len(KINDS))}
    more = []
    for kind, a, b in detect(found.text):
        start, end = found.source(a, b)
        near = taken[kind]
        k = bisect_right(near, (kind, start, len(text)))  # base spans of a kind are apart: only the last that begins by then can contain it
        if k == 0 or near[k - 1][2] < end:
            more.append((kind, start, end))
    return base, sorted(base + more)


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame) -> DataFrame:
    """One row of spans and counts for each row of docs."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in runtime.small(batch):
                rows = [find(t) for t in part["text"].to_pylist()]
                counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in range(4)]
                yield pa.record_batch(
                    [part["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(show(base).encode()).hexdigest() for base, _ in rows]), pa.array([show(every) for _, every in rows]), pa.array([len(every) - len(base) for base, every in rows], pa.int64())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return runtime.id_and_text(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(runtime.table(spark, sf_dir, "documents"))
