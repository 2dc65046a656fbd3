"""Benchmark decontamination by a BM25 inverted index of the test items and block-max WAND.

Each item is indexed by term twice, as a whole and by its question alone.
Impacts are BM25 weights divided by the least score of any passage that
verification would accept (at most THRESHOLD of the entry's score against
itself), so that 1 is the threshold of all and no leak stays below it. A posting list is cut
into blocks with their largest impacts. Every passage of every document (PASSAGE
words or twice the longest item, overlapping by half, so that some passage
holds any copy whole) is a query, and all items with an entry at or above the
threshold are retrieved. A bound over the rarer terms, taken for all passages of a document at
once, spares those that cannot reach it; block-max WAND runs on the others.

A retrieved item is verified by its five-word shingles: it has leaked if the
passage holds `similar` of its question's shingles, or of the whole item's. What
has fewer words is one shingle, looked for among runs of as many words; a question
so short is found anywhere, and has leaked alone only if it is the whole text. The
answer is the item's last line, or last sentence if there is one line; its own
overlap says what has leaked: `both`, the question alone (`question`), or enough
of the item without either (`item`).

The index is broadcast in shards of at most SHARD_BYTES of item text, or one
longer item; each shard takes one pass over the documents. Document frequencies,
mean length and the longest item are those of all items, whatever the shards, so
that neither scores nor passages depend on how the items are dealt.

Null and empty texts and items have no passages and match nothing; texts of any
length are read whole; repeated documents give repeated rows; repeated item ids
count as their smallest text; of an item's equally good passages the first is
shown; empty tables give an empty result. Only doc_id, text and item_id, text
are read; clean() carries all other columns along, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

PASSAGE, WORDS, SIMILAR, THRESHOLD = 128, 5, 0.8, 0.5
#: Postings in a block; the most item text in a shard of the index.
BLOCK, SHARD_BYTES = 16, 8 << 20
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double, item_overlap double, leak string"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(found: list[str], n: int = WORDS) -> set[tuple[str, ...]]:
    if not found:
        return set()
    return {tuple(found[k : k + n]) for k in range(max(1, len(found) - n + 1))}


def least_share(found: list[str], weights: dict[str, float], similar: float) -> float:
    """The least share of the weights of found's terms that is left with `similar` of its shingles; a lower bound.

    Terms are lost with all their shingles. A lost shingle has WORDS terms at
    most, so the shingles of all lost terms, each counted, are at most WORDS
    times the lost ones; by that the heaviest for their shingles are taken away.
    """
    sets = [set(g) for g in grams(found)]
    room = max(len(g) for g in sets) * (len(sets) - math.ceil(similar * len(sets) - 1e-9))
    count = Counter(t for g in sets for t in g)
    total = left = sum(weights[t] for t in count)
    for t in sorted(count, key=lambda t: (-weights[t] / count[t], t)):
        part = min(1.0, room / count[t])
        left -= part * weights[t]
        room -= part * count[t]
        if room <= 0:
            break
    return max(left, 0.0) / total


def question_answer(text: str) -> tuple[str, str]:
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Statistics:
    """Of all items: how many, their mean and greatest length in words, and in how many each term is (of the terms that are asked for)."""

    n: int
    mean: float
    longest: int
    frequency: dict[str, int]

    @staticmethod
    def of(items: list[list[str]]) -> Statistics:
        return Statistics(len(items), sum(map(len, items)) / max(len(items), 1), max(map(len, items), default=0), Counter(t for w in items for t in set(w)))


class Index:
    """Posting lists over entries (items and their questions) sorted by number, with block maxima.

    known: statistics of all items, where these are only a shard of them.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, similar: float = SIMILAR, known: Statistics | None = None):
        kept = [(i, t, w) for i, t in sorted(items) if (w := words(t))]
        known = known or Statistics.of([w for _, _, w in kept])
        self.threshold, self.similar = 1.0, similar
        self.ids = [i for i, _, _ in kept]
        parts = [question_answer(t) for _, t, _ in kept]
        self.grams = [(grams(words(q)), grams(words(a)), grams(w)) for (q, a), (_, _, w) in zip(parts, kept, strict=True)]
        self.known = defaultdict(set)  # by their length, the shingles of all questions and items
        for q, _, w in self.grams:
            for g in q | w:
                self.known[len(g)].add(g)
        self.passage = max(PASSAGE, 2 * known.longest)
        n, mean = known.n, known.mean
        held = defaultdict(list)
        for k, (_, _, w) in enumerate(kept):
            for term, tf in Counter(w).items():
                held[term].append((k, tf, len(w)))
        rarity = {t: math.log(1 + (n - known.frequency[t] + 0.5) / (known.frequency[t] + 0.5)) for t in held}
        raw = {t: [(k, rarity[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))) for k, tf, size in p] for t, p in held.items()}
        self.weights = [{} for _ in kept]
        for t, p in raw.items():
            for k, x in p:
                self.weights[k][t] = x
        self.own = [sum(w.values()) for w in self.weights]
        self.short = defaultdict(list)  # of a question of fewer words than a shingle: the items' numbers
        self.entries, held = [], defaultdict(list)  # of an entry: its item's number
        for k, ((q, _), (_, _, w)) in enumerate(zip(parts, kept, strict=True)):
            asked = words(q)
            if 0 < len(asked) < WORDS:
                self.short[tuple(asked)].append(k)
            for text in [w, asked] if len(asked) >= WORDS and asked != w else [w]:
                terms = sorted(set(text))
                own = sum(self.weights[k][t] for t in terms)
                least = own * max(1e-6, min(threshold, least_share(text, self.weights[k], similar)))
                for t in terms:
                    held[t].append((len(self.entries), self.weights[k][t] / least))
                self.entries.append(k)
        n = len(self.entries)
        self.items, self.impacts, self.tops, self.top = {}, {}, {}, {}
        for t, p in held.items():
            self.items[t] = [k for k, _ in p]
            self.impacts[t] = [x for _, x in p]
            self.tops[t] = [max(self.impacts[t][a : a + BLOCK]) for a in range(0, len(p), BLOCK)]
            self.top[t] = max(self.tops[t])
        # The commonest terms, as long as they leave every item something to reach the threshold with, are only bounded.
        self.rest = np.zeros(n)
        essential = set(held)
        for t in sorted(held, key=lambda t: (-len(held[t]), t)):
            after = self.rest.copy()
            after[self.items[t]] += self.impacts[t]
            if len(held[t]) <= max(1, n // 100) or after.max() > 0.7:
                break
            self.rest = after
            essential.discard(t)
        self.essential = {t: k for k, t in enumerate(sorted(essential))}
        order = sorted(essential)
        self.first = np.concatenate([[0], np.cumsum([len(self.items[t]) for t in order])]).astype(np.int64)
        self.flat_items = np.array([k for t in order for k in self.items[t]], np.int64)
        self.flat_impacts = np.array([x for t in order for x in self.impacts[t]], float)

    def possible(self, found: list[str]) -> list[int]:
        """Numbers of the passages in which some item may reach the threshold."""
        get = self.essential.get
        hits = [(k, e) for k, e in enumerate(map(get, found)) if e is not None]
        if not hits:
            return []
        at, term = np.array(hits, np.int64).T
        half = self.passage // 2
        last = max(0, -(-(len(found) - self.passage) // half))  # the number of the last passage
        here = np.concatenate([at // half, at // half - 1])
        both = np.concatenate([term, term])
        fits = (here >= 0) & (here <= last)
        pairs = np.unique(here[fits] * len(self.essential) + both[fits])
        here, term = pairs // len(self.essential), pairs % len(self.essential)
        count = self.first[term + 1] - self.first[term]
        spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[term], count)
        cell, back = np.unique(np.repeat(here, count) * len(self.entries) + self.flat_items[spot], return_inverse=True)
        total = np.bincount(back, self.flat_impacts[spot]) + self.rest[cell % len(self.entries)]
        return np.unique(cell[total >= self.threshold - 1e-9] // len(self.entries)).tolist()

    def retrieve(self, found: list[str]) -> list[tuple[int, float]]:
        """(entry's number, score) of all entries at or above the threshold, by block-max WAND over the passage's distinct terms."""
        least = self.threshold - 1e-9
        lists = [[self.items[t][0], 0, t] for t in sorted(set(found)) if t in self.items]
        end, out = len(self.entries), []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (item, _, t) in enumerate(lists):
                if item >= end:
                    break
                bound += self.top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, beyond = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for _, at, t in lists[: pivot + 1]:
                p = self.items[t]
                block = bisect_left(p, item, at) // BLOCK
                if block < len(self.tops[t]):
                    bound += self.tops[t][block]
                    beyond = min(beyond, p[min((block + 1) * BLOCK, len(p)) - 1] + 1)
            if bound < least:
                goal = max(item + 1, beyond)  # no item of these blocks, before the next list comes in, can reach it
            elif lists[0][0] == item:
                score = sum(self.impacts[t][at] for _, at, t in lists[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                goal = item + 1
            else:
                goal = item
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    p = self.items[x[2]]
                    x[1] = bisect_left(p, goal, x[1])
                    x[0] = p[x[1]] if x[1] < len(p) else end
        return out

    def score(self, item: int, found: set[str]) -> float:
        """BM25 of the item over these terms, as a share of its score against itself."""
        return sum(x for t, x in self.weights[item].items() if t in found) / self.own[item]

    def overlap(self, own: set[tuple[str, ...]], part: list[str], near: dict[int, set]) -> float:
        """The share of the shingles in the passage; near keeps the passage's by their length."""
        if not own:
            return 0.0
        n = len(next(iter(own)))
        if n not in near:
            near[n] = grams(part, n)
        return len(own & near[n]) / len(own)

    def leaks(self, text: str | None) -> list[tuple]:
        """(item_id, passage's first word, score, overlaps of question, answer, item, what leaked) of verified items; an item's best passage."""
        found = words(text)
        best: dict[int, tuple] = {}
        half = self.passage // 2
        alone = self.short.get(tuple(found), ()) if len(found) < WORDS else ()
        for p in [0] if alone else self.possible(found):
            part = found[p * half : p * half + self.passage]
            near: dict[int, set] = {n: grams(part, n) for n in self.known}
            if self.similar > 0 and all(near[n].isdisjoint(own) for n, own in self.known.items()):
                continue  # no shingle in common with any item
            for item in sorted({self.entries[e] for e, _ in self.retrieve(part)} | {*alone}):
                q, a, whole = (self.overlap(g, part, near) for g in self.grams[item])
                asked = q >= self.similar and (item in alone or len(next(iter(self.grams[item][0]), ())) == WORDS)
                if asked or whole >= self.similar:
                    leak = "item" if q < self.similar else "both" if a >= self.similar else "question"
                    row = (self.ids[item], p * half, self.score(item, set(part)), q, a, whole, leak)
                    best[item] = max(best.get(item, row), row, key=lambda r: (r[5], r[2], -r[1]))
        return [best[k] for k in sorted(best)]


def shards(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """item_id, text, shard of the items that have an id and a text, and the number of shards; a long item has one to itself."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = known.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size, most = F.octet_length("text"), SHARD_BYTES // 2
    total = items.where(size <= most).agg(F.sum(size)).first()[0] or 0
    n = -(-total // most) or 1
    long = [r["item_id"] for r in items.where(size > most).select("item_id").orderBy("item_id").collect()]  # each is a pass over the documents
    own = F.lit(None).cast("int")
    for k, item in enumerate(long):
        own = F.when(F.col("item_id") == item, n + k).otherwise(own)
    return items.withColumn("shard", F.coalesce(own, F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))), n + len(long)


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, similar: float = SIMILAR):
    """One Index for each shard of the items, with the statistics of all."""
    items, n = shards(benchmark)

    def count(batches):
        for batch in batches:
            for part in runtime.small(batch):
                found = [words(t) for t in part["text"].to_pylist()]
                terms = [sorted(set(w)) for w in found]
                rows = [(s, t, None) for s, ts in zip(part["shard"].to_pylist(), terms, strict=True) for t in ts]
                rows += [(None, None, len(w)) for w in found if w]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "term", "size"])

    counted = items.mapInArrow(count, "shard int, term string, size long")
    total, mean, longest = counted.agg(F.count("size"), F.avg("size"), F.max("size")).first()
    terms = counted.where("term is not null").groupBy("term").agg(F.count("*").alias("n"), F.collect_set("shard").alias("shards"))
    for k in range(n):
        rows = items.where(F.col("shard") == k).select("item_id", "text").toArrow()
        seen = terms.where(F.array_contains("shards", k)).select("term", "n").toArrow()  # the terms of one shard's items
        known = Statistics(total, mean or 0.0, longest or 0, dict(zip(seen["term"].to_pylist(), seen["n"].to_pylist(), strict=True)))
        yield Index(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)), threshold, similar, known)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, similar: float = SIMILAR) -> DataFrame:
    """One row for each document and item that has leaked into it."""
    spark = docs.sparkSession
    runtime.ship(spark)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    out = None
    for index in indexes(benchmark, threshold, similar):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in runtime.small(batch):
                    rows = [(d, *x) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True) for x in shared.value.leaks(t)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string())
                    yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        found = runtime.id_and_text(docs).mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs, all columns, into which no item has leaked."""
    spark = docs.sparkSession
    runtime.ship(spark)
    for index in indexes(benchmark, threshold, similar):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in runtime.small(batch):
                    yield part.filter(pa.array([not shared.value.leaks(t) for t in part["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))
