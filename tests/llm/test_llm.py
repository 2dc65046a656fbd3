"""The ten operators against plain Python, on small tables with nulls, empty and repeated rows."""

import hashlib
import io
import re
import struct
import time
import zlib
from dataclasses import replace

import duckdb
import numpy as np
import pytest
import xxhash
from quincunx.llm import decontam, lines, media, pieces, pii, quality, simhash, substring, tokenstore, toxicity

from quincunx.llm import runtime

SF = "/root/testdata/sf0.001"
PROSE = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit 60").fetchall()]
SCHEMA = "doc_id long, text string, label string, band int"
ROWS = [(i, t, "x", 1) for i, t in enumerate(PROSE)] + [(100, None, None, None), (101, "", "y", 2), (102, " \n\t ", "y", 2), (103, PROSE[3], "z", 3), (104, PROSE[4] + " end", "z", 3), (105, "a " * 40_000, "z", 3), (103, PROSE[3], "z", 3), (None, PROSE[5], "z", 3), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(spark, docs, empty):
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(docs, runtime.Workspace(spark)).collect()}
    split = [(d, (t or "").encode().split()) for d, t, *_ in ROWS]
    first: dict = {}
    for d, w in split:
        for k in range(len(w) - 12):
            if d is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, d), d)
    want = set()
    for d, w in split:
        gone = {k + j for k in range(len(w) - 12) if d is not None and first[tuple(w[k : k + 13])] < d for j in range(13)}
        want.add((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert got == want
    assert substring.deduplicate(empty, runtime.Workspace(spark)).count() == 0


def test_substring_history(spark, docs, empty, tmp_path):
    """Parts added one after the other, by three sessions' worth of objects, give what one call gives; then runs are compacted."""
    rows = lambda df: sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)
    texts = [*PROSE[:20], *[f"{a} {b}" for a, b in zip(PROSE[:20], PROSE[20:40], strict=True)], *PROSE[5:15], *[PROSE[3][40:]] * 3]
    every = [(k, t) for k, t in enumerate(texts)]
    schema = "doc_id long, text string"
    want = rows(substring.deduplicate(spark.createDataFrame(every, schema).repartition(2), runtime.Workspace(spark)))
    assert sum(r[2] for r in want) > 500
    got = []
    for k in range(4):
        history = substring.History(spark, str(tmp_path / "index"), n_buckets=8)
        assert history.generation == k + (k == 3)
        got += rows(history.add(spark.createDataFrame(every[k * 14 : k * 14 + 14], schema).repartition(2)))
        if k == 2:
            history.compact()
            assert len(history.runs) == len(history.seen) == 1
    assert sorted(got, key=str) == want
    again = substring.History(spark, str(tmp_path / "index"))
    assert again.add(empty).count() == 0
    assert {r["n_removed"] for r in again.add(spark.createDataFrame([(99, PROSE[3]), (-1, PROSE[4]), (None, PROSE[4])], schema)).collect()} == {len(PROSE[3].split()), 0}


def test_simhash(spark, docs, empty):
    got = {(r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in simhash.classes(docs, runtime.Workspace(spark)).collect()}
    prints = []
    for _, t, *_ in ROWS:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    low = {}
    group = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    for g, (d, *_) in zip(group, ROWS, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    assert got == {(d, p, low.get(g)) for (d, *_), p, g in zip(ROWS, prints, group, strict=True)}
    assert simhash.classes(empty, runtime.Workspace(spark)).count() == 0


def test_simhash_writes_small_tables_in_few_files(spark, docs, monkeypatch):
    """Without merged partitions too, each table between the steps is one file, and links are not written twice; a file a task was 3700 processes on check_h."""
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    written = {}

    def put(self, df, name, *a, f=runtime.Workspace.put, **b):
        out = f(self, df, name, *a, **b)
        written[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(runtime.Workspace, "put", put)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        simhash.classes(docs, runtime.Workspace(spark))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: n for k, n in written.items() if k not in ("prints", "components-joined", "found")} == {"distinct": 1, "components-0": 1, "lowest": 1, "low": 1}


def test_trees_find_what_brute_force_finds():
    rng = np.random.default_rng(1)
    prints = np.repeat(rng.integers(0, 2**63, 40, dtype=np.uint64), 30)
    for _ in range(3):
        prints ^= np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)
    prints = np.unique(prints)
    a, b = simhash.forest(np.zeros(len(prints), np.int64), np.ones(len(prints), bool), prints, 4)
    i, j = np.triu_indices(len(prints), 1)
    near = np.bitwise_count(prints[i] ^ prints[j]) <= 4
    want = simhash.unite(np.arange(len(prints)), i[near], j[near])
    assert (want == simhash.unite(np.arange(len(prints)), np.searchsorted(prints, a), np.searchsorted(prints, b))).all()


def test_lines(spark, docs, empty):
    rows = [r for r in ROWS if r[0] is not None]
    rows = list(dict.fromkeys(rows))
    got = {r["doc_id"]: (r["n_gone"], r["text_kept"] or "") for r in lines.without(spark.createDataFrame(rows, SCHEMA), runtime.Workspace(spark)).collect()}
    want = lines.brute([r[:2] for r in rows])
    assert {d: (n, hashlib.sha256(t.encode()).hexdigest()) for d, (n, t) in got.items()} == {d: w[1:] for d, w in want.items()}
    assert lines.without(docs, runtime.Workspace(spark)).count() == len(ROWS)
    assert lines.without(empty, runtime.Workspace(spark)).count() == 0


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    work = runtime.Workspace(spark)
    store = tokenstore.write(docs, work)
    plain = Tokenizer.from_file(tokenstore.default_tokenizer())
    ids = {t: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in ROWS}
    got = {r["root"]: r for r in tokenstore.checksums(store).collect()}
    at = 0
    for r in tokenstore.positions(store).orderBy("rid").collect():
        assert r["start"] == at
        at += r["n_tokens"]
        texts = [t for d, t, *_ in ROWS if d == r["doc_id"]]
        assert (r["n_tokens"], got[r["root"]]["ids_crc32"]) in {(len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for t in texts}
    assert at == sum(len(ids[t]) for _, t, *_ in ROWS)
    assert tokenstore.positions(tokenstore.write(empty, runtime.Workspace(spark))).count() == 0


def test_token_store_refuses_changes(spark, docs):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    work = runtime.Workspace(spark)
    good = tokenstore.write(docs.where("doc_id < 6"), work)
    assert tokenstore.read(good, runtime.Workspace(spark)).count() == 6
    first = good.chunks.agg(F.min("key")).first()[0]
    other = F.when(F.col("key") == F.lit(first), F.lit(bytes(8)))
    longer = good.recipes.withColumn("n_tokens", F.col("n_tokens") + 1)
    some = F.concat(F.lit(bytes(1)), F.expr("substring(keys, 2)"))
    bad = [
        replace(good, chunks=good.chunks.withColumn("body", other.otherwise(F.col("body")))),
        replace(good, chunks=good.chunks.where(F.col("key") != F.lit(first))),
        replace(good, recipes=good.recipes.withColumn("keys", some)),
        replace(good, recipes=good.recipes.withColumn("root", F.lit(bytes(16)))),
        replace(good, recipes=good.recipes.where("doc_id <> 3")),
        replace(good, manifest=good.manifest.withColumn("n_rows", F.col("n_rows") + 1)),
        replace(good, recipes=longer),
        replace(good, recipes=longer, manifest=tokenstore._manifest(longer)),
    ]
    for k, store in enumerate(bad):
        with pytest.raises((PySparkException, ValueError)):
            tokenstore.read(store, runtime.Workspace(spark)).collect()
            pytest.fail(f"change {k} was not seen")


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    odd = ["it's we'll <|endoftext|>. <|ENDOFTEXT|> x<|startoftext|>y", "ÀÉ×÷ ÿÿ ßSS İI K µ ª º", "éa Á. don't. l'été, 12,5", "\x1c\x1f a\x85b 'LL're x's.'s", "日本 🎉", "", "a.%%% b..."]
    plain = Tokenizer.from_file(tokenstore.default_tokenizer())
    assert [e.ids for e in plain.encode_batch(odd, add_special_tokens=False)] == [x.tolist() for x in tokenstore.Encoder(tokenstore.default_tokenizer()).encode(odd)]


def test_pieces(spark, docs):
    import sentencepiece

    odd = ["a  b", " x", "", "\n\ttab y", "日本語🎉 \x00z", "<s> </s><unk> <0x41>", "  ", "a.b,c. d.%%%", *PROSE]
    c = pieces.Codec(pieces.default_model())
    coded = c.encode_batch(odd)
    assert [x.tolist() for x, _ in coded] == sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()).encode(odd)
    assert [c.decode(x) for x, _ in coded] == odd and not c.odd
    assert pieces.encode(docs, with_ids=True).where("not exact").count() == 0


def _unigram(pieces, escape=True, extra=False):
    """A unigram model's protobuf, written by hand: (piece, score, kind) rows and the normaliser's settings."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def block(key, raw):
        return number(key << 3 | 2) + number(len(raw)) + raw

    flag = lambda key, x: number(key << 3) + number(int(x))
    rows = b"".join(block(1, block(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", x) + flag(3, kind)) for p, x, kind in pieces)
    return rows + block(2, flag(3, 1) + flag(35, True)) + block(3, block(1, b"identity") + flag(3, True) + flag(4, extra) + flag(5, escape))


def test_pieces_of_unigram_models(tmp_path):
    import random

    import sentencepiece

    rnd = random.Random(1)
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    runs = {"".join(rnd.choices("abcde", k=n)) for n in (2, 3, 4) for _ in range(60)} | set("abcde.,\u2581")
    plain = [(p, -rnd.uniform(2, 12), 1) for p in sorted(runs | {f"\u2581{r}" for r in sorted(runs)[::2] if "\u2581" not in r})]
    across = [("a\u2581b", -3.3, 1), ("c.\u2581d", -2.2, 1)]
    texts = ["", "a", " ", "abc de.", "  a  b ", "xyz \u00e9", "a b c. d", "e,", *(" ".join("".join(rnd.choices("abcde.,", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 30))) for _ in range(200))]
    for pieces_, extra in ((plain, False), (plain, True), (plain + across, False), (plain + across, True)):
        path = tmp_path / f"{len(pieces_)}-{extra}.model"
        path.write_bytes(_unigram(special + pieces_, extra=extra))
        library = sentencepiece.SentencePieceProcessor(model_file=str(path))
        c, own = pieces.Codec(str(path)), pieces.Codec(str(path), check=False)
        assert c.model.kind == pieces.UNIGRAM and c.split == (pieces_ is plain) and c.model.byte_fallback
        want = library.encode(texts)
        got = [[x.tolist() for x, _ in c.encode_batch(texts)], [x.tolist() for x, _ in own.encode_batch(texts)], [e.ids for e in pieces.backend(c.model).encode_batch(texts, add_special_tokens=False)]]
        for found in got:  # equal scores, of the same pieces in another order, may be told apart by rounding
            assert [sorted(x) for x in found] == [sorted(x) for x in want] and sum(a != b for a, b in zip(found, want, strict=True)) <= 5
        if not extra:
            assert [c.decode(np.array(x)) for x in got[0]] == texts
            assert [c.decode(np.array(x)) for x in got[1]] == texts


def test_pieces_that_differ_take_the_librarys_ids():
    c = pieces.Codec(pieces.default_model())

    class Other:
        def encode(self, texts, num_threads=1):
            return [[*c.letter, 9] if t[0] == "a" else [7, 8] for t in texts]

    c.library = Other()
    assert [(x.tolist(), n) for x, n in c.encode_batch(["well, this", "b  c", ""])] == [([7, 8, 9, 7, 8], 3), ([7, 8, 7, 8], 2), ([], 0)]


def test_pii():
    def base(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and pii._luhn(d):
                out.append((2, *m.span()))
        return sorted(out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15])

    hard = ["a@b.c d@e@f.g.h 1.2.3.4.5.6.7.8 300.1.1.1 +1(23)45-67.89 @x.y a@.b", "4111 1111 1111 1111 4111-1111-1111-1112", "", "é a.b@c.d.", "+4 5+49 170 123456"]
    for t in [*PROSE, *hard]:
        assert pii.find(t)[0] == base(t)
        assert set(pii.find(t)[0]) <= set(pii.find(t)[1])
    for t, kind, span in [("mail john dot smith at ex-a dot com now", 0, "john dot smith at ex-a dot com"), ("аdmin@ехample.com", 0, "аdmin@ехample.com"), ("bob [at] site (dot) org.", 0, "bob [at] site (dot) org"), ("call plus four nine one seven two three four five six seven", 3, "plus four nine one seven two three four five six seven")]:
        assert (kind, t.index(span), t.index(span) + len(span)) in pii.find(t)[1]


def test_media(spark, docs, empty):
    rows = {tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in media.digests(media.payload_images(docs, runtime.Workspace(spark))).collect()}
    want = set()
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        feature = f"{media.difference_hash(image)}:{zlib.crc32(media.tile(image)):08x}"
        want.add((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
    assert rows == want
    assert media.digests(media.payload_images(empty, runtime.Workspace(spark))).count() == 0
    image = np.random.default_rng(0).integers(0, 256, (13, 7, 3), dtype=np.uint8)
    for encoded in (media.encode_netpbm(image), media.encode_bmp(image)):
        assert (media.decode(encoded) == image).all()
    assert np.allclose(media.resize(image[:12, :6], 4, 3), image[:12, :6].reshape(4, 3, 3, 2, 3).mean((1, 3)))


def test_media_resize_and_hash_by_brute_force():
    rng = np.random.default_rng(8)
    for shape in ((1, 1), (3, 5), (20, 64), (9, 2)):
        image = rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
        rows, cols = 8, 9
        big = np.kron(image.astype(float), np.ones((rows, cols, 1)))  # each target cell is a whole number of these
        want = big.reshape(rows, shape[0], cols, shape[1], 3).mean((1, 3))
        assert np.allclose(media.resize(image, rows, cols), want)
        grey = np.round(want @ [0.299, 0.587, 0.114], 6)
        bits = "".join("01"[int(grey[i, j] > grey[i, j + 1] + 1e-7)] for i in range(8) for j in range(8))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"
        assert np.load(io.BytesIO(media.tile(image, 4))).shape == (4, 4, 3)


def test_media_forms(spark):
    grey = np.array([[0, 255, 0], [255, 0, 255]], np.uint8)
    same = [b"P1\n# a remark\n3 2\n1 0 1\n0 1 0\n", b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]), b"P2 3 2 1\n0 1 0 1 0 1\n", b"P5 3 2 255\n" + grey.tobytes(), b"P5 3 2 65535\n" + np.array([0, 65535, 0, 65535, 0, 65535], ">u2").tobytes()]
    assert all((media.decode(x) == grey).all() for x in same)
    assert (media.decode(b"P3 2 1 255 1 2 3 4 5 6 ") == [[[1, 2, 3], [4, 5, 6]]]).all()
    palette = bytes([10, 20, 30, 0, 40, 50, 60, 0])
    head = lambda w, h, depth, start: struct.pack("<2sIHHI", b"BM", 0, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, 0, 0, 0, 0, 0)
    assert (media.decode(head(2, 1, 8, 62) + palette + bytes([0, 1, 0, 0])) == [[[30, 20, 10], [60, 50, 40]]]).all()
    assert (media.decode(head(1, -2, 32, 54) + bytes(range(8))) == [[[2, 1, 0]], [[6, 5, 4]]]).all()
    bad = [b"", None, b"P6", b"P5 0 0 255\n", b"P5 3 2 255\nab", b"P5 9999999999 9999999999 255\n", b"P2 1 1 5\n9\n", b"P3 1 1 255\nx y z\n", b"P1 2 2\n1", head(2, 1, 8, 62) + palette + bytes([0, 7, 0, 0]), head(2, 1, 8, 54) + bytes(4), head(9, 9, 24, 54), head(1, 1, 4, 54) + bytes(4), b"GIF89a"]
    df = spark.createDataFrame([(k, x, 5, "mine") for k, x in enumerate([*same, *bad])], "k int, media binary, height int, note string")
    found = {r["k"]: r for r in media.features(df).collect()}
    assert found[0].asDict().keys() == {"k", "media", "note", "height", "width", "tile", "dhash", "error"}
    assert all(found[k]["height"] == 2 and found[k]["error"] is None and found[k]["note"] == "mine" for k in range(len(same)))
    assert all(found[k]["error"] and found[k]["tile"] is None for k in range(len(same), len(found)))
    assert len({r["dhash"] for r in found.values()}) == 2  # one for all forms, and none


def test_decontamination(spark):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    index = decontam.Index(items)
    for t in [*PROSE, *(f"{PROSE[0]} {x} {PROSE[1]}" for _, x in items), "", None]:
        g = decontam.grams(decontam.words(t))
        want = [i for i, x in items if len(decontam.grams(decontam.words(x)) & g) >= 0.8 * len(decontam.grams(decontam.words(x)))]
        assert [r[0] for r in index.leaks(t)] == want
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert decontam.contaminated(df, none).count() == 0 and decontam.clean(df, none).count() == len(ROWS)


@pytest.mark.parametrize(("operator", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, empty, operator, column):
    sf = "/root/testdata/sf0.01"
    labels = runtime.table(spark, sf, "labels")
    found = operator.classify(runtime.table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r[column] for r in found) / len(found) > 0.9
    scored = operator.classify(docs, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert operator.classify(empty, labels).count() == 0


def test_line_pairs_by_rare_shingles(spark):
    import random

    rnd = random.Random(5)
    texts = ["", "ab", "abcdefgh", "abcdefghi", "\u0436" * 9]
    for base in ("".join(rnd.choices("abcdefgh ", k=150)) for _ in range(4)):
        for _ in range(25):
            line = list(base)
            for _ in range(rnd.randint(0, 4)):
                line[rnd.randrange(len(line))] = rnd.choice("xyz\u00e9\u0436")
            texts.append("".join(line))
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(k, k // 2, t) for k, t in enumerate(texts)], "line long, root long, text string")
    got = {(r["a"], r["b"]) for r in lines.sharing_prefixes(rows, runtime.Workspace(spark), 0.8).collect()}
    sets = [lines.shingles(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if a // 2 != b // 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(want) > 20 and want <= got
    assert all(lines.jaccard(texts[a], texts[b]) == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(0, len(texts), 3) for b in range(len(texts)))
    assert lines.sharing_prefixes(rows.limit(0), runtime.Workspace(spark), 0.8).count() == 0


def test_shingle_counts_travel_in_slices(spark, monkeypatch):
    import random

    rnd, tasks = random.Random(11), 6
    rows = [(rnd.choice([-5, -5, -5, 0, 3]), "".join(rnd.choices("abcd", k=400))) for _ in range(150)]
    rows += [(9, "of one root only, in many lines")] * 20 + [(k - 2, "of four roots " * 3) for k in range(4)]
    made = spark.sparkContext.accumulator(0)
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def counted(self, func, *args, **kwargs):
        def run(batches):
            for batch in func(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(self, run, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    for parts in (1, tasks):
        made.value = 0
        rooted = spark.createDataFrame(rows, "root long, text string").repartition(parts)
        count, main = lines.shingle_counts(rooted)
        by_cell = {}
        for root, text in rows:
            for cell in {int(lines._cell(np.array([lines.shingle_id(x)], np.uint64))[0]) for x in lines.shingles(text)}:
                by_cell.setdefault(cell, []).append(root)
        want = {cell: len(roots) for cell, roots in by_cell.items() if len(set(roots)) > 1}
        assert {int(c): int(count[c]) for c in np.flatnonzero(count)} == want and len(want) > 1000
        assert all(main[c] in by_cell[c] for c in want)
        assert all(main[c] == r for c in want for r in set(by_cell[c]) if parts == 1 and by_cell[c].count(r) * 2 > len(by_cell[c]))
        assert made.value <= (parts + 1) * lines.SKETCH_SLICES
    count, main = lines.shingle_counts(rooted.limit(0))
    assert not count.any() and not main.any()


def test_lines_template_with_variants(spark):
    import random

    rnd = random.Random(7)
    texts = []
    for _ in range(12):  # each variant is like its template, but hardly any other variant is
        words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(18)]
        texts += [" ".join(words), *(" ".join([*words[:k], "".join(rnd.choices("qrstuvwxyz", k=7)), *words[k + 1 :]]) for k in range(18) for _ in range(3))]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = lines.brute(rows)
    assert sum(w[1] for w in want.values()) == len(rows) - 12
    got = {r["doc_id"]: (r["n_gone"], hashlib.sha256((r["text_kept"] or "").encode()).hexdigest()) for r in lines.without(spark.createDataFrame(rows, "doc_id long, text string"), runtime.Workspace(spark)).collect()}
    assert got == {d: w[1:] for d, w in want.items()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_decontamination_of_questions_alone(sf):
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    index = decontam.Index(items)
    prose = [w for t in PROSE if len(w := decontam.words(t)) >= 40]
    for k, (item, text) in enumerate(items):
        question = decontam.words(decontam.question_answer(text)[0])
        if len(question) < decontam.WORDS:
            continue
        cut = (len(question) - decontam.WORDS + 1) // 5  # as many shingles less as a leak may have
        for part in (question, question[cut:], question[: len(question) - cut]):
            other = prose[k % len(prose)]
            assert item in [r[0] for r in index.leaks(" ".join([*other[:40], *part, *other[:40]]))]


def test_decontamination_of_short_items():
    index = decontam.Index([(1, "Zebra quantum lantern."), (2, "Where? The harbour of seven old copper lanterns lies here."), (3, PROSE[9])])
    other = " ".join(decontam.words(PROSE[0])[:50])
    assert [(r[0], *r[3:6]) for r in index.leaks(f"{other} zebra quantum lantern {other}")] == [(1, 1.0, 0.0, 1.0)]
    assert index.leaks(f"{other} zebra lantern quantum where {other}") == []  # other order; a short question is no leak in a text
    assert [r[0] for r in index.leaks("Where?")] == [2]
    assert [(r[0], r[5]) for r in index.leaks(f"{other} where the harbour of seven old copper lanterns lies here {other}")] == [(2, 1.0)]


def test_pii_whole_identifiers():
    long = "x" * 10 + " dot " + "y" * 300 + " at ex dot com"
    for t, span in [("аdmin@example.com", "аdmin@example.com"), (f"mail {long} now", long), ("a.b dot c (at) d.e dot fr.", "a.b dot c (at) d.e dot fr"), ("well. dot smith at site dot org", "smith at site dot org")]:
        base, every = pii.find(t)
        assert (0, t.index(span), t.index(span) + len(span)) in every and set(base) <= set(every)
    began = time.time()
    for t in (" " * 300_000, "a at " * 60_000, "x dot " * 60_000, "(" * 200_000, "a@" * 200_000, "+1 " * 100_000, "one " * 100_000):
        pii.find(t)
    assert time.time() - began < 60


def test_pii_recall_of_disguises():
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("bcdfghklmnprstvw", k=3)) + "".join(rnd.choices("aeiou", k=2))
    spelled = "zero one two three four five six seven eight nine".split()
    alike = str.maketrans("aeopc", "\u0430\u0435\u043e\u0440\u0441")
    wide = lambda x: "".join(chr(ord(c) + 0xFEE0) for c in x)

    def luhn(digits):
        return digits + next(c for c in "0123456789" if pii._luhn(digits + c))

    found = total = 0
    for _ in range(200):
        user, site = f"{word()}.{word()}", f"{word()}.com"
        digits = "".join(rnd.choices("0123456789", k=11))
        card = luhn("4" + "".join(rnd.choices("0123456789", k=14)))
        ip = [str(rnd.randrange(256)) for _ in range(4)]
        for kind, span in [
            (0, f"{user}@{site}".translate(alike)), (0, f"{user.replace('.', ' dot ')} at {site.replace('.', ' dot ')}"), (0, f"{user} [at] {site.replace('.', ' (dot) ')}"),
            (0, f"{user}@{site}".replace("@", "\u200b@\u200b")), (0, f"{user}{wide('@')}{site}"), (3, "plus " + " ".join(spelled[int(c)] for c in digits)),
            (3, "plus " + " ".join(spelled[int(c)] if k % 2 else c for k, c in enumerate(digits))), (3, "+" + wide(digits)), (2, " ".join(spelled[int(c)] for c in card)), (2, wide(card)), (1, "\u3002".join(ip)),
        ]:
            text = f"{PROSE[rnd.randrange(len(PROSE))][:200]} see {span}, {word()} {word()}"
            at = text.index(span)
            total += 1
            found += any(k == kind and a <= at and b >= at + len(span) for k, a, b in pii.find(text)[1])
    assert found >= 0.9 * total, found / total


def test_pii_numbers_in_words_and_figures():
    for span in ("plus 4 nine 1 seven 0 five 5 one", "plus four 9 one 7 two 0 six 5", "plus 4 9, one 7 0 5 5 1"):
        assert (3, 5, 5 + len(span)) in pii.find(f"call {span} today")[1]
    assert (1, 3, 37) in pii.find("at one punkt 2 punkt three punkt four now")[1]


def test_decontamination_in_shards(spark, monkeypatch):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rng = np.random.default_rng(4)
    docs = [(k, f"{t} {items[k % len(items)][1]}") if k % 3 else (k, t) for k, t in enumerate(PROSE)] + [(900, None), (901, ""), (901, "")]
    long = (10_000, " ".join(f"w{x}" for x in rng.integers(0, 500, 3000)))
    benchmark = spark.createDataFrame([*items, long, (None, "no id"), (7, None)], "item_id long, text string")
    df = spark.createDataFrame([*docs, (902, f"start {long[1]} end")], "doc_id long, text string")
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in decontam.contaminated(df, benchmark).collect())
    one = rows()
    monkeypatch.setattr(decontam, "SHARD_BYTES", 8000)
    monkeypatch.setattr(decontam, "BLOCK", 2)
    assert decontam.shards(benchmark)[1] > 3
    assert rows() == one and (902, 10_000) in {r[:2] for r in one} and {r[-1] for r in one} >= {"both"}
    assert decontam.clean(df, benchmark).count() == df.count() - len({r[0] for r in one})


def test_decontamination_retrieves_what_brute_force_does(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 4)
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"t{x}" for x in (rng.zipf(1.3, n) % 300))
    index = decontam.Index([(k, text(30)) for k in range(120)])  # posting lists of many blocks
    assert max(map(len, index.items.values())) > 10 * decontam.BLOCK
    for _ in range(40):
        found = text(128).split()
        want = {}
        for t in set(found) & set(index.items):
            for e, x in zip(index.items[t], index.impacts[t], strict=True):
                want[e] = want.get(e, 0) + x
        got = dict(index.retrieve(found))
        assert got.keys() == {e for e, x in want.items() if x >= index.threshold - 1e-9}
        assert all(abs(got[e] - want[e]) < 1e-9 for e in got)
