"""The corpus pipeline, stage by stage and as a whole, against plain Python; components and models against plain loops."""

import os
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from quincunx.llm import components, decontam, lines, pieces, quality, runtime, simhash, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_gone", "_rid", "text_kept", "root"]


@pytest.fixture(scope="module")
def tables_dir(spark, tmp_path_factory):
    """Documents with copies, near copies, leaks, nulls and repeated rows, and columns whose names operators might use."""
    top = str(tmp_path_factory.mktemp("tables"))
    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet' order by item_id").fetchall()
    good = [r for r in rows if r[1] and len(r[1].split()) > 60][:12]
    more = []
    for k, r in enumerate(good[:4]):
        more += [(9000 + k, r[1]), (9010 + k, " ".join([*r[1].split()[:-1], "changed"])), (9020 + k, r[1].replace("\n", " ", 1) + "\nOne more line at the end of it all.")]
    more += [(9100 + k, f"{good[5 + k][1]}\n{items[k][1]}") for k in range(4)]
    more += [(9200, None), (9201, ""), (None, good[8][1] + " tail"), (None, None), (9202, " \n\t "), (9000, good[0][1]), (9203, "word " * 30_000)]
    rows += [(d, t, "en", "x", len(t) if t is not None else None) for d, t in more]
    docs = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string, _rid int, text_kept string, root int")
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    os.symlink(f"{SF}/labels.parquet", f"{top}/labels.parquet")
    return top


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_quality(spark, table, top):
    model = quality.fit(runtime.table(spark, top, "documents"), runtime.table(spark, top, "labels"))
    return [r for r in table if model.score(quality.stats(r[1])[None])[0] >= 0.5]


def plain_lines(table):
    """By line components over the distinct (doc_id, text) rows; ties between rows of one id by their hash are not compared."""
    found = {}
    distinct = sorted({r[:2] for r in table}, key=str)
    where = {}
    for d, t in distinct:
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip():
                where.setdefault(line, []).append((d is None, d or 0, pos))
    names = list(where)
    sets = [lines.shingles(x) for x in names]
    group = list(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for g, name in zip(group, names, strict=True):
        first[g] = min([first.get(g, (True, 1 << 62, 0)), *where[name]])
    stays = {name: first[g] for g, name in zip(group, names, strict=True)}
    for d, t in distinct:
        parts = (t or "").split("\n")
        kept = [x for pos, x in enumerate(parts) if not x.strip() or stays[x] == (d is None, d or 0, pos)]
        found[d, t] = (len(parts) - len(kept), "\n".join(kept))
    out = []
    for r in table:
        n, text = found[r[:2]]
        if n == 0:
            out.append(r)
        elif text.strip():
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def plain_near(table):
    prints = [simhash.fingerprint(r[1], 5) for r in table]
    group = list(range(len(table)))
    for a in range(len(table)):
        for b in range(a):
            if group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                group = [group[b] if g == group[a] else g for g in group]
    low = {}
    for g, r in zip(group, table, strict=True):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    gone = {r[0] for g, r in zip(group, table, strict=True) if r[0] is not None and r[0] != low[g]}
    return [r for r in table if r[0] not in gone]


def plain_clean(table, items):
    out = []
    for r in table:
        whole = decontam.grams(decontam.words(r[1]))
        leaked = False
        for _, text in items:
            for part in (text, decontam.question_answer(text)[0]):
                own = decontam.grams(decontam.words(part))
                leaked |= bool(own) and len(decontam.words(part)) >= 5 and len(own & whole) >= 0.8 * len(own)
        if not leaked:
            out.append(r)
    return out


def test_pipeline_stage_by_stage(spark, tables_dir):
    items = [tuple(r) for r in runtime.table(spark, tables_dir, "benchmark").collect()]
    docs = runtime.table(spark, tables_dir, "documents")
    plain = [tuple(r) for r in docs.collect()]
    makers = {"quality": lambda t: plain_quality(spark, t, tables_dir), "line_dedup": plain_lines, "near_dedup": plain_near, "decontaminate": lambda t: plain_clean(t, items)}
    work = runtime.Workspace(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.put(stage(spark, docs, tables_dir), name)
        plain = makers[name](plain)
        assert docs.columns == COLUMNS
        assert rows(docs) == sorted(plain, key=str), name
    kept = {r[0] for r in plain}
    assert 9200 not in kept or any(r[0] == 9200 and r[1] is None for r in plain)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    last = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, tables_dir).collect():
        last.setdefault(r["doc_id"], []).append((r["ids"], r["exact"], r["ids_crc32"]))
    want = {}
    for r in plain:
        ids = library.encode(r[1] or "")
        want.setdefault(r[0], []).append((ids, True, zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in last.items()} == {k: sorted(v) for k, v in want.items()}
    whole = corpus_pipeline.run(spark, tables_dir)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in whole.collect()) == sorted((k or -1, x[2]) for k, v in want.items() for x in v)


def test_stages_on_chosen_rows(spark, tables_dir):
    """Without the classifier, so that every planted case reaches the later stages."""
    items = [tuple(r) for r in runtime.table(spark, tables_dir, "benchmark").collect()]
    docs = runtime.table(spark, tables_dir, "documents")
    plain = [tuple(r) for r in docs.collect()]
    assert rows(simhash.one_of_each(docs)) == sorted(plain_near(plain), key=str)
    assert {9000, 9001, 9002, 9003}.isdisjoint(r[0] for r in plain_near(plain))
    assert rows(decontam.clean(docs, runtime.table(spark, tables_dir, "benchmark"))) == sorted(plain_clean(plain, items), key=str)
    assert {9100, 9101, 9102, 9103}.isdisjoint(r[0] for r in plain_clean(plain, items))
    some = [r for r in plain if r[0] is None or r[0] >= 9000 or r[0] < 60]
    df = spark.createDataFrame(some, docs.schema)
    assert rows(lines.deduplicated(df)) == sorted(plain_lines(some), key=str)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables_dir).count() == 0, name


def test_components_against_plain_unions(spark):
    import random

    rnd = random.Random(2)
    for n, m, hub in ((0, 0, 0), (30, 20, 0), (60, 45, 25), (40, 0, 39)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(0, k + 1) for k in range(hub)] + [(100 + k, 101 + k) for k in range(9)] * bool(n)
        group = {x: x for e in edges for x in e if e[0] != e[1]}
        for a, b in edges:
            if a != b:
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
        df = spark.createDataFrame([*edges, (None, 3), (5, 5)] if edges else [], "a long, b long")
        assert dict(map(tuple, components.components(df, runtime.Workspace(spark)).collect())) == group


def test_components_by_steps_and_on_the_driver(spark, monkeypatch):
    """Both ways give the same; a small list takes few jobs, a list above the bound never comes to the driver."""
    rng = np.random.default_rng(4)
    ends = rng.integers(-(2**62), 2**62, 300)
    pairs = [(int(ends[i]), int(ends[j])) for i, j in rng.integers(0, 300, (220, 2))] + [(int(ends[k]), int(ends[k + 1])) for k in range(40)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    tracker, found, jobs = spark.sparkContext.statusTracker(), [], []
    for k, bound in enumerate((components.FEW_EDGES, len(set(pairs)), 0)):
        monkeypatch.setattr(components, "FEW_EDGES", bound)
        if not bound:
            monkeypatch.setattr(components, "joined", None)
        spark.sparkContext.setJobGroup(f"components-{k}", "")
        found.append(sorted(map(tuple, components.components(df, runtime.Workspace(spark)).collect())))
        jobs.append(len(tracker.getJobIdsForGroup(f"components-{k}")))
    spark.sparkContext.setJobGroup("others", "")
    assert found[0] == found[1] == found[2] and len(found[0]) > 200
    assert jobs[0] <= 10 < jobs[2]


def test_known_components_take_more_edges_both_ways(spark, monkeypatch):
    work = runtime.Workspace(spark)
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)], [(3, 11), (11, 10), (40, 41), (21, 40), (2, 1)]
    known = work.put(components.components(spark.createDataFrame(first, "a long, b long"), work, "first"), "known")
    edges = spark.createDataFrame(more, "a long, b long")
    want = {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 40: 20, 41: 20, 30: 30, 31: 30}
    for k, bound in enumerate((lines.FEW_EDGES, 0)):
        monkeypatch.setattr(lines, "FEW_EDGES", bound)
        monkeypatch.setattr(components, "FEW_EDGES", bound)
        assert sorted(map(tuple, lines.extended(known, edges, work, f"more-{k}").collect())) == sorted(want.items())


def test_hot_keys_can_be_split(spark, tmp_path):
    """One node with very many neighbours: the join that brings its least neighbour back is split."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        for k, v in zip(kept, ("4k", "2k", "-1", "1.5"), strict=True):
            spark.conf.set(k, v)
        work = runtime.Workspace(spark)
        edges = spark.range(1, 40_000).repartition(20).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("a"))
        at = work.put(edges.union(spark.range(50_000, 52_000).select((F.col("id") - 1).alias("b"), F.col("id").alias("a"))), "edges")
        both = at.select("a", "b").union(at.select("b", "a"))
        low = work.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "low")
        joined = both.join(low, both.a == low.u)
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "isSkewJoin=true" in joined._jdf.queryExecution().executedPlan().toString() or "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_trees_against_plain_loops():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 6)), rng.integers(0, 2, 300).astype(float)
    y[x[:, 2] > 0.3] = 1
    model = quality.grow(x, y, trees=7, depth=3)
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > threshold[at])
            total += value[at - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    # The first split: the best gain over all columns and thresholds, by plain sums.
    p = 1 / (1 + np.exp(-model.base))
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda j, t: sum(g[m].sum() ** 2 / (h[m].sum() + 2) for m in (x[:, j] <= t, x[:, j] > t))
    edges = {j: np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])) for j in range(6)}
    best = max(gain(j, t) for j, e in edges.items() for t in e)
    assert abs(gain(model.feature[0, 0], model.threshold[0, 0]) - best) < 1e-9


def test_toxicity_buckets_and_ratios(spark):
    text = "Ab  c\nd"
    folded = " ab c d "
    codes = [ord(c) for c in folded]
    want = []
    for n in toxicity.ORDERS:
        for k in range(len(codes) - n + 1):
            rolled = 0
            for c in codes[k : k + n]:
                rolled = (rolled * 0x9E3779B1 + c) % 2**32
            mixed = ((rolled ^ (rolled >> 15)) * (0x85EBCA6B + 2 * n)) % 2**32
            want.append((mixed ^ (mixed >> 13)) >> (32 - toxicity.BUCKET_BITS))
    assert sorted(toxicity.buckets(text).tolist()) == sorted(want)
    assert len(toxicity.buckets("")) == len(toxicity.buckets(None)) == 0
    texts = [(k, ("you nasty fool " if k % 3 == 0 else "a kind word ") + f"number {k}") for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, features=50)
    seen = [(set(toxicity.buckets(t).tolist()), k % 3 == 0) for k, t in texts if zlib.crc32(str(k).encode()) % 4 != 2]
    n1 = sum(y for _, y in seen)
    n0 = len(seen) - n1
    sure = {}
    for b in {b for s, _ in seen for b in s}:
        t1, t0 = sum(b in s for s, y in seen if y), sum(b in s for s, y in seen if not y)
        if t0 + t1 >= 4:
            ratio = np.log((1 + t1) / (n1 + 2)) - np.log((1 + t0) / (n0 + 2))
            sure[b] = abs(ratio) / np.sqrt(1 / (1 + t1) + 1 / (1 + t0))
    least = sorted(sure.values())[-50]
    assert set(model.bucket.tolist()) <= {b for b, x in sure.items() if x >= least - 1e-9} and len(model.bucket) == 50


def test_toxicity_recall_and_precision(spark):
    """These tables call some clean and junk documents toxic, which no text shows: about a fifth of the label."""
    sf = "/root/testdata/sf0.1"
    labels = runtime.table(spark, sf, "labels")
    found = toxicity.classify(runtime.table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 == r["toxic"] for r in found)
    assert hit >= 0.75 * sum(r["toxic"] for r in found) and hit >= 0.95 * sum(r["predicted"] for r in found) > 0


def test_words_of_lines_counted(spark):
    texts = ["", "a\n\nb", " \n\t\n", "x", "\nlast  \n y", None, "\u00a0\n\u3000 \x1c\nz\u2003", "\u200b\n\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r["n"] for r in df.select("k", lines.line_count(F.col("text")).alias("n")).orderBy("k").collect()] == [len([x for x in re.split("\n", t or "") if x.strip()]) for t in texts]
