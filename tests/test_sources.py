"""File sources, stored indexes, traces and fits against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quincunx.functions import columns as f
from quincunx.operators import cluster, sample, score, search, trace
from quincunx.plans import catalogue
from quincunx.sources import tables

SF = "/root/testdata/sf0.001"


def references(path, n=200, seed=0):
    rng = np.random.default_rng(seed)
    rows = [{"vector": (rng.integers(-10000, 10001, 14) / 10000).tolist(), "label": "fraud" if k % 3 == 0 else "legit"} for k in range(n)]
    path.write_text(json.dumps(rows))
    return rows


def test_read_references(spark, tmp_path):
    rows = references(tmp_path / "a.json")
    read = tables.read_references(spark, str(tmp_path / "a.json")).orderBy("id").collect()
    assert [r["label"] for r in read] == [int(x["label"] == "fraud") for x in rows]
    assert [r["q"] for r in read] == [[round(v * 10000) for v in x["vector"]] for x in rows]


def test_open_index_builds_once(spark, tmp_path):
    references(tmp_path / "a.json")
    path = str(tmp_path / "index")
    cents, listed = cluster.open_index(spark, path, str(tmp_path / "a.json"), k=4, iterations=5)
    assert cents.count() == 4 and listed.count() == 200
    assert listed.groupBy("cid").agg((F.max("pos") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    again = cluster.open_index(spark, path, str(tmp_path / "none.json"))
    assert again[1].count() == 200
    spark.createDataFrame([(0, [1])], "cid int, c array<bigint>").write.mode("overwrite").parquet(f"{path}/centroids")
    assert cluster.open_index(spark, path, str(tmp_path / "a.json"), k=3, iterations=2)[0].count() == 3


def test_evaluation_file(spark, tmp_path):
    entries = [{"request": {"amount": 5.0, "merchant": {"id": "MERC-1"}}, "expected_approved": True, "expected_fraud_score": 0.2}, {"request": {"amount": 1}, "expected_approved": False, "expected_fraud_score": 1.0}]
    (tmp_path / "e.json").write_text(json.dumps({"entries": entries}))
    read = tables.read_evaluation(spark, str(tmp_path / "e.json")).orderBy("entry").collect()
    assert [(json.loads(r["body"]), r["expected_approved"], r["expected_fraud_score"]) for r in read] == [tuple(e.values()) for e in entries]


def test_snapshots_with_missing_counters(spark, tmp_path):
    for phase, lines in (("before", "usage_usec 5\nnr_periods 2\n"), ("after", "usage_usec 9\nnr_throttled 4\ncpu.max=max 5\nmemory\n")):
        (tmp_path / f"cgroup-round-3-{phase}").mkdir()
        (tmp_path / f"cgroup-round-3-{phase}" / "lb.txt").write_text(lines)
    found = {tuple(r) for r in tables.snapshot_deltas(tables.read_snapshots(spark, str(tmp_path))).collect()}
    assert found == {(3, "lb", "usage_usec", 4), (3, "lb", "nr_periods", -2), (3, "lb", "nr_throttled", 4)}


@pytest.mark.parametrize("given", [(8, 20, 8, 20), (0, 0, 1, 1), (8, 50, 8, 32), (40, 50, 32, 32), (25, 20, 20, 20), (-1, -1, 1, 1)])
def test_probe_bounds(given):
    assert search.check_probes(*given[:2]) == given[2:]


def test_nearest_is_exact():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-(10**8), 10**8, (30, 14)), rng.integers(-(10**8), 10**8, (400, 14))
    b[100:200] = b[:100]  # ties
    b[200:230] = a + rng.integers(-1, 2, a.shape)  # distances that the product cannot tell apart
    b[230:260] = a + rng.integers(-1, 2, a.shape)
    row, col, dist = search.nearest(a, b, 5)
    for i in range(len(a)):
        exact = [sum((int(x) - int(y)) ** 2 for x, y in zip(a[i], p, strict=True)) for p in b]
        want = sorted(range(len(b)), key=lambda j: (exact[j], j))[:5]
        assert col[row == i].tolist() == want and dist[row == i].tolist() == [exact[j] for j in want]


@pytest.mark.parametrize("most", [6, 10**4, 10**8])
def test_nearest_by_leaves_is_exact(most):
    """More rows than are compared at once: ties, equal rows, rows one apart, and leaves of which none may be left out."""
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most, (300, 14)), rng.integers(-most, most, (9000, 14))
    b[:300], b[1000:3000] = a, b[5000:7000]
    b[7000:7300] = a + rng.integers(-1, 2, a.shape)
    row, col, dist = search.nearest(a, b, 5)
    assert len(a) * len(b) > search.SMALL and row.tolist() == [i for i in range(len(a)) for _ in range(5)]
    for i in range(len(a)):
        exact = ((a[i] - b) ** 2).sum(1)
        want = np.lexsort((np.arange(len(b)), exact))[:5]
        assert col[5 * i : 5 * i + 5].tolist() == want.tolist() and dist[5 * i : 5 * i + 5].tolist() == exact[want].tolist()


def test_exact_makes_no_pairs(spark):
    """Comparing all must not join queries with references: their product was what took the time."""
    refs = spark.createDataFrame([(i, i % 2, [(i * 7919) % 11 * 100] * 14) for i in range(90)], "id long, label int, q array<bigint>")
    asked = spark.createDataFrame([(i, [i * 40] * 14) for i in range(11)], "qid long, q array<bigint>")
    near = search.exact(asked, refs)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CoGroup" in plan
    want = {q: sorted((14 * (q * 40 - (i * 7919) % 11 * 100) ** 2, i, i % 2) for i in range(90))[:5] for q in range(11)}
    found = {q: [] for q in want}
    for r in near.orderBy("qid", "rank").collect():
        found[r["qid"]].append((r["dist"], r["id"], r["label"]))
    assert found == want


def test_prune_in_parts(spark, monkeypatch):
    """Counts of parts side by side, against the fold over each query's candidates in scan order; candidates are never rows beside a query."""
    monkeypatch.setattr(trace, "PART_ROWS", 7)
    monkeypatch.setattr(trace, "PART_QUERIES", 3)
    rng = np.random.default_rng(2)
    q, a = rng.integers(0, 60, (90, 14)), rng.integers(0, 60, (11, 14))
    listed = spark.createDataFrame([(i % 3, i // 3, q[i].tolist()) for i in range(90)], "cid int, pos int, q array<bigint>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "qid long, q array<bigint>")
    ranked = spark.createDataFrame([(i, (i + n) % 3, n + 1) for i in range(11) for n in range(2)], "qid long, cid int, rank int")
    found = {r["qid"]: r for r in trace.prune(asked, ranked, listed).collect()}
    assert len(found) == 11
    for i, x in enumerate(a):
        order = [j for n in range(2) for j in range((i + n) % 3, 90, 3)]
        pruned, survived, tail = trace.fold(((q[order] - x) ** 2).cumsum(1))
        r = found[i]
        assert [r["scanned"], r["survived"], r["tail"]] == [60, survived, tail] and [r[f"pruned{n}"] for n in trace.STAGES] == list(pruned.values())


def test_grid_makes_no_pairs(spark, monkeypatch):
    """Neighbours by cells in small parts against plain loops over all cells; queries are not joined with rows."""
    monkeypatch.setattr(search, "PART_ROWS", 7)
    monkeypatch.setattr(search, "PART_QUERIES", 3)
    rng = np.random.default_rng(4)
    q = rng.integers(0, 10001, (400, 14))
    q[:, [0, 2, 7]] //= 4
    q[::3, [5, 6]] = -10000
    q[200:250] = q[100:150]  # ties
    rows = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(q)], "id long, label int, q array<bigint>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "q")
    near = search.grid(asked, rows.withColumn("bucket", f.grid_key(*f.grid_parts(F.col("q")))))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan
    cell = lambda x: (min(x[0] * 16 // 10000, 15), min(x[2] * 8 // 10000, 7), 0 if x[5] < 0 else 1 + min(x[5] * 8 // 10000, 7), min(x[7] * 16 // 10000, 15), sum(b for k, b in ((9, 1), (10, 2), (11, 4)) if x[k] > 5000))
    at = [tuple(int(v) for v in cell(x)) for x in q]
    number = lambda x: (((x[0] * 8 + x[1]) * 9 + x[2]) * 16 + x[3]) * 8 + x[4]
    want = []
    for i in range(0, 400, 20):
        a, found = at[i], []
        for j, b in enumerate(at):
            close = a[4] == b[4] and all(abs(x - y) <= 1 for x, y in zip(a[:4], b[:4], strict=True)) and (a[2] > 0 or b[2] == 0)
            if close or (a[:4] == b[:4] and a[4] != b[4]):
                found.append((int(((q[i] - q[j]) ** 2).sum()), 0 if close else 1, number(b), j))
        main = sum(x[1] == 0 for x in found)
        want += [(i, x[3], x[0], x[1]) for x in sorted(x for x in found if x[1] == 0 or main < 5)[:5]]
    assert sorted((r["qid"], r["id"], r["dist"], r["phase"]) for r in near.collect()) == sorted(want)


def test_against_all_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i,) for i in range(30)], "id int")
    few = rows.select(F.col("id").alias("qid")).where("qid % 3 = 0")
    one = sorted(map(tuple, search.against_all(few, rows).select("qid", "id").collect()))
    monkeypatch.setattr(search, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, search.against_all(few, rows).select("qid", "id").collect())) == one and len(one) == 300


def test_two_tier_releases_what_it_keeps(spark):
    refs = spark.createDataFrame([(i, i % 2, [(i * 7919) % 5 * 100] * 14) for i in range(90)], "id long, label int, q array<bigint>")
    cents = score.first_references(refs, 4)
    asked = spark.createDataFrame([(i, [i * 40] * 14, [i * 400000] * 14) for i in range(5)], "qid long, q array<bigint>, h array<bigint>")
    kept = search.Kept()
    assert search.two_tier(asked, cents, search.assign(refs, cents), kept=kept).count() == 5
    frames = list(kept.frames)
    assert len(frames) == 3 and all(f.is_cached for f in frames)
    kept.release()
    assert not kept.frames and not any(f.storageLevel.useMemory for f in frames)


def test_fold_against_plain_loops():
    rng = np.random.default_rng(3)
    for n in (0, 3, 5, 6, 400):
        partial = rng.integers(0, 50, (n, 14)).cumsum(1) if n else np.zeros((0, 14), np.int64)
        best, pruned, tail, survived = [], {4: 0, 6: 0, 8: 0, 14: 0}, [0] * 6, 0
        for row in partial:
            at = next((d for d in range(14) if len(best) == 5 and row[d] >= max(best)), None)
            if at is None:
                survived += 1
                best = [*best, row[13]] if len(best) < 5 else [*sorted(best)[:4], row[13]]
            else:
                stage = next(s for s in pruned if s > at)
                pruned[stage] += 1
                tail[at - 8] += stage == 14
        assert trace.fold(partial) == (pruned, survived, tail)


def test_prune_stage_stats_against_plain_loops(spark):
    rng = np.random.default_rng(9)
    refs = [(i, i % 2, rng.integers(-10000, 10000, 14).tolist(), i % 3) for i in range(120)]
    asked = [(i, rng.integers(-10000, 10000, 14).tolist()) for i in range(4)]
    listed = spark.createDataFrame([(cid, k, q) for cid in range(3) for k, (_, _, q, own) in enumerate([r for r in refs if r[3] == cid])], "cid int, pos int, q array<bigint>")
    ranked = spark.createDataFrame([(i, cid, rank + 1) for i, _ in asked for rank, cid in enumerate([(i + 1) % 3, i % 3])], "qid long, cid int, rank int")
    found = trace.prune(spark.createDataFrame(asked, "qid long, q array<bigint>"), ranked, listed)
    for r in found.collect():
        order = [q for cid in [(r["qid"] + 1) % 3, r["qid"] % 3] for _, _, q, own in refs if own == cid]
        pruned, survived, tail = trace.fold(((np.array(order) - np.array(asked[r["qid"]][1])) ** 2).cumsum(1))
        assert (r["scanned"], r["survived"], r["tail"]) == (len(order), survived, tail) and [r[f"pruned{n}"] for n in pruned] == list(pruned.values())
    total = trace.totals(found).first()
    assert total["scanned"] == 320 and total["tail"].startswith("tx_count_24h=") and len(total["tail"].split()) == 6


def test_fit_step_against_plain_loops(spark):
    rng = np.random.default_rng(12)
    points = rng.integers(-10000, 10000, (150, 14))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, q array<bigint>")
    start = spark.createDataFrame([(k, points[k].tolist()) for k in range(5)], "cid int, c array<bigint>")
    assigned = search.assign(df, start)
    near = [min(range(5), key=lambda k, p=p: (((p - points[k]) ** 2).sum(), k)) for p in points]
    assert [r["cid"] for r in assigned.orderBy("id").collect()] == near
    new = {r["cid"]: r["c"] for r in cluster.update(assigned, start).collect()}
    for k in range(5):
        mean = points[[n == k for n in near]].mean(0)
        assert np.abs(np.array(new[k]) - mean).max() <= 0.5 + 1e-9
    frame = cluster.log_frame(spark, 5, [{"iteration": 1, "changed": 3, "share": 2.0}])
    assert frame.first().asDict() == {"k": 5, "iteration": 1, "changed": 3, "share": 2.0}


def test_draws_of_nothing(spark):
    assert sample.with_replacement(spark.createDataFrame([], "event_id long"), 5).count() == 0
    assert sorted(sample.with_replacement(spark.createDataFrame([(7,)], "event_id long"), 5).collect()) == [(k, 7) for k in range(5)]


@pytest.mark.parametrize("name", ["build_index", "evaluation_file", "snapshot_delta", "round_summary", "two_tier_out_of_range", "sample_with_replacement", "warm_up", "hot_entries", "quick_switch_sweep", "l2_int"])
def test_more_against_sql(spark, name):
    from test_scoring import test_against_sql

    assert name in catalogue.QUERIES
    test_against_sql(spark, name)
