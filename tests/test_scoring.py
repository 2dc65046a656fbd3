"""Golden feature vectors, and the catalogue against its SQL on the smallest tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

from quincunx.operators import cluster, search
from quincunx.plans import catalogue
from quincunx.sources import tables

SF = "/root/testdata/sf0.001"

WARM = '{"id":"a","transaction":{"amount":%s,"installments":%d,"requested_at":"%s"},"customer":{"avg_amount":%s,"tx_count_24h":%d,"known_merchants":["MERC-1"]},"merchant":{"id":"MERC-1","mcc":"%s","avg_amount":%s},"terminal":{"is_online":false,"card_present":true,"km_from_home":%s},"last_transaction":%s}'


def vector(spark, body):
    rows = tables.vectors(tables.parse(spark.createDataFrame([(1, body)], "event_id long, body string"))).collect()
    return rows[0]["q"]


def test_features(spark):
    q = vector(spark, WARM % ("385.0", 3, "2026-03-01T20:10:00Z", "77.0", 3, "5411X", "299.0", "13.7", "null"))
    assert q == [385, 2500, 5000, 8696, 10000, -10000, -10000, 137, 1500, 0, 10000, 0, 1500, 299]


def test_midnight_and_defaults(spark):
    q = vector(spark, WARM % ("1e5", 99, "2026-03-02T00:10:00Z", "0", 40, "54A1", "0", "-4", '{"timestamp":"2026-03-01T23:50:00Z","km_from_current":2000.0}'))
    assert q == [10000, 10000, 0, 0, 0, 139, 10000, 0, 10000, 0, 10000, 0, 5000, 0]


def test_oversized_and_bad_bodies(spark):
    rows = catalogue.QUERIES["parse_malformed_payloads"](spark, SF).collect()
    assert {r["event_id"] for r in rows if r["valid"]} == {4, 5}


def test_kmeans_separates(spark):
    points = [(i, [10000 * (i % 3)] * 14) for i in range(60)]
    df = spark.createDataFrame(points, "id long, q array<bigint>")
    centroids, assigned, log = cluster.fit(df, 3, 10)
    assert assigned.agg(F.sum("dist")).first()[0] == 0 and centroids.count() == 3 and log[-1]["changed"] * 1000 < 60


def test_few_neighbours(spark):
    q = spark.createDataFrame([(1, [0] * 14), (2, [30000] * 14)], "qid long, q array<bigint>")
    near = search.exact(q, spark.createDataFrame([(9, 1, [0] * 14)], "id long, label int, q array<bigint>"))
    assert {r["qid"]: r["votes"] for r in search.votes(q, near).collect()} == {1: 1, 2: 1}


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, [i] * 14) for i in range(40)], "id long, label int, q array<bigint>")
    cents = spark.createDataFrame([(0, [0] * 14), (1, [30] * 14)], "cid int, c array<bigint>")
    listed = cluster.postings(search.assign(df, cents))
    cluster.save(cents, listed, str(tmp_path))
    again, back = cluster.load(spark, str(tmp_path))
    assert again.count() == 2 and back.count() == 40 and back.where("cid = 1").count() == listed.where("cid = 1").count()
    with pytest.raises(ValueError):
        spark.createDataFrame([(0, [1])], "cid int, c array<bigint>").write.mode("overwrite").parquet(f"{tmp_path}/centroids")
        cluster.load(spark, str(tmp_path))


def test_probe_in_parts(spark, monkeypatch):
    """Parts of a few rows, ties, a cluster without rows and a query of it alone, against comparing all."""
    monkeypatch.setattr(search, "PART_ROWS", 7)
    monkeypatch.setattr(search, "PART_QUERIES", 3)
    refs = spark.createDataFrame([(i, i % 2, [(i * 7919) % 5 * 100] * 14, i % 3) for i in range(90)], "id long, label int, q array<bigint>, cid int")
    asked = spark.createDataFrame([(i, [i * 40] * 14) for i in range(11)], "qid long, q array<bigint>")
    probes = asked.where("qid < 10").crossJoin(spark.range(3).selectExpr("cast(id as int) cid")).select("qid", "cid").union(spark.createDataFrame([(10, 9)], "qid long, cid int"))
    rows = lambda df: sorted((r["qid"], r["rank"], r["id"], r["label"], r["dist"]) for r in df.collect())
    assert rows(search.probe(asked, probes, refs, False)) == rows(search.exact(asked.where("qid < 10"), refs))
    assert search.probe(asked, probes, refs.where("id < 0"), False).count() == 0


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["parse_payload_flat", "time_features", "grid_key", "centroid_topk8", "cluster_postings", "two_tier_observable", "grid_knn5", "strata_quotas", "stratified_sample", "silhouette"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, SF)
    want = c.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    key = sorted(found.columns)
    names = want.columns
    assert sorted(tuple(_plain(r[k]) for k in key) for r in found.collect()) == sorted(tuple(_plain(dict(zip(names, r, strict=True))[k]) for k in key) for r in want.fetchall())
