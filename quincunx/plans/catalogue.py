"""All queries by name: a Spark callable (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as c
from ..functions import columns as f
from ..operators import cluster, sample, score, search, trace
from ..sources import tables
from ..streaming import scorer
from . import files, measures  # noqa: F401  they register their queries
from . import oracle as o
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .registry import emb as _emb
from .registry import emb_assigned as _emb_assigned
from .registry import index as _index
from .registry import r6 as _r6
from .registry import split as _split


# Scans, scalars and parsing.

query("scan_references", f"WITH {o.TX_VEC} SELECT event_id AS id, label, q[1] AS q0, q[6] AS q5, q[13] AS q12 FROM tx_vec WHERE event_id % 5 <> 0")(lambda s, d: tables.references(tables.tx_vec(s, d)).select(F.col("event_id").alias("id"), "label", F.col("q")[0].alias("q0"), F.col("q")[5].alias("q5"), F.col("q")[12].alias("q12")))

query("label_rate", f"WITH {o.TX} SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS positive, round(100.0 * sum(label) / count(*), 6) AS rate FROM tx WHERE event_id % 5 <> 0")(lambda s, d: tables.tx(s, d).where("event_id % 5 <> 0").agg(F.count("*").alias("total"), F.sum("label").alias("positive"), _r6(100.0 * F.sum("label") / F.count("*")).alias("rate")))

_PARSED = f"WITH {o.TX} SELECT event_id, round(amount, 6) AS amount, CAST(installments AS INTEGER) AS installments, requested_at, customer_avg, array_to_string(known_merchants, ',') AS known, merchant_id, mcc, is_online, card_present, km_from_home, last_timestamp, CASE WHEN last_timestamp IS NOT NULL THEN km_from_current END AS km_from_current FROM tx"


def _parsed(bodies: DataFrame) -> DataFrame:
    return tables.parse(bodies).select("event_id", _r6("amount").alias("amount"), "installments", "requested_at", "customer_avg", F.array_join("known_merchants", ",").alias("known"), "merchant_id", "mcc", "is_online", "card_present", "km_from_home", "last_timestamp", "km_from_current")


query("parse_payload_nested", _PARSED)(lambda s, d: _parsed(tables.payload(tables.tx(s, d))))
query("parse_payload_flat", _PARSED)(lambda s, d: _parsed(tables.payload(tables.tx(s, d), flat=True)))


@query("parse_payload_key_order", _PARSED)
def _key_order(s, d):
    """Sections in another order than they are written in."""
    keys = ["last_transaction", "terminal", "merchant", "customer", "transaction", "id"]
    raw = F.from_json("body", "map<string,string>")
    part = lambda k: F.when(F.col("m")[k].isNotNull(), F.concat(F.lit(f'"{k}":'), F.when(F.lit(k == "id"), F.concat(F.lit('"'), F.col("m")[k], F.lit('"'))).otherwise(F.col("m")[k])))
    mixed = tables.payload(tables.tx(s, d)).withColumn("m", raw).select("event_id", F.concat(F.lit("{"), F.concat_ws(",", *[part(k) for k in keys]), F.lit("}")).alias("body"))
    return _parsed(mixed)


_BODIES = [(1, ""), (2, "{"), (3, "[1, 2"), (4, '{"transaction":{"amount":12.5,"installments":3,"requested_at":"2026-03-02T10:15:00Z"}}'), (5, '{"amount":7.0,"is_online":true}'), (6, "null"), (7, '{"transaction":{"amount":1.0},"pad":"' + "x" * 5000 + '"}'), (8, None)]
query("parse_malformed_payloads", "SELECT * FROM (VALUES (1, false, NULL), (2, false, NULL), (3, false, NULL), (4, true, 12.5::DOUBLE), (5, true, 7.0::DOUBLE), (6, false, NULL), (7, false, NULL), (8, false, NULL)) t(event_id, valid, amount)")(lambda s, d: tables.parse(s.createDataFrame(_BODIES, "event_id int, body string")).select("event_id", "valid", "amount"))

query("clamp_scalars", f"WITH {o.TX} SELECT event_id, round({o.clamp('amount / 10000')}, 6) AS amount, round({o.clamp('km_from_home / 1000')}, 6) AS km, CAST(greatest(0, least(7, installments - 3)) AS BIGINT) AS bin FROM tx")(lambda s, d: tables.tx(s, d).select("event_id", _r6(f.clamp01(F.col("amount") / 10000)).alias("amount"), _r6(f.clamp01(F.col("km_from_home") / 1000)).alias("km"), f.clamp_int(F.col("installments") - 3, 7).cast("long").alias("bin")))

query("guarded_ratio", f"WITH {o.TX} SELECT event_id, round(CASE WHEN customer_avg > 0 THEN amount / CASE WHEN customer_avg > 0 THEN customer_avg ELSE 1 END ELSE 0 END, 6) AS ratio FROM tx")(lambda s, d: tables.tx(s, d).select("event_id", _r6(f.guarded_ratio(F.col("amount"), F.col("customer_avg"))).alias("ratio")))

query("time_features", f"WITH {o.TX} SELECT event_id, CAST({o.HOUR} AS INTEGER) AS hour, CAST({o.minute('requested_at')} AS INTEGER) AS minute, CAST({o.WEEKDAY} AS INTEGER) AS weekday, CAST({o.SINCE} AS INTEGER) AS since FROM tx")(lambda s, d: tables.tx(s, d).select("event_id", f.hour(F.col("requested_at")).alias("hour"), f.minute_of_day(F.col("requested_at")).alias("minute"), f.weekday(F.col("requested_at")).alias("weekday"), f.minutes_since(F.col("requested_at"), F.col("last_timestamp")).alias("since")))


@query("mcc_risk_lookup", f"WITH {o.TX} SELECT event_id, mcc, CAST({o.RISK} AS DOUBLE) AS risk FROM tx")
def _mcc(s, d):
    risks = tables.risks(s).withColumnRenamed("mcc", "m")  # ten rows
    return tables.tx(s, d).join(F.broadcast(risks), F.substring("mcc", 1, 4) == F.col("m"), "left").select("event_id", "mcc", F.coalesce("risk", F.lit(c.DEFAULT_RISK)).alias("risk"))


query("unknown_merchant_flag", f"WITH {o.TX} SELECT event_id, CASE WHEN list_contains(known_merchants, merchant_id) THEN 0 ELSE 1 END AS unknown FROM tx")(lambda s, d: tables.tx(s, d).select("event_id", f.unknown_merchant(F.col("merchant_id"), F.col("known_merchants")).alias("unknown")))


def _known(how: str):
    def made(s, d):
        t = tables.tx(s, d)
        known = t.select(F.col("event_id").alias("e"), F.explode("known_merchants").alias("m"))
        return t.join(known, (t.event_id == known.e) & (t.merchant_id == known.m), how).select("event_id", "merchant_id")

    return made


query("known_merchants_semi", f"WITH {o.TX} SELECT event_id, merchant_id FROM tx WHERE list_contains(known_merchants, merchant_id)")(_known("left_semi"))
query("known_merchants_anti", f"WITH {o.TX} SELECT event_id, merchant_id FROM tx WHERE NOT list_contains(known_merchants, merchant_id)")(_known("left_anti"))

query("feature_vector14", f"WITH {o.TX_VEC} SELECT event_id, CAST(p - 1 AS INTEGER) AS pos, round(f[p], 6) AS value FROM tx_vec CROSS JOIN range(1, 15) r(p)")(lambda s, d: tables.tx_vec(s, d).select("event_id", F.posexplode("f").alias("pos", "x")).select("event_id", "pos", _r6("x").alias("value")))

query("quantize_vectors", f"WITH {o.EMB} SELECT id, CAST(p - 1 AS INTEGER) AS pos, CAST(greatest(-32768, least(32767, round(v[p] * 10000))) AS SMALLINT) AS q FROM emb CROSS JOIN range(1, 15) r(p)")(lambda s, d: _emb(s, d).select("id", F.posexplode(f.quantize(F.col("v"))).alias("pos", "q")))

query("dequantize_vectors", f"WITH {o.EMB} SELECT id, CAST(p - 1 AS INTEGER) AS pos, round(round(v[p] * 10000) * 0.0001::DOUBLE, 6) AS x FROM emb CROSS JOIN range(1, 15) r(p)")(lambda s, d: _emb(s, d).select("id", F.posexplode(f.dequantize(f.quantize(F.col("v")))).alias("pos", "y")).select("id", "pos", _r6("y").alias("x")))


def _against_some(s, d, dist):
    """Every vector whose id is divisible by 50 against all vectors; the query set goes to all tasks in parts of bounded size."""
    e = _emb(s, d)
    some = e.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("w"), F.col("q").alias("u"))
    return search.against_all(some, e).select("qid", "id", dist.alias("dist"))


def _against_sql(dist: str) -> str:
    return f"WITH {o.EMB}, asked AS (SELECT id AS qid, v AS w, q AS u FROM emb WHERE id % 50 = 0) SELECT qid, id, {dist} AS dist FROM emb CROSS JOIN asked"


_FLOAT = " + ".join(f"(v[{k}] - w[{k}]) * (v[{k}] - w[{k}])" for k in range(1, 15))
query("l2_float", _against_sql(f"round({_FLOAT}, 6)"))(lambda s, d: _against_some(s, d, _r6(f.l2_sq(F.col("v"), F.col("w")))))
query("l2_int", _against_sql(o.l2("q", "u")))(lambda s, d: _against_some(s, d, f.l2_sq(F.col("q"), F.col("u"))))
query("l2_euclid", _against_sql(f"round(sqrt({_FLOAT}), 6)"))(lambda s, d: _against_some(s, d, _r6(F.sqrt(f.l2_sq(F.col("v"), F.col("w"))))))

query("grid_key", f"WITH {o.TX_VEC} SELECT event_id, CAST({o.KEY} AS BIGINT) AS bucket FROM (SELECT event_id, {o.PARTS} FROM tx_vec) x")(lambda s, d: tables.tx_vec(s, d).select("event_id", f.grid_key(*f.grid_parts(F.col("q"))).cast("long").alias("bucket")))
query("stratum_key", f"WITH {o.TX_VEC} SELECT event_id, CAST({o.KEY} AS BIGINT) + CASE WHEN label = 1 THEN 1048576 ELSE 0 END AS stratum FROM (SELECT event_id, label, {o.PARTS} FROM tx_vec) x")(lambda s, d: sample.strata(tables.tx_vec(s, d)).select("event_id", F.col("stratum").cast("long").alias("stratum")))


@query("bucket_histogram_csr", f"WITH {o.TX_VEC}, n AS (SELECT CAST({o.KEY} AS BIGINT) AS bucket, count(*) AS n FROM (SELECT {o.PARTS} FROM tx_vec) x GROUP BY 1) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) - n AS BIGINT) AS first FROM n")
def _csr(s, d):
    """Counts and their exclusive prefix sums: the running sum is over buckets, of which the key's form allows 147 456."""
    n = tables.tx_vec(s, d).groupBy(f.grid_key(*f.grid_parts(F.col("q"))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("first", F.sum("n").over(W.orderBy("bucket")) - F.col("n"))


_TEXT = "merchant_id || mcc || requested_at"
query("fake_classifier", f"WITH {o.TX} SELECT event_id, CAST((length(t) + ascii(t) + 2 * ascii(substr(t, length(t) // 2 + 1, 1)) + 4 * ascii(substr(t, length(t), 1))) % 6 AS INTEGER) AS votes FROM (SELECT event_id, {_TEXT} AS t FROM tx) x")(lambda s, d: tables.tx(s, d).select("event_id", f.byte_class(F.concat("merchant_id", "mcc", "requested_at")).cast("int").alias("votes")))

# Centroids, assignment, k-means.


def _ranked(k: int):
    def made(s, d):
        e = _emb(s, d)
        return search.ranked_centroids(e.select(F.col("id").alias("qid"), "q"), score.first_references(e, 32), k, fine=False).select("qid", "cid", "dist", "rank")

    return made


def _ranked_sql(k: int) -> str:
    return f"WITH {o.EMB}, {o.EMB_CENTROIDS} SELECT qid, CAST(cid AS INTEGER) AS cid, dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM (SELECT id AS qid, cid, {o.l2('q', 'c')} AS dist FROM emb CROSS JOIN cents) x) y WHERE rank <= {k}"


query("centroid_topk8", _ranked_sql(8))(_ranked(8))
query("centroid_topk20", _ranked_sql(20))(_ranked(20))

_GAP = "SELECT qid, d7 - d6 AS gap, round(CASE WHEN d6 = 0 THEN 9999 ELSE d7 / d6 END, 6) AS ratio FROM (SELECT qid, max(CASE WHEN rank = 6 THEN dist END) AS d6, max(CASE WHEN rank = 7 THEN dist END) AS d7 FROM ({}) z GROUP BY qid) w"


def _gaps(ranked: DataFrame) -> DataFrame:
    both = ranked.groupBy("qid").agg(F.max(F.when(F.col("rank") == 6, F.col("dist"))).alias("d6"), F.max(F.when(F.col("rank") == 7, F.col("dist"))).alias("d7"))
    return both.select("qid", (F.col("d7") - F.col("d6")).alias("gap"), _r6(F.when(F.col("d6") == 0, 9999.0).otherwise(F.col("d7") / F.when(F.col("d6") == 0, 1).otherwise(F.col("d6")))).alias("ratio"))


query("centroid_gap", _GAP.format(_ranked_sql(8)))(lambda s, d: _gaps(_ranked(8)(s, d)))

_ASSIGNED = f"WITH {o.EMB}, {o.EMB_CENTROIDS}, {o.EMB_ASSIGNED}"
query("assign_nearest", f"{_ASSIGNED} SELECT id, CAST(cid AS INTEGER) AS cid, dist FROM assigned")(lambda s, d: _emb_assigned(s, d)[1].select("id", "cid", "dist"))

query("centroid_update", f"{_ASSIGNED} SELECT CAST(cid AS INTEGER) AS cid, CAST(p - 1 AS INTEGER) AS pos, round(avg(q[p]), 6) AS mean FROM assigned CROSS JOIN range(1, 15) r(p) GROUP BY ALL")(lambda s, d: _emb_assigned(s, d)[1].select("cid", F.posexplode("q").alias("pos", "x")).groupBy("cid", "pos").agg(_r6(F.avg("x")).alias("mean")))

_NEW = f"new AS MATERIALIZED (SELECT cents.cid, [{', '.join(f'coalesce(CAST(round(avg(a.q[{k}])) AS BIGINT), any_value(c[{k}]))' for k in range(1, 15))}] AS c FROM cents LEFT JOIN assigned a ON a.cid = cents.cid GROUP BY cents.cid)"


@query("lloyd_changed_count", f"{_ASSIGNED}, {_NEW}, again AS (SELECT id, cid FROM (SELECT id, cid, {o.l2('q', 'c')} AS dist FROM emb CROSS JOIN new) x QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cid) = 1) SELECT count(*) AS points, CAST(sum(CASE WHEN a.cid <> b.cid THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM assigned a JOIN again b USING (id)")
def _changed(s, d):
    cents, assigned = _emb_assigned(s, d)
    new = cluster.update(assigned, cents)
    return search.assign(assigned.withColumnRenamed("cid", "old").drop("dist"), new).agg(F.count("*").alias("points"), F.sum((F.col("cid") != F.col("old")).cast("long")).alias("changed"))


query("cluster_postings", f"{_ASSIGNED} SELECT id, CAST(cid AS INTEGER) AS cid, CAST(pos AS INTEGER) AS pos, CAST(pos // 16 AS INTEGER) AS block, CAST(pos % 16 AS INTEGER) AS slot FROM (SELECT id, cid, row_number() OVER (PARTITION BY cid ORDER BY dist, id) - 1 AS pos FROM assigned) x")(lambda s, d: cluster.postings(_emb_assigned(s, d)[1]).select("id", "cid", "pos", "block", "slot"))

query("block_offsets", f"{_ASSIGNED}, n AS (SELECT cid, count(*) AS n, CAST(ceil(count(*) / 16) AS BIGINT) AS blocks FROM assigned GROUP BY cid) SELECT CAST(cid AS INTEGER) AS cid, n, blocks, CAST(sum(blocks) OVER (ORDER BY cid) - blocks AS BIGINT) AS first_block FROM n")(lambda s, d: cluster.block_offsets(_emb_assigned(s, d)[1]))

query("wcss", f"{_ASSIGNED} SELECT round(sum(dist / 1e8::DOUBLE), 6) AS wcss FROM assigned")(lambda s, d: cluster.wcss(_emb_assigned(s, d)[1]).select(_r6("wcss").alias("wcss")))

_SIL = f"""{_ASSIGNED}, sub AS (SELECT id, q, cid FROM assigned ORDER BY id LIMIT 400),
each1 AS (SELECT a.id, a.cid, b.cid AS ocid, avg(sqrt(CAST({o.l2('a.q', 'b.q')} AS DOUBLE)) / 10000) AS d FROM sub a JOIN sub b ON a.id <> b.id GROUP BY ALL),
per AS (SELECT id, coalesce(max(CASE WHEN cid = ocid THEN d END), 0) AS a, min(CASE WHEN cid <> ocid THEN d END) AS b FROM each1 GROUP BY id)
SELECT round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM per"""
query("silhouette", _SIL)(lambda s, d: cluster.silhouette(_emb_assigned(s, d)[1].orderBy("id").limit(400).select("id", "q", "cid")).select(_r6("silhouette").alias("silhouette")))

query("cluster_stats", f"{_ASSIGNED}, n AS (SELECT count(*) AS n FROM assigned GROUP BY cid) SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size FROM n")(lambda s, d: cluster.stats(_emb_assigned(s, d)[1]).withColumn("mean_size", _r6("mean_size")))


@query("kmeans_fit")
def _fit(s, d):
    cents, _, _ = cluster.fit(_emb(s, d).select("id", "q"), 16, 10)
    return cents.select("cid", F.posexplode("c").alias("pos", "component"))


query("k_sweep")(lambda s, d: cluster.sweep(_emb(s, d).select("id", "q"), cluster.split_ks("8, 16"), 6, 200))

# Search, votes, scores.

query("knn5_exact", f"WITH v AS (SELECT vec_id, {o.whole([f'embedding[{k}]' for k in range(1, 65)], c.SCALE)} AS q FROM embeddings) SELECT qid, id, dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {o.l2('a.q', 'b.q', 64)} AS dist FROM v a CROSS JOIN v b WHERE a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id) x) y WHERE rank <= 5")(
    lambda s, d: _knn64(s, d)
)


def _knn64(s, d):
    v = tables.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), f.whole(F.col("embedding"), c.SCALE).alias("q"), F.lit(0).alias("label"))
    asked = v.where("id % 25 = 0").select(F.col("id").alias("qid"), "q")
    found = search.first_per(search.against_all(asked.withColumnRenamed("q", "a"), v).where("qid <> id").select("qid", "id", f.l2_sq(F.col("a"), F.col("q"), 64).alias("dist")), "qid", ["dist", "id"], 5)
    return found.select("qid", "id", "dist", "rank")


_BRUTE = f"WITH {o.SPLIT}, n AS (SELECT qid, id, refs.label, {o.l2('qs.q', 'refs.q')} AS dist FROM qs CROSS JOIN refs QUALIFY {o.TOP})"
query("brute_force_votes", f"{_BRUTE} SELECT qid, CAST(sum(label) AS BIGINT) AS votes FROM n GROUP BY qid")(lambda s, d: (lambda r, q: search.votes(q, search.exact(q, r)))(*_split(s, d)))

_TIERS = o.two_tier(8, 20)
query("ivf_probe_candidates", f"WITH {_TIERS} SELECT qid, count(*) AS candidates FROM ranked JOIN posts USING (cid) WHERE rank <= 8 GROUP BY qid")(lambda s, d: (lambda ce, po, q: search.ranked_centroids(q, ce, 8).join(po.groupBy("cid").agg(F.count("*").alias("n")), "cid").groupBy("qid").agg(F.sum("n").alias("candidates")))(*_index(s, d)))


def _blocks(ranked: DataFrame, postings: DataFrame) -> DataFrame:
    return ranked.join(cluster.block_offsets(postings).select("cid", "blocks"), "cid")


query("probe_block_count", f"WITH {_TIERS}, b AS (SELECT cid, CAST(ceil(count(*) / 16) AS BIGINT) AS blocks FROM posts GROUP BY cid) SELECT qid, CAST(sum(CASE WHEN rank <= 8 THEN blocks ELSE 0 END) AS BIGINT) AS quick_blocks, CAST(sum(blocks) AS BIGINT) AS all_blocks FROM ranked JOIN b USING (cid) WHERE rank <= 20 GROUP BY qid")(
    lambda s, d: (lambda ce, po, q: _blocks(search.ranked_centroids(q, ce, 20), po).groupBy("qid").agg(F.sum(F.when(F.col("rank") <= 8, F.col("blocks")).otherwise(0)).alias("quick_blocks"), F.sum("blocks").alias("all_blocks")))(*_index(s, d))
)
query("knn5_ivf", f"WITH {_TIERS} SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM n1")(lambda s, d: (lambda ce, po, q: search.probe(q, search.ranked_centroids(q, ce, 8), po, True).select("qid", "id", "dist", "rank"))(*_index(s, d)))
query("fraud_votes_quick", f"WITH {_TIERS} SELECT qid, first AS votes FROM v1")(lambda s, d: (lambda ce, po, q: search.votes(q, search.probe(q, search.ranked_centroids(q, ce, 8), po, True)))(*_index(s, d)))


def _tiers(quick: int, expanded: int):
    def made(s, d):
        cents, postings, q = _index(s, d)
        return search.two_tier(q, cents, postings, quick, expanded)

    return made


query("fraud_votes_two_tier", f"WITH {_TIERS} SELECT qid, first, second, votes FROM answer")(lambda s, d: _tiers(8, 20)(s, d).select("qid", "first", "second", "votes"))
query("two_tier_observable", f"WITH {o.two_tier(1, 4)} SELECT qid, first, second, votes FROM answer")(lambda s, d: _tiers(1, 4)(s, d).select("qid", "first", "second", "votes"))

_GRID = f"""WITH {o.SPLIT}, posts AS MATERIALIZED (SELECT id, label, q, CAST({o.KEY} AS BIGINT) AS bucket FROM (SELECT id, label, q, {o.PARTS} FROM refs) x),
qp AS MATERIALIZED (SELECT qid, q, {o.PARTS} FROM qs), pp AS MATERIALIZED (SELECT id, {o.PARTS} FROM refs),
cand AS (SELECT qp.qid, p.id, p.label, p.bucket, 0 AS phase, {o.l2('qp.q', 'p.q')} AS dist FROM qp JOIN pp ON abs(qp.a - pp.a) <= 1 AND abs(qp.r - pp.r) <= 1 AND abs(qp.t - pp.t) <= 1 AND (qp.t > 0 OR pp.t = 0) AND abs(qp.k - pp.k) <= 1 AND qp.g = pp.g JOIN posts p ON p.id = pp.id
  UNION ALL SELECT qp.qid, p.id, p.label, p.bucket, 1, {o.l2('qp.q', 'p.q')} FROM qp JOIN pp ON qp.a = pp.a AND qp.r = pp.r AND qp.t = pp.t AND qp.k = pp.k AND qp.g <> pp.g JOIN posts p ON p.id = pp.id),
short AS (SELECT qid, count(CASE WHEN phase = 0 THEN 1 END) AS main FROM cand GROUP BY qid),
near AS MATERIALIZED (SELECT qid, id, label, dist, phase FROM cand JOIN short USING (qid) WHERE phase = 0 OR main < 5 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, phase, bucket, id) <= 5)"""


def _grid(s, d) -> tuple[DataFrame, DataFrame]:
    refs, q = _split(s, d)
    posts = refs.withColumn("bucket", f.grid_key(*f.grid_parts(F.col("q"))))
    return q, search.grid(q, posts)


query("grid_knn5", f"{_GRID} SELECT qid, CAST(coalesce(sum(label), 0) AS BIGINT) AS votes, count(id) AS found FROM qs LEFT JOIN near USING (qid) GROUP BY qid")(lambda s, d: (lambda q, n: q.select("qid").join(n, "qid", "left").groupBy("qid").agg(F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("votes"), F.count("id").alias("found")))(*_grid(s, d)))
query("grid_knn5_fallback", f"{_GRID} SELECT qid, id, dist FROM near WHERE phase = 1")(lambda s, d: _grid(s, d)[1].where("phase = 1").select("qid", "id", "dist"))

_SCORED = "SELECT qid AS event_id, votes, votes < 3 AS approved, votes / 5 AS fraud_score FROM answer"


@query("fraud_score", f"WITH {_TIERS} {_SCORED}")
def fraud_score(s, d):
    """The flagship: payload JSON in, decision out."""
    cents, postings, _ = _index(s, d)
    return score.classify_payloads(tables.payload(tables.asked(tables.tx(s, d))), cents, postings)


query("fraud_response_json", f"WITH {_TIERS} SELECT event_id, '{{\"approved\":' || approved || ',\"fraud_score\":' || CAST(fraud_score AS DECIMAL(2,1)) || '}}' AS body FROM ({_SCORED}) x")(lambda s, d: fraud_score(s, d).select("event_id", F.to_json(F.struct("approved", "fraud_score")).alias("body")))


@query("stream_fraud_score", f"WITH {_TIERS} {_SCORED}")
def _stream(s, d):
    """The flagship on a stream of payload files, which must equal the batch."""
    cents, postings, _ = _index(s, d)
    top = tables.folder(s, "stream")
    tables.payload(tables.asked(tables.tx(s, d))).select("event_id", "body").repartition(4).write.json(f"{top}/in")
    scorer.start(scorer.read(s, f"{top}/in", 2), cents, postings, f"{top}/out", f"{top}/state").awaitTermination()
    return s.read.parquet(f"{top}/out").drop("batch")


# Samples and evaluation.

query("strata_counts", f"WITH {o.TX_VEC}, {o.QUOTAS} SELECT stratum, n FROM sizes")(lambda s, d: sample.counts(tables.tx_vec(s, d)).select(F.col("stratum").cast("long").alias("stratum"), "n"))
query("strata_quotas", f"WITH {o.TX_VEC}, {o.QUOTAS} SELECT stratum, n, quota FROM quotas WHERE quota > 0")(lambda s, d: sample.quotas(sample.counts(tables.tx_vec(s, d)), 2000).withColumn("stratum", F.col("stratum").cast("long")))
query("stratified_sample", f"WITH {o.TX_VEC}, {o.QUOTAS}, rows1 AS (SELECT event_id, CAST({o.KEY} AS BIGINT) + CASE WHEN label = 1 THEN 1048576 ELSE 0 END AS stratum FROM (SELECT event_id, label, {o.PARTS} FROM tx_vec) x) SELECT event_id, stratum FROM rows1 JOIN quotas USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY (event_id * 2654435761) % 4294967296, event_id) <= quota")(lambda s, d: sample.stratified(tables.tx_vec(s, d), 2000).select("event_id", F.col("stratum").cast("long").alias("stratum")))
query("random_subset", "SELECT event_id FROM events ORDER BY (event_id * 2654435761) % 4294967296, event_id LIMIT 500")(lambda s, d: sample.subset(tables.table(s, d, "events").select("event_id"), 500))


def _judged(s, d, quick: int = 8, expanded: int = 20) -> DataFrame:
    cents, postings, q = _index(s, d)
    refs = postings.select("id", "label", "q")
    return search.two_tier(q, cents, postings, quick, expanded).join(search.votes(q, search.exact(q, refs), "expected"), "qid")


query("decision_accuracy", f"WITH {o.two_tier(1, 4)} SELECT count(*) AS total, CAST(sum(CASE WHEN (votes < 3) <> (expected < 3) THEN 1 ELSE 0 END) AS BIGINT) AS wrong, round(100.0 * sum(CASE WHEN (votes < 3) = (expected < 3) THEN 1 ELSE 0 END) / count(*), 6) AS percent FROM answer JOIN brute USING (qid)")(
    lambda s, d: _judged(s, d, 1, 4).select(((F.col("votes") < 3) != (F.col("expected") < 3)).cast("long").alias("w")).agg(F.count("*").alias("total"), F.sum("w").alias("wrong"), _r6(100.0 * (F.count("*") - F.sum("w")) / F.count("*")).alias("percent"))
)
query("vote_histogram", f"WITH {o.two_tier(1, 4)} SELECT votes, expected, count(*) AS n FROM answer JOIN brute USING (qid) GROUP BY ALL")(lambda s, d: _judged(s, d, 1, 4).groupBy("votes", "expected").agg(F.count("*").alias("n")))

_SWEEP = [(1, 4), (2, 6), (4, 16), (8, 20)]


@query("probe_sweep", " UNION ALL ".join(f"SELECT * FROM (WITH {o.two_tier(a, b)} SELECT {a} AS quick, {b} AS expanded, CAST(sum(CASE WHEN second IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS rescored, CAST(sum(CASE WHEN (votes < 3) <> (expected < 3) THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM answer JOIN brute USING (qid)) t{a}" for a, b in _SWEEP))
def _sweep(s, d):
    cents, postings, q = _index(s, d)
    expected = search.votes(q, search.exact(q, postings.select("id", "label", "q")), "expected").persist()  # every setting is judged by it
    out = None
    for a, b in _SWEEP:
        row = search.two_tier(q, cents, postings, a, b).join(expected, "qid").agg(F.sum((F.col("path") == 2).cast("long")).alias("rescored"), F.sum(((F.col("votes") < 3) != (F.col("expected") < 3)).cast("long")).alias("wrong")).select(F.lit(a).alias("quick"), F.lit(b).alias("expanded"), "rescored", "wrong")
        out = row if out is None else out.union(row)
    return out


_THRESHOLDS = [0, 1_000_000, 5_000_000, 20_000_000, 100_000_000]


@query("gap_threshold_sweep", f"WITH g AS ({_GAP.format(_ranked_sql(8))}) SELECT th AS threshold, CAST(sum(CASE WHEN gap >= th THEN 1 ELSE 0 END) AS BIGINT) AS narrow, count(*) AS total FROM g CROSS JOIN (VALUES {', '.join(f'({t})' for t in _THRESHOLDS)}) v(th) GROUP BY th")
def _gap_sweep(s, d):
    th = s.createDataFrame([(t,) for t in _THRESHOLDS], "threshold int")
    return _gaps(_ranked(8)(s, d)).crossJoin(F.broadcast(th)).groupBy("threshold").agg(F.sum((F.col("gap") >= F.col("threshold")).cast("long")).alias("narrow"), F.count("*").alias("total"))


query("costly_queries", f"WITH {_TIERS}, b AS (SELECT cid, CAST(ceil(count(*) / 16) AS BIGINT) AS blocks FROM posts GROUP BY cid) SELECT qid, CAST(sum(blocks) AS BIGINT) AS blocks FROM ranked JOIN b USING (cid) WHERE rank <= 20 GROUP BY qid ORDER BY 2 DESC, 1 LIMIT 5")(lambda s, d: (lambda ce, po, q: _blocks(search.ranked_centroids(q, ce, 20), po).groupBy("qid").agg(F.sum("blocks").alias("blocks")).orderBy(F.desc("blocks"), "qid").limit(5))(*_index(s, d)))


@query("prune_stage_stats")
def _prune(s, d):
    """How many candidates of the quick tier an early stop after 4, 6, 8 or 14 dimensions would leave, in scan order."""
    cents, postings, q = _index(s, d)
    return trace.prune(q, search.ranked_centroids(q, cents, 8), cluster.postings(postings)).drop("tail")


query("split_k_list", "SELECT k FROM (VALUES (3072), (3584), (4096)) v(k)")(lambda s, d: s.createDataFrame([(" 3072, ,3584,4096 ",)], "ks string").select(F.explode(F.filter(F.transform(F.split("ks", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("k")).select(F.col("k").cast("int").alias("k")))
query("header_values", "SELECT * FROM (VALUES ('Connection: Close', 'Close', true, NULL), ('content-length: 42x', '42x', false, 42)) v(line, value, closes, number)")(
    lambda s, d: s.createDataFrame([("Connection: Close",), ("content-length: 42x",)], "line string").select("line", F.trim(F.substring_index("line", ":", -1)).alias("value"), (F.lower(F.trim(F.substring_index("line", ":", -1))) == "close").alias("closes"), F.regexp_extract(F.trim(F.substring_index("line", ":", -1)), "^[0-9]+", 0).try_cast("int").alias("number"))
)
