"""SQL for DuckDB: the derived views that the catalogue's queries share."""

from __future__ import annotations

from .. import config as c


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_CYCLE = ", ".join(f"'{m}'" for m in [*c.MCC_RISK, "6011", "54"])
RISK = "CASE substr(mcc, 1, 4) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in c.MCC_RISK.items()) + f" ELSE {c.DEFAULT_RISK} END"
HOUR = "CAST(substr(requested_at, 12, 2) AS INTEGER)"


def minute(x: str) -> str:
    return f"(CAST(substr({x}, 12, 2) AS INTEGER) * 60 + CAST(substr({x}, 15, 2) AS INTEGER))"


WEEKDAY = "(isodow(CAST(substr(requested_at, 1, 10) AS DATE)) - 1)"
SINCE = f"(({minute('requested_at')} - {minute('last_timestamp')} + 1440) % 1440)"
TX = f"""
tx AS (SELECT event_id, user_id, value * 20 AS amount, event_id % 13 AS installments, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS requested_at,
  CASE WHEN user_id % 17 = 0 THEN 0.0::DOUBLE ELSE (40 + (user_id % 40) * 5)::DOUBLE END AS customer_avg, event_id % 25 AS tx_count_24h,
  ['MERC-' || (user_id % 10), 'MERC-' || ((user_id + 3) % 10), 'MERC-' || ((user_id + 7) % 10)] AS known_merchants,
  'MERC-' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10) AS merchant_id, [{_CYCLE}][event_id % 12 + 1] AS mcc,
  (20 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 3)::DOUBLE AS merchant_avg, event_type IN ('click', 'view', 'error') AS is_online, event_id % 3 = 0 AS card_present,
  ((event_id * 37) % 1200)::DOUBLE AS km_from_home, ((event_id * 13) % 900)::DOUBLE AS km_from_current, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
  lag(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_timestamp FROM events)"""
FEATURES = [
    clamp("amount / 10000"),
    clamp("installments / 12"),
    clamp("CASE WHEN customer_avg > 0 THEN amount / CASE WHEN customer_avg > 0 THEN customer_avg ELSE 1 END ELSE 0 END / 10"),
    f"{HOUR} / 23",
    f"{WEEKDAY} / 6",
    f"CASE WHEN last_timestamp IS NULL THEN -1 ELSE {clamp(SINCE + ' / 1440')} END",
    f"CASE WHEN last_timestamp IS NULL THEN -1 ELSE {clamp('km_from_current / 1000')} END",
    clamp("km_from_home / 1000"),
    clamp("tx_count_24h / 20"),
    "CASE WHEN is_online THEN 1 ELSE 0 END",
    "CASE WHEN card_present THEN 1 ELSE 0 END",
    "CASE WHEN list_contains(known_merchants, merchant_id) THEN 0 ELSE 1 END",
    RISK,
    clamp("merchant_avg / 10000"),
]
FEATURES = [f"CAST({x} AS DOUBLE)" for x in FEATURES]


def whole(xs: list[str], scale: int) -> str:
    return "[" + ", ".join(f"CAST(round(CAST({x} AS DOUBLE) * {scale}) AS BIGINT)" for x in xs) + "]"


TX_VEC = f"{TX},\nfv AS MATERIALIZED (SELECT event_id, label, [{', '.join(FEATURES)}] AS f FROM tx),\ntx_vec AS MATERIALIZED (SELECT event_id, label, f, {whole([f'f[{k}]' for k in range(1, 15)], c.SCALE)} AS q, {whole([f'f[{k}]' for k in range(1, 15)], c.FINE)} AS h FROM fv)"
SPLIT = TX_VEC + ",\nrefs AS MATERIALIZED (SELECT event_id AS id, label, q FROM tx_vec WHERE event_id % 5 <> 0),\nqs AS MATERIALIZED (SELECT event_id AS qid, q, h, label AS own FROM tx_vec WHERE event_id % 50 = 0)"
EMB = f"emb AS MATERIALIZED (SELECT vec_id AS id, label % 2 AS label, list_transform(embedding[1:14], lambda x: CAST(x AS DOUBLE)) AS v, {whole([f'embedding[{k}]' for k in range(1, 15)], c.SCALE)} AS q FROM embeddings)"


def l2(a: str, b: str, n: int = c.DIM, times: int = 1) -> str:
    scaled = f" * {times}" if times != 1 else ""
    return "CAST(" + " + ".join(f"({a}[{k}] - {b}[{k}]{scaled}) * ({a}[{k}] - {b}[{k}]{scaled})" for k in range(1, n + 1)) + " AS BIGINT)"


def bins(x: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, CAST(floor({x} * {n} / 10000) AS BIGINT)))"


FLAGS = "(CASE WHEN q[10] > 5000 THEN 1 ELSE 0 END + CASE WHEN q[11] > 5000 THEN 2 ELSE 0 END + CASE WHEN q[12] > 5000 THEN 4 ELSE 0 END)"
LAST = f"(CASE WHEN q[6] < 0 THEN 0 ELSE 1 + {bins('q[6]', 8)} END)"
PARTS = f"{bins('q[1]', 16)} AS a, {bins('q[3]', 8)} AS r, {LAST} AS t, {bins('q[8]', 16)} AS k, {FLAGS} AS g"
KEY = "((((a * 8 + r) * 9 + t) * 16 + k) * 8 + g)"
TOP = "row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= 5"
EMB_CENTROIDS = "cents AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, q AS c FROM (SELECT id, q FROM emb ORDER BY id LIMIT 32) x)"
EMB_ASSIGNED = f"assigned AS MATERIALIZED (SELECT id, label, q, cid, dist FROM (SELECT id, label, q, cid, {l2('q', 'c')} AS dist FROM emb CROSS JOIN cents) x QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cid) = 1)"


def two_tier(quick: int, expanded: int, k: int = 64) -> str:
    """CTEs up to `answer` (qid, first, second, votes) over k centroids."""
    fine = c.FINE // c.SCALE
    return f"""{SPLIT},
cents AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, q AS c FROM (SELECT id, q FROM refs ORDER BY id LIMIT {k}) x),
posts AS MATERIALIZED (SELECT id, label, q, cid FROM (SELECT id, label, q, cid, {l2('q', 'c')} AS d FROM refs CROSS JOIN cents) x QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1),
ranked AS MATERIALIZED (SELECT qid, cid, d, row_number() OVER (PARTITION BY qid ORDER BY d, cid) AS rank FROM (SELECT qid, cid, {l2('h', 'c', times=fine)} AS d FROM qs CROSS JOIN cents) x),
n1 AS (SELECT qid, id, label, dist FROM (SELECT qs.qid, posts.id, posts.label, {l2('qs.h', 'posts.q', times=fine)} AS dist FROM qs JOIN ranked USING (qid) JOIN posts USING (cid) WHERE rank <= {quick}) x QUALIFY {TOP}),
v1 AS (SELECT qid, CAST(coalesce(sum(label), 0) AS BIGINT) AS first FROM qs LEFT JOIN n1 USING (qid) GROUP BY qid),
n2 AS (SELECT qid, id, label, dist FROM (SELECT qs.qid, posts.id, posts.label, {l2('qs.q', 'posts.q')} AS dist FROM qs JOIN ranked USING (qid) JOIN posts USING (cid) WHERE rank <= {expanded}) x QUALIFY {TOP}),
v2 AS (SELECT qid, CAST(coalesce(sum(label), 0) AS BIGINT) AS second FROM qs LEFT JOIN n2 USING (qid) GROUP BY qid),
answer AS MATERIALIZED (SELECT qid, first, CASE WHEN first IN (2, 3) THEN second END AS second, CASE WHEN first IN (2, 3) THEN second ELSE first END AS votes FROM v1 JOIN v2 USING (qid)),
brute AS (SELECT qid, CAST(coalesce(sum(label), 0) AS BIGINT) AS expected FROM (SELECT qid, id, refs.label, {l2('qs.q', 'refs.q')} AS dist FROM qs CROSS JOIN refs QUALIFY {TOP}) x GROUP BY qid)"""


QUOTAS = f"""sizes AS (SELECT CAST({KEY} AS BIGINT) + CASE WHEN label = 1 THEN 1048576 ELSE 0 END AS stratum, CAST(count(*) AS BIGINT) AS n FROM (SELECT label, {PARTS} FROM tx_vec) x GROUP BY 1),
shares AS (SELECT stratum, n, least(2000, sum(n) OVER ()) AS size, sum(n) OVER () AS total FROM sizes),
floors AS (SELECT *, (size * n) // total AS base, size * n - ((size * n) // total) * total AS rest FROM shares),
quotas AS (SELECT stratum, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, stratum) <= size - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM floors)"""
