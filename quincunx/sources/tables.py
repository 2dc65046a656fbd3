"""Inputs: transactions and vectors derived from the driver's tables, payload JSON, reference files, configuration, stored indexes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as c
from ..functions import columns as f

PAYLOAD = (
    "id STRING, transaction STRUCT<amount: DOUBLE, installments: INT, requested_at: STRING>, "
    "customer STRUCT<avg_amount: DOUBLE, tx_count_24h: INT, known_merchants: ARRAY<STRING>, km_from_home: DOUBLE>, merchant STRUCT<id: STRING, mcc: STRING, avg_amount: DOUBLE>, "
    "terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: DOUBLE>, last_transaction STRUCT<timestamp: STRING, km_from_current: DOUBLE>, "
    "amount DOUBLE, installments INT, requested_at STRING, is_online BOOLEAN, card_present BOOLEAN"
)
FIELDS = ["amount", "installments", "requested_at", "customer_avg", "tx_count_24h", "known_merchants", "merchant_id", "mcc", "merchant_avg", "is_online", "card_present", "km_from_home", "last_timestamp", "km_from_current"]
MOST_BYTES = 4096
MCC_CYCLE = [*c.MCC_RISK, "6011", "54"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction for each event."""
    e, k = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    user = F.col("user_id")
    base = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        (F.col("value") * 20).alias("amount"),
        (e % 13).alias("installments"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("requested_at"),
        F.when(user % 17 == 0, 0.0).otherwise(40.0 + (user % 40) * 5).alias("customer_avg"),
        (e % 25).alias("tx_count_24h"),
        F.array(*[F.concat(F.lit("MERC-"), ((user + n) % 10).cast("string")) for n in (0, 3, 7)]).alias("known_merchants"),
        F.concat(F.lit("MERC-"), (k % 10).cast("string")).alias("merchant_id"),
        F.element_at(F.array(*map(F.lit, MCC_CYCLE)), (e % 12).cast("int") + 1).alias("mcc"),
        (20.0 + k * 3).alias("merchant_avg"),
        F.col("event_type").isin("click", "view", "error").alias("is_online"),
        (e % 3 == 0).alias("card_present"),
        ((e * 37) % 1200).cast("double").alias("km_from_home"),
        ((e * 13) % 900).cast("double").alias("km_from_current"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        "ts",
    )
    return base.withColumn("last_timestamp", F.lag("requested_at").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).drop("ts")


def vectors(t: DataFrame) -> DataFrame:
    """event_id, label, f (features), q and h (fixed-point at 1e4 and 1e8)."""
    kept = [x for x in ("event_id", "label") if x in t.columns]
    v = t.select(*kept, f.vector14().alias("f"))
    return v.select("*", f.whole(F.col("f"), c.SCALE).alias("q"), f.whole(F.col("f"), c.FINE).alias("h"))


def tx_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(tx(spark, sf_dir))


def references(v: DataFrame) -> DataFrame:
    return v.where(F.col("event_id") % 5 != 0)


def asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("event_id") % 50 == 0)


def emb14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (the first 14 components), q (at 1e4), label (parity)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, c.DIM), lambda x: x.cast("double")).alias("v"), (F.col("label") % 2).cast("int").alias("label"))
    return v.select("*", f.whole(F.col("v"), c.SCALE).alias("q"))


def payload(t: DataFrame, flat: bool = False) -> DataFrame:
    """event_id and body: each transaction as JSON, nested or flat."""
    last = F.when(F.col("last_timestamp").isNotNull(), F.struct(F.col("last_timestamp").alias("timestamp"), "km_from_current"))
    merchant = F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount"))
    if flat:
        body = F.struct("amount", "installments", "requested_at", "is_online", "card_present", F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", "km_from_home", "known_merchants").alias("customer"), merchant.alias("merchant"), last.alias("last_transaction"))
    else:
        body = F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.struct("amount", "installments", "requested_at").alias("transaction"),
            F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
            merchant.alias("merchant"),
            F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
            last.alias("last_transaction"),
        )
    kept = ["event_id", "label"] if "label" in t.columns else ["event_id"]
    return t.select(*kept, F.to_json(body).alias("body"))


def parse(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The columns of a transaction from its JSON, whatever the order of keys and either shape; valid: is it JSON of an allowed size?

    Other columns stay. A malformed, empty or oversized body has nulls.
    """
    p = F.from_json(F.col(body), PAYLOAD, {"mode": "PERMISSIVE"})
    rows = bodies.withColumn("_p", F.when(F.octet_length(F.col(body)).between(1, MOST_BYTES), p))
    either = lambda a, b: F.coalesce(F.col(f"_p.{a}"), F.col(f"_p.{b}"))
    cols = {
        "amount": either("transaction.amount", "amount"),
        "installments": either("transaction.installments", "installments"),
        "requested_at": either("transaction.requested_at", "requested_at"),
        "customer_avg": F.col("_p.customer.avg_amount"),
        "tx_count_24h": F.col("_p.customer.tx_count_24h"),
        "known_merchants": F.slice("_p.customer.known_merchants", 1, c.KNOWN_MERCHANTS),
        "merchant_id": F.col("_p.merchant.id"),
        "mcc": F.col("_p.merchant.mcc"),
        "merchant_avg": F.col("_p.merchant.avg_amount"),
        "is_online": either("terminal.is_online", "is_online"),
        "card_present": either("terminal.card_present", "card_present"),
        "km_from_home": either("terminal.km_from_home", "customer.km_from_home"),
        "last_timestamp": F.col("_p.last_transaction.timestamp"),
        "km_from_current": F.col("_p.last_transaction.km_from_current"),
    }
    some = F.coalesce(*[F.col(f"_p.{x}").isNotNull().cast("int") for x in ("amount",)]) + sum(F.col(f"_p.{x}").isNotNull().cast("int") for x in ("transaction", "customer", "merchant", "terminal"))
    return rows.select(*[x for x in bodies.columns], *[v.alias(k) for k, v in cols.items()], (F.coalesce(some, F.lit(0)) > 0).alias("valid"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share; a local one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quincunx-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {vector, label}, one a file: id (place), vector, label (1 for fraud) and q, as longs."""
    rows = spark.read.schema("vector ARRAY<FLOAT>, label STRING").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("id"), "vector", F.when(F.col("label") == "fraud", 1).otherwise(0).alias("label"), f.quantize("vector").cast("array<bigint>").alias("q"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Files of {entries: [{request, expected_approved, expected_fraud_score}]}: entry (place), body (the request's JSON) and what is expected."""
    entry = "STRUCT<request: STRING, expected_approved: BOOLEAN, expected_fraud_score: DOUBLE>"
    files = spark.read.schema(f"entries ARRAY<{entry}>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = files.select(F.explode("entries").alias("e")).select(F.monotonically_increasing_id().alias("entry"), "e.*")
    return rows.withColumnRenamed("request", "body")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Load-test results, results-round-N.json each: round, p99 (milliseconds), errors, score."""
    kind = "p99 STRING, scoring STRUCT<breakdown: STRUCT<http_errors: INT>, final_score: DOUBLE>"
    rows = spark.read.schema(kind).option("multiLine", True).json(f"{path}/results-round-*.json")
    number = F.regexp_extract("_metadata.file_path", r"results-round-(\d+)\.json", 1).cast("int")
    return rows.select(number.alias("round"), F.regexp_replace("p99", "ms$", "").try_cast("double").alias("p99"), F.col("scoring.breakdown.http_errors").alias("errors"), F.col("scoring.final_score").alias("score"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Lines `key number` of cgroup-round-N-{before,after}/SERVICE.txt: round, phase, service, key, value."""
    lines = spark.read.text(f"{path}/cgroup-round-*-*/*.txt")
    at = lambda k: F.regexp_extract("_metadata.file_path", r"cgroup-round-(\d+)-(before|after)/([^/]+)\.txt", k)
    parts = F.split(F.trim("value"), " +")
    rows = lines.select(at(1).cast("int").alias("round"), at(2).alias("phase"), at(3).alias("service"), parts[0].alias("key"), F.get(parts, F.lit(1)).try_cast("long").alias("value"), F.size(parts).alias("n"))
    return rows.where(F.col("key").rlike("^[A-Za-z_.]+$") & (F.col("n") == 2) & F.col("value").isNotNull()).drop("n")


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """round, service, key, delta: after less before; what one of them lacks counts as 0."""
    signed = F.when(F.col("phase") == "after", F.col("value")).otherwise(-F.col("value"))
    return snapshots.groupBy("round", "service", "key").agg(F.sum(signed).alias("delta"))


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """event_id and body of n requests: by turns a plain one and one with a last transaction of the day before."""
    kinds = "requested_at string, amount double, installments int, customer_avg double, tx_count_24h int, known_merchants array<string>, merchant_id string, mcc string, merchant_avg double, is_online boolean, card_present boolean, km_from_home double, last_timestamp string, km_from_current double, turn int"
    rows = [
        ("2026-03-02T14:30:00Z", 120.0, 2, 80.0, 1, ["MERC-1", "MERC-2"], "MERC-1", "5411", 60.0, False, True, 4.0, None, None, 0),
        ("2026-03-03T00:05:00Z", 4800.0, 12, 95.0, 17, ["MERC-3"], "MERC-9", "6011", 350.0, True, False, 640.0, "2026-03-02T23:55:00Z", 410.0, 1),
    ]
    both = spark.createDataFrame(rows, kinds)
    turns = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias("turn"))
    return payload(turns.join(F.broadcast(both), "turn").drop("turn"))


def read_risks(spark: SparkSession, path: str) -> DataFrame:
    """mcc and risk from a JSON object; keys that are not four characters are left out."""
    body = spark.read.option("wholetext", True).text(path)
    return body.select(F.explode(F.from_json("value", "map<string,double>")).alias("mcc", "risk")).where(F.length("mcc") == 4)


def read_divisors(spark: SparkSession, path: str) -> dict[str, float]:
    row = spark.read.option("multiLine", True).json(path).first()
    return {k: float(v) for k, v in row.asDict().items()} if row else {}


def risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(c.MCC_RISK.items()), "mcc string, risk double")
