"""Stratified samples with proportional quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as f


def strata(v: DataFrame) -> DataFrame:
    return v.withColumn("stratum", f.stratum_key(F.col("q"), F.col("label")))


def counts(v: DataFrame) -> DataFrame:
    return strata(v).groupBy("stratum").agg(F.count("*").alias("n"))


def quotas(sizes: DataFrame, sample: int) -> DataFrame:
    """stratum, n, quota: floors of exact shares, what is left by largest remainder (then size, then key).

    Remainders are exact integers. The ranking is over strata, of which the key's form allows at most 294 912.
    """
    total = sizes.agg(F.sum("n").alias("total"), F.least(F.sum("n"), F.lit(sample)).alias("size"))
    exact = sizes.crossJoin(F.broadcast(total)).withColumn("base", F.floor(F.col("size") * F.col("n") / F.col("total")).cast("long"))
    exact = exact.withColumn("rest", F.col("size") * F.col("n") - F.col("base") * F.col("total"))
    rank = F.row_number().over(W.orderBy(F.desc("rest"), F.desc("n"), "stratum"))
    left = F.col("size") - F.sum("base").over(W.partitionBy())
    return exact.withColumn("rank", rank).withColumn("left", left).select("stratum", "n", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("quota")).where("quota > 0")


def stratified(v: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """Rows of v: of each stratum as many as its quota, by hash order."""
    rows = strata(v)
    wanted = quotas(rows.groupBy("stratum").agg(F.count("*").alias("n")), sample).select("stratum", "quota")
    order = F.row_number().over(W.partitionBy("stratum").orderBy(f.lcg_mix(F.col("event_id"), seed), "event_id"))
    return rows.join(wanted, "stratum").withColumn("rank", order).where(F.col("rank") <= F.col("quota"))


def subset(v: DataFrame, n: int, key: str = "event_id", seed: int = 0) -> DataFrame:
    """n rows without replacement by hash order; all rows if n is not positive."""
    return v if n <= 0 else v.orderBy(f.lcg_mix(F.col(key), seed), key).limit(n)


def with_replacement(v: DataFrame, n: int, key: str = "event_id", seed: int = 0) -> DataFrame:
    """draw (0 to n - 1) and key: n rows drawn independently, each by hash of its number.

    Rows are numbered in order of the key: by the sort's partitions, of which
    one number each comes to the driver, and by their place within them.
    """
    ordered = v.select(key).orderBy(key).select(key, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).persist()
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    total = sum(sizes.values())
    draws = v.sparkSession.range(n).select(F.col("id").alias("draw"))
    if not total:
        return draws.limit(0).join(v.select(key), F.lit(False), "left")
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    first = v.sparkSession.createDataFrame(rows, "part int, first long")  # a row a partition
    numbered = ordered.join(F.broadcast(first), "part").select(key, (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))
    return draws.withColumn("number", f.lcg_mix(F.col("draw"), seed) % total).join(numbered, "number").select("draw", key)
