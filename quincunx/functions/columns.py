"""Column functions: features, quantization, distances, grid keys. All stay in generated code; none is a UDF."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c


def clamp01(x: Column) -> Column:
    """0 to 1; null and NaN count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def clamp_int(x: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), x))


def guarded_ratio(amount: Column, average: Column) -> Column:
    """Amount against the customer's average; 0 where there is no average."""
    return F.when(average > 0, amount / average).otherwise(0.0)


def hour(ts: Column) -> Column:
    """By position, whatever the zone suffix says; null for short or odd texts."""
    return F.when(F.length(ts) >= 16, F.substring(ts, 12, 2).try_cast("int"))


def minute_of_day(ts: Column) -> Column:
    return F.when(F.length(ts) >= 16, F.substring(ts, 12, 2).try_cast("int") * 60 + F.substring(ts, 15, 2).try_cast("int"))


def weekday(ts: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.when(F.length(ts) >= 16, F.weekday(F.substring(ts, 1, 10).try_cast("date")))


def minutes_since(now: Column, before: Column) -> Column:
    """Difference of the minutes of the day, around midnight; dates do not count."""
    return F.pmod(minute_of_day(now) - minute_of_day(before), F.lit(1440))


def mcc_risk(mcc: Column) -> Column:
    """By the first four characters; the default where they are not listed."""
    table = F.create_map(*[F.lit(x) for x in chain(*c.MCC_RISK.items())])
    return F.coalesce(F.try_element_at(table, F.substring(mcc, 1, 4)), F.lit(c.DEFAULT_RISK))


def unknown_merchant(merchant: Column, known: Column) -> Column:
    """0 if the merchant is among the first known ones, else 1; without an id 1."""
    found = F.exists(F.coalesce(F.slice(known, 1, c.KNOWN_MERCHANTS), F.array().cast("array<string>")), lambda x: x.eqNullSafe(merchant))
    return F.when(F.coalesce(merchant, F.lit("")) == "", 1).otherwise(1 - found.cast("int"))


def feature_list(t: dict[str, Column] | None = None) -> list[Column]:
    """The 14 features of a transaction, from columns by these names."""
    col = (lambda n: t[n]) if t else F.col
    has_last = minute_of_day(col("last_timestamp")).isNotNull() & minute_of_day(col("requested_at")).isNotNull()
    return [
        clamp01(col("amount") / c.MAX_AMOUNT),
        clamp01(col("installments") / c.MAX_INSTALLMENTS),
        clamp01(guarded_ratio(col("amount"), col("customer_avg")) / c.AMOUNT_VS_AVG),
        F.coalesce(hour(col("requested_at")), F.lit(0)) / 23,
        F.coalesce(weekday(col("requested_at")), F.lit(0)) / 6,
        F.when(has_last, clamp01(minutes_since(col("requested_at"), col("last_timestamp")) / c.MAX_MINUTES)).otherwise(-1.0),
        F.when(has_last, clamp01(col("km_from_current") / c.MAX_KM)).otherwise(-1.0),
        clamp01(col("km_from_home") / c.MAX_KM),
        clamp01(col("tx_count_24h") / c.MAX_TX_COUNT),
        F.coalesce(col("is_online").cast("double"), F.lit(0.0)),
        F.coalesce(col("card_present").cast("double"), F.lit(0.0)),
        unknown_merchant(col("merchant_id"), col("known_merchants")).cast("double"),
        mcc_risk(col("mcc")),
        clamp01(col("merchant_avg") / c.MAX_MERCHANT_AVG),
    ]


def vector14() -> Column:
    return F.array(*feature_list())


def quantize(v: Column) -> Column:
    """Half away from zero to 1/10000, saturated to 16 bits."""
    return F.transform(v, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(x.cast("double") * c.SCALE))).cast("smallint"))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x * 0.0001)


def whole(v: Column, scale: int) -> Column:
    """Fixed-point components as longs. One lambda, so that the expression behind v is not repeated for each of them."""
    return F.transform(v, lambda x: F.round(x.cast("double") * scale).cast("long"))


def l2_sq(a: Column, b: Column, n: int = c.DIM, times: int = 1) -> Column:
    """Squared distance of the first n components; b may be scaled. Written out, so that it runs in generated code."""
    return reduce(add, [(a[k] - b[k] * times) * (a[k] - b[k] * times) for k in range(n)])


def grid_parts(q: Column) -> list[Column]:
    """Amount, ratio, last, km and flag bins of a quantized vector."""

    def bins(k, n):
        return clamp_int(F.floor(q[k] * n / c.SCALE).cast("int"), n - 1)

    flags = reduce(add, [F.when(q[k] > c.SCALE // 2, bit).otherwise(0) for k, bit in ((9, 1), (10, 2), (11, 4))])
    return [bins(0, 16), bins(2, 8), F.when(q[5] < 0, 0).otherwise(1 + bins(5, 8)), bins(7, 16), flags]


def grid_parts_float(v: Column) -> list[Column]:
    """The same bins of a vector that is not quantized: whole parts of scaled components, flags above a half."""

    def bins(k, n):
        return clamp_int((v[k] * n).cast("int"), n - 1)

    flags = reduce(add, [F.when(v[k] > 0.5, bit).otherwise(0) for k, bit in ((9, 1), (10, 2), (11, 4))])
    return [bins(0, 16), bins(2, 8), F.when(v[5] < 0, 0).otherwise(1 + bins(5, 8)), bins(7, 16), flags]


def grid_key(a: Column, r: Column, last: Column, km: Column, flags: Column) -> Column:
    return (((a * 8 + r) * 9 + last) * 16 + km) * 8 + flags


def stratum_key(q: Column, label: Column) -> Column:
    return grid_key(*grid_parts(q)).bitwiseOR(F.when(label == 1, 1 << 20).otherwise(0))


def lcg_mix(key: Column, seed: int = 0) -> Column:
    """A hash that any SQL engine can compute, for samples."""
    return ((key + seed) * F.lit(2654435761)) % F.lit(4294967296)


def byte_class(text: Column) -> Column:
    """A stand-in classifier: length and three bytes, modulo 6."""
    n = F.length(text)
    return F.when(n > 0, (n + F.ascii(text) + 2 * F.ascii(F.substr(text, F.floor(n / 2).cast("int") + 1, F.lit(1))) + 4 * F.ascii(F.substr(text, n, F.lit(1)))) % 6).otherwise(0)


def response(votes: Column) -> Column:
    n = clamp_int(F.coalesce(votes, F.lit(0)), c.NEIGHBOURS)
    return F.struct((n < 3).alias("approved"), (n / c.NEIGHBOURS).alias("fraud_score"))
