"""Results per key where a few keys hold most rows.

Value-frequency compression: rows are grouped by (key, value) before key, so a hot key is spread over its values and shrinks
to weighted distinct values; counts, exact distinct counts, modes and percentiles then come from the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clean_id
from ..session import col


def unpivot_keys(df: DataFrame, keys: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """(key_field, key_value, extra...) - every row once per key column, in a single scan. Keys are read as ids."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key_field"), clean_id(col(k)).alias("key_value")) for k in keys]))
    extra = extra or {}
    return df.select(pairs.alias("__k"), *[v.alias(k) for k, v in extra.items()]).select("__k.*", *extra)


def compress(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, weight): one row per distinct value with the number of rows that had it."""
    return rows.groupBy(*[col(b) for b in by], col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def profile(weighted: DataFrame, by: Sequence[str]) -> DataFrame:
    """From weighted values, per key: ``n_rows``, ``n_values`` (rows with a value), ``n_distinct``, ``mode`` (ties: the
    smallest value) and ``mode_rows``. Partial aggregation applies to all of it."""
    has = F.col("value").isNotNull()
    return weighted.groupBy(*by).agg(
        F.sum("weight").alias("n_rows"), F.coalesce(F.sum(F.when(has, F.col("weight"))), F.lit(0)).alias("n_values"), F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(has, F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v")))).alias("mode"), F.coalesce(F.max(F.when(has, F.col("weight"))), F.lit(0)).alias("mode_rows"),
    )


def percentiles(weighted: DataFrame, by: Sequence[str], permille: Sequence[int], bits: int = 10) -> DataFrame:
    """Exact percentiles (the smallest value with at least that share of the key's values at or below it) of weighted bigint
    values: (by..., permille, value).

    No task sorts a whole key: totals per (key, range of values) come first - a range being sign, magnitude and ``bits``
    leading bits, so a key has a bounded number of ranges - then only ranges that hold a wanted rank are looked into, each by itself.
    """
    by = list(by)
    v = F.col("value")
    mag = F.when(v >= 0, v).otherwise(F.bitwise_not(v))
    shift = F.greatest(F.length(F.bin(mag)) - bits, F.lit(0))
    head = F.call_function("shiftright", mag, shift) + F.call_function("shiftleft", shift.cast("bigint"), F.lit(40))
    ranged = weighted.where(v.isNotNull()).withColumn("__range", F.when(v >= 0, head).otherwise(-head - 1))
    sums = ranged.groupBy(*by, "__range").agg(F.sum("weight").alias("__w"))
    up = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sums.withColumn("__to", F.sum("__w").over(up)).withColumn("__all", F.sum("__w").over(Window.partitionBy(*by)))
    want = F.explode(F.array(*[F.lit(p) for p in permille])).alias("permille")
    rank = F.expr("(__all * permille + 999) div 1000")
    hit = cum.select(*by, "__range", "__to", "__w", "__all", want).withColumn("__rank", F.greatest(rank, F.lit(1))).where("__rank <= __to and __rank > __to - __w")
    inside = ranged.join(hit.select(*by, "__range", "permille", (F.col("__rank") - (F.col("__to") - F.col("__w"))).alias("__r")), [*by, "__range"])
    run = F.sum("weight").over(Window.partitionBy(*by, "permille").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("__run", run).where("__run >= __r and __run - weight < __r").select(*by, "permille", "value")


def hot_keys(df: DataFrame, keys: Sequence[str], value: str, per_hundred: int) -> DataFrame:
    """Keys that hold at least ``per_hundred`` % of all rows of ``df``: (key_field, key_value, n_rows, n_distinct, mode).

    Rows count as they stand, repeated ones included; rows without a key count in the whole but are no key; the comparison is
    exact (integers). An empty table gives no rows. ``value`` (read as an id) is what spreads each key.
    """
    weighted = compress(unpivot_keys(df, keys, {"__v": clean_id(col(value))}), ["key_field", "key_value"], "__v")
    whole = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return profile(weighted.where("key_value is not null"), ["key_field", "key_value"]).where(F.col("n_rows") * 100 >= whole * per_hundred).select("key_field", "key_value", "n_rows", "n_distinct", "mode")
