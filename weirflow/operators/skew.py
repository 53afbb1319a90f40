"""Equi-join of a side with hot keys to a side with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_to_unique(left: DataFrame, right: DataFrame, key: str, right_key: str, *, hot_rows: int = 200_000, salts: int = 64, rows: int | None = None) -> DataFrame:
    """``left`` left-joined to ``right`` (one row per ``right_key``) on ``key = right_key``.

    Keys with more than ``hot_rows`` rows on the left are salted: their left rows are spread over ``salts`` buckets, their right
    row - and only theirs - is repeated that many times. All other rows keep one bucket, so nothing is repeated without need.
    The table of hot keys has at most ``rows / hot_rows`` rows. If ``left`` is known to have no more than ``hot_rows`` ``rows``, no key
    of it can be hot.
    """
    if rows is not None and rows <= hot_rows:
        return left.join(right, F.col(key) == F.col(right_key), "left")
    hot = left.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(f"__n > {hot_rows} and __hot is not null").select("__hot")
    l = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))).drop("__hot")
    r = right.join(hot, F.col(right_key) == F.col("__hot"), "left")
    r = r.withColumn("__rsalt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("__hot")
    return l.join(r, (F.col(key) == F.col(right_key)) & (F.col("__salt") == F.col("__rsalt")), "left").drop("__salt", "__rsalt")
