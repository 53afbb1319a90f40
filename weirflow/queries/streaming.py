"""Queries that run as streams over the events' files; where their SQL twin is that of a batch query, both forms agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import micros
from ..operators import folds
from ..streaming.processors import counted_stream, debounce_stream, distinct_stream, fold_stream
from ..streaming.runs import drained, in_files, read_files
from . import flows, streams
from .streams import HOUR

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


PARTS = 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in files by time, one a micro-batch: state is carried from batch to batch."""
    return read_files(spark, in_files(spark.read.parquet(f"{sf_dir}/events.parquet"), ORDER, PARTS), 1)


def _t():
    return micros(F.col("ts"))


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(fold_stream(_events(spark, sf_dir), folds.throttle_machine(24 * HOUR), KEYS, ORDER, {"t": _t()}))
    return out.where("__go").select("user_id", "event_id")


def stream_batch_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(fold_stream(_events(spark, sf_dir), folds.batch_by_time_machine(4, 12 * HOUR), KEYS, ORDER, {"t": _t()}))
    return out.select("user_id", "event_id", "batch_start", "batch_pos")


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("success", "timeout", "permanent", "timeout", "canceled"))), (F.col("event_id") % 5 + 1).cast("int"))
    out = drained(fold_stream(_events(spark, sf_dir), folds.breaker_machine(2, 12 * HOUR), KEYS, ORDER, {"t": _t(), "out": outcome}))
    return out.select("event_id", "decision", "state", "failures")


def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = folds.bucket_machine(1, 3, 40 * 1_000_000)
    return drained(fold_stream(_events(spark, sf_dir), m, KEYS, ORDER, {"t": F.floor(_t() / 7200).cast("bigint")})).select("event_id", "allowed", "tokens")


def stream_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {"t": _t(), "k": F.when(F.col("event_id") % 11 != 0, F.lit("k")), "p": F.col("event_type"), "f": F.col("event_id") % 5 == 0}
    return drained(fold_stream(_events(spark, sf_dir), folds.idempotency_machine(24 * HOUR), KEYS, ORDER, inputs)).select("event_id", "idempotency")


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and types; which row of a key is kept depends on the arrival, so only the keys are given."""
    return drained(distinct_stream(_events(spark, sf_dir), ["user_id", "event_type"], within=False)).select("user_id", "event_type")


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced events of each user that a newer one follows. (A user's last event waits until event time has passed it.)"""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.timestamp_micros(_t()).alias("at")).withWatermark("at", "1 day")
    out = drained(debounce_stream(e, KEYS, ["at", "event_id"], 12 * HOUR // 1000))
    last = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return out.join(last, ["user_id", "event_id"], "left_anti").select("user_id", "event_id")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.timestamp_micros(_t()))
    out = drained(counted_stream(e, "at", "1 day", "1 day", "event_type"), "complete")
    return out.select(F.unix_micros(F.col("window.start")).alias("start_us"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_throttle, stream_batch_by_time, stream_breaker, stream_token_bucket, stream_idempotency, stream_distinct, stream_debounce, stream_window_counts)}

SQL = {
    "stream_throttle": streams.SQL["throttle_evt"],
    "stream_batch_by_time": streams.SQL["batch_by_time_evt"],
    "stream_breaker": flows.SQL["breaker_fold"],
    "stream_token_bucket": flows.SQL["token_bucket_fold"],
    "stream_idempotency": flows.SQL["idempotency_ttl"],
    "stream_debounce": f"select user_id, event_id from (select user_id, event_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as gap from events) where gap >= {12 * HOUR}",
    "stream_distinct": "select distinct user_id, event_type from events",
    "stream_window_counts": "select epoch_us(date_trunc('day', ts)) as start_us, event_type, count(*) as n from events group by 1, 2",
}
