"""Results that depend on a key's history, where windows and aggregates can tell them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import Order, order, ordinal
from ..session import col
from .stream import Op


def classify_claims(key: Column, payload: Column, o: Order) -> Op:
    """``claim`` of each call without expiry: ``passthrough`` (no key), ``executed`` (the key's first), ``replayed`` (same payload) or ``conflict``."""

    def op(df: DataFrame) -> DataFrame:
        # calls without a key, often many, take no part in the window
        with_key = df.withColumn("__k", F.nullif(key, F.lit("")))
        keyed = with_key.where("__k is not null")
        w = Window.partitionBy("__k").orderBy(*[col(c) for c in o.by])
        first = F.first(payload).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        kind = F.when(F.row_number().over(w) == 1, "executed").when(first.eqNullSafe(payload), "replayed").otherwise("conflict")
        return keyed.withColumn("claim", kind).unionByName(with_key.where("__k is null").withColumn("claim", F.lit("passthrough"))).drop("__k")

    return op


def transitions(state: str, allowed: Sequence[tuple[str, str]], o: Order) -> Op:
    """``from_state`` of each row and whether the step was allowed (the first, and staying, always are). A broadcast of the edges is
    not needed: they are a literal of the plan."""
    edges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed])

    def op(df: DataFrame) -> DataFrame:
        before = F.lag(state).over(o.window())
        ok = F.col("from_state").isNull() | (F.col("from_state") == F.col(state)) | F.array_contains(edges, F.struct(F.col("from_state").alias("a"), F.col(state).alias("b")))
        return df.withColumn("from_state", before).withColumn("valid", F.coalesce(ok, F.lit(False)))

    return op


def saga_outcomes(steps: DataFrame, run: str, index: str, success: str, skipped: str, error: str, duration: str, undone: str | None = None) -> DataFrame:
    """One row per run from its step log (one row per step): steps, succeeded, skipped, failed, whether the run succeeded, whether
    it rolled back (it failed and had completed steps to undo, all of which could be), its first failed step and total duration."""
    skip, good = F.coalesce(F.col(skipped), F.lit(False)), F.coalesce(F.col(success), F.lit(False))
    fail = ~good & ~skip
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    out = steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), count(good & ~skip).alias("n_succeeded"), count(skip).alias("n_skipped"), count(fail).alias("n_failed"),
        F.min(F.when(fail, F.col(index))).alias("failed_step"), F.sum(duration).alias("duration"),
        (F.min(F.when(good & ~skip, F.coalesce(F.col(undone), F.lit(False))).cast("int")) == 1 if undone else F.lit(True)).alias("__undone"),
    )
    return out.select("*", (F.col("n_failed") == 0).alias("succeeded"), ((F.col("n_failed") > 0) & (F.col("n_succeeded") > 0) & F.coalesce(F.col("__undone"), F.lit(False))).alias("rolled_back")).drop("__undone")


def fenced(fence: str, o: Order) -> Op:
    """``accepted``: a write's fence is no smaller than any before it on its key."""
    before = F.max(fence).over(o.window().rowsBetween(Window.unboundedPreceding, -1))
    return lambda df: df.withColumn("accepted", before.isNull() | (F.col(fence) >= before))


def attempts(df: DataFrame, keys: Sequence[str], failed: Column, o: Order, max_retry: int) -> DataFrame:
    """Per operation of an attempt log: attempts, those needed up to the first success, and whether retries were exhausted."""
    n = F.row_number().over(o.window())
    return df.withColumn("__n", n).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.min(F.when(~failed, F.col("__n"))).alias("needed"), (F.min(F.when(~failed, F.col("__n"))).isNull() & (F.count(F.lit(1)) > max_retry)).alias("exhausted")
    )


def timers_due(timers: DataFrame, timer_id: str, delay_ns: str, canceled: str, resolution_ns: int, now_ns: int) -> DataFrame:
    """Timers that have fired by ``now_ns``, with ``due_tick`` and their place ``firing``: deadlines are rounded up to whole ticks
    (one at least); within a tick the timer scheduled last fires first."""
    due = F.greatest(F.ceil(F.col(delay_ns) / resolution_ns).cast("bigint"), F.lit(1).cast("bigint"))
    live = timers.withColumn("due_tick", due).where(~F.coalesce(F.col(canceled), F.lit(False))).where(F.col("due_tick") * resolution_ns <= now_ns)
    # one order over many tasks, by ranges of (tick, timer), not by ticks, of which one may hold most timers
    backwards = live.withColumn("__back", -F.col(timer_id))
    return ordinal(backwards, order("due_tick", "__back"), "firing").drop("__back")


def resume_outcome(existing: Mapping[str, Column], requested: Mapping[str, Column], force: Column, reason: Column) -> Column:
    """What resuming an execution gives: ``accepted`` (equal binding), ``conflict`` (changed, not forced), ``validation`` (forced
    without reason, or no valid successor), ``successor``. Both map id, parent, generation, source, input, contract."""
    same = existing["id"].eqNullSafe(requested["id"]) & existing["generation"].eqNullSafe(requested["generation"])
    for k in ("source", "input", "contract"):
        same = same & existing[k].eqNullSafe(requested[k])
    own = requested["id"] == existing["id"]
    next_ = (own & (requested["generation"] > existing["generation"]) & (requested["parent"] == existing["id"])) | (~own & (requested["parent"] == existing["id"]))
    return F.when(same, "accepted").when(~F.coalesce(force, F.lit(False)), "conflict").when(F.coalesce(reason, F.lit("")) == "", "validation").when(F.coalesce(next_, F.lit(False)), "successor").otherwise("validation")
