"""Dataflow operators on streams with an explicit order. All are plan builders over built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ERROR, FlowError, error, no_error, ok, positive, stop_at_first
from ..order import HOT_ROWS, Order, ordinal
from ..session import col, cut

Op = Callable[[DataFrame], DataFrame]


def map_(**exprs: Column) -> Op:
    """Columns added or replaced, row by row; rows with an error pass unchanged."""
    return lambda df: df.withColumns({n: F.when(ok(df), e).otherwise(col(n)) if ERROR in df.columns and n in df.columns else e for n, e in exprs.items()})


def map_e(name: str, value: Column, failed: Column, o: Order, message: str = "failed") -> Op:
    """A fallible map: rows where ``failed`` holds become errors, and each stream ends with its first one."""

    def op(df: DataFrame) -> DataFrame:
        bad = F.coalesce(failed, F.lit(False))
        now = F.when(bad, error("Internal", message)).otherwise(no_error())
        out = df.withColumn(ERROR, F.coalesce(F.col(ERROR), now) if ERROR in df.columns else now)
        return stop_at_first(out.withColumn(name, F.when(F.col(ERROR).isNull(), value)), o)

    return op


def filter_(condition: Column) -> Op:
    """Rows that meet the condition (null: not met); errors pass."""
    return lambda df: df.where(condition | ~ok(df)) if ERROR in df.columns else df.where(condition)


def flat_map(name: str, items: Column, at: str | None = None) -> Op:
    """One row per element of an array, in order; ``at`` names the element's place. Empty and null arrays give no row."""
    if at is None:
        return lambda df: df.withColumn(name, F.explode(items))
    return lambda df: df.select("*", F.posexplode(items).alias(at, name))


def take(n: int, o: Order) -> Op:
    """The first n rows of each stream that are no errors, and the errors among them; n <= 0: none."""

    def op(df: DataFrame) -> DataFrame:
        if n <= 0:
            return df.limit(0)
        if not o.keys and ERROR not in df.columns:
            return df.orderBy(*[col(c) for c in o.by]).limit(n)  # TakeOrderedAndProject: no full sort
        if ERROR not in df.columns:  # a limit on the rank is applied before the shuffle, too
            return df.withColumn("__n", F.row_number().over(o.window())).where(f"__n <= {n}").drop("__n")
        good = ok(df).cast("int")
        before = F.coalesce(F.sum(good).over(o.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("__n", before).where(f"__n < {n}").drop("__n")

    return op


def last_n(n: int, o: Order) -> Op:
    """The most recent n rows of each stream, oldest first by the order; n <= 0: none."""

    def op(df: DataFrame) -> DataFrame:
        if n <= 0:
            return df.limit(0)
        if not o.keys:
            return df.orderBy(*[col(c).desc() for c in o.by]).limit(n)
        return df.withColumn("__n", F.row_number().over(o.window(descending=True))).where(f"__n <= {n}").drop("__n")

    return op


def _items(o: Order, item: Column) -> Column:
    """The items of a group in the stream's order."""
    return F.transform(F.array_sort(F.collect_list(o.struct(item.alias("_x")))), lambda s: s["_x"])


def batch(size: int, o: Order, item: Column, hot_rows: int | None = HOT_ROWS) -> Op:
    """Chunks of ``size`` consecutive rows of each stream: (keys..., batch, items); the last may be shorter. A chunk is a group
    of its own, so no task holds a whole stream; ``hot_rows`` (see ``ordinal``) spreads the numbering of hot keys, too."""
    positive("size", size)

    def op(df: DataFrame) -> DataFrame:
        numbered = ordinal(stop_at_first(df, o, keep_error=False), o, hot_rows=hot_rows).withColumn("batch", F.floor(F.col("_i") / size))
        return numbered.groupBy(*[col(k) for k in o.keys], "batch").agg(_items(o, item).alias("items"))

    return op


def window(size: int, step: int, o: Order, item: Column, hot_rows: int | None = HOT_ROWS) -> Op:
    """Count windows of ``size`` rows every ``step`` rows: (keys..., window, items). Full windows, then one shorter window if
    anything is left in the buffer at the end - the overlap kept from the last full window counts as left. ``step`` > ``size`` skips rows."""
    positive("size", size)
    positive("step", step)

    def op(df: DataFrame) -> DataFrame:
        rows = cut(ordinal(stop_at_first(df, o, keep_error=False), o, hot_rows=hot_rows))
        keys = [col(k) for k in o.keys]
        total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if o.keys else None
        first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("_i") - size + 1) / step))
        last = F.floor(F.col("_i") / step)
        hit = rows.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        out = hit.groupBy(*keys, "window").agg(_items(o, item).alias("items"))
        # of the windows cut short by the end, only the first is emitted: the one whose forerunner was full
        forerunner = (F.col("window") - 1) * step + size
        if total is not None:
            out = out.join(total, list(o.keys))
        else:
            out = out.withColumn("__n", F.lit(rows.count()))
        return out.where((F.col("window") == 0) | (forerunner <= F.col("__n"))).drop("__n")

    return op


def distinct_by(o: Order, *by: Column) -> Op:
    """The first row, by the order, of each distinct value (within each stream); errors pass. A hot value costs no sort: the first row is found by partial aggregation."""

    def op(df: DataFrame) -> DataFrame:
        row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
        good = df.where(ok(df)) if ERROR in df.columns else df
        first = good.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(o.keys)], *[b.alias(f"__v{i}") for i, b in enumerate(by)]).agg(F.min_by(row, o.struct()).alias("__r"))
        out = first.select(*[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(df.columns)])
        return out.unionByName(df.where(~ok(df))) if ERROR in df.columns else out

    return op


def reduce_(initial: Column, merge: Callable[[Column, Column], Column], o: Order, item: Column, name: str = "result") -> Op:
    """A strict left fold of each stream. Without keys an empty stream gives ``initial``. The items of a stream are held as one array:
    for folds that are sums, minima and the like use ``fold``, which aggregates partially."""

    def op(df: DataFrame) -> DataFrame:
        items = F.coalesce(_items(o, item), F.array())
        return df.groupBy(*[col(k) for k in o.keys]).agg(items.alias("__items")).select(*[col(k) for k in o.keys], F.aggregate("__items", initial, merge).alias(name))

    return op


def fold(initial: Column, agg: Column, combine: Callable[[Column, Column], Column], keys: Sequence[str] = (), name: str = "result") -> Op:
    """A fold whose step is associative: an aggregate of all items, combined with ``initial``; an empty stream gives ``initial``."""
    return lambda df: df.groupBy(*[col(k) for k in keys]).agg(agg.alias("__a")).select(*[col(k) for k in keys], F.coalesce(combine(initial, F.col("__a")), initial).alias(name))


def collect(limit: int | None, o: Order, item: Column, kind: str = "Validation") -> Op:
    """All items of each stream as one array (without keys: one array even for an empty stream). More than ``limit`` items are an
    error, never a part; ``None`` sets no limit, but an array is held by one task."""
    if limit is not None and limit <= 0:
        raise FlowError("BadRequest" if kind == "Forbidden" else kind, "the limit must be positive")

    def op(df: DataFrame) -> DataFrame:
        keys = [col(k) for k in o.keys]
        if limit is None:
            return df.groupBy(*keys).agg(_items(o, item).alias("items"))
        # the count comes first, so an array that is too long is never built
        size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        checked = size.withColumn("__ok", F.when(F.col("__n") <= limit, True).otherwise(F.raise_error(F.lit(f"{kind}: more than {limit} items"))))
        if not o.keys:
            return df.crossJoin(F.broadcast(checked.where("__ok"))).agg(_items(o, item).alias("items"))  # one row
        return df.join(checked.where("__ok").select(*o.keys), list(o.keys)).groupBy(*keys).agg(_items(o, item).alias("items"))

    return op


def ticks(spark: SparkSession, hz: int, n: int) -> DataFrame:
    """The first n fixed steps of 1 s / hz, in nanoseconds: (tick, dt_ns). hz <= 0: none; hz above 10^9 is an error."""
    if hz > 1_000_000_000:
        raise FlowError("Validation", "hz must be at most 1e9")
    return spark.range(0 if hz <= 0 else n).select(F.col("id").alias("tick"), F.lit(1_000_000_000 // max(hz, 1)).cast("bigint").alias("dt_ns"))


def ticks_checked(spark: SparkSession, hz: int, n: int) -> DataFrame:
    if not 1 <= hz <= 1_000_000_000:
        raise FlowError("Validation", "hz must be within 1..1e9")
    return ticks(spark, hz, n)


def ticks_catch_up(elapsed: Column, interval: int, catch_up: int) -> Column:
    """Ticks due after each of an array of elapsed times: time adds up to at most ``catch_up``, whole intervals are emitted, the rest is kept."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("acc"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, dt: Column) -> Column:
        acc = F.least(s["acc"] + dt, F.lit(catch_up).cast("bigint"))
        due = F.floor(acc / interval).cast("bigint")
        return F.struct((acc - due * interval).alias("acc"), F.concat(s["out"], F.array(due)).alias("out"))

    return F.aggregate(elapsed, start, step, lambda s: s["out"])


def debounce(interval_us: int, time_us: Column, o: Order) -> Op:
    """Rows with no newer row of their stream within ``interval_us``; the last row is always kept. Event time."""
    return lambda df: df.withColumn("__next", F.lead(time_us).over(o.window())).where((F.col("__next").isNull()) | (F.col("__next") - time_us >= interval_us)).drop("__next")


def session_of(gap_us: int, time_us: Column, o: Order, name: str = "session") -> Op:
    """Number of the activity session each row of a stream falls into (a gap over ``gap_us`` opens a new one)."""
    w = o.window()
    opens = F.when(time_us - F.lag(time_us).over(w) <= gap_us, 0).otherwise(1)
    return lambda df: df.withColumn("__o", opens).withColumn(name, F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).drop("__o")


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
