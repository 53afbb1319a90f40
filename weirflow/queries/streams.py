"""Queries over the ordered stream operators, on events by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error_class
from ..functions.values import clean_id, micros
from ..operators import folds, stream
from ..order import order, ordinal
from ..plans.stage import compose, distinct_stage, filter_stage, map_stage, take_stage
from ..session import table
from ..sources.readers import from_rows
from .dealt import sql_id

BY_USER = order("ts", "event_id", keys=("user_id",))
WHOLE = order("ts", "event_id")
HOUR = 3_600_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, filter, map, first purchase of each user, ten of them."""
    steps = compose(
        filter_stage("purchases", F.col("event_type") == "purchase"), map_stage("doubled", doubled=F.round(F.col("value") * 2, 4)),
        distinct_stage("first_of_user", WHOLE, "user_id"), take_stage("ten", 10, WHOLE),
    )
    return steps(events(spark, sf_dir)).select("event_id", "user_id", "doubled")


def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.map_(cents=F.round(F.col("value") * 100).cast("bigint"))(events(spark, sf_dir)).select("event_id", "cents")


def filter_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.filter_(F.col("value") > 50)(events(spark, sf_dir)).select("event_id", "event_type")


def mape_stop_at_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.map_e("root", F.round(F.sqrt(F.col("value")), 6), F.col("value") > 180, BY_USER, "too large")(events(spark, sf_dir))
    return out.select("event_id", "root", F.col("_error.kind").alias("error_kind"))


def flatmap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    each = stream.flat_map("word", words)(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # by word and document first: the hot words shrink before the shuffle, and no distinct aggregate is needed
    return each.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("w")).groupBy("word").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.take(25, WHOLE)(events(spark, sf_dir)).select("event_id", "ts")


def take_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.take(3, BY_USER)(events(spark, sf_dir)).select("user_id", "event_id")


def last_n_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.last_n(5, order("ts", "event_id", keys=("event_type",)))(events(spark, sf_dir)).select("event_type", "event_id")


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join("items", ","))


def batch_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(stream.batch(3, BY_USER, F.col("event_id"))(events(spark, sf_dir)))


def batch_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(stream.batch(100, WHOLE, F.col("event_id"))(events(spark, sf_dir)))


def _window(size: int, step: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ids(stream.window(size, step, BY_USER, F.col("event_id"))(events(spark, sf_dir)))

    return query


def ordinal_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal(events(spark, sf_dir), WHOLE).select("event_id", F.col("_i").alias("place"))


def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.distinct_by(WHOLE, F.col("event_type"))(events(spark, sf_dir)).select("event_type", "event_id")


def distinct_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.distinct_by(WHOLE, F.col("user_id"), F.col("event_type"))(events(spark, sf_dir)).select("user_id", "event_type", "event_id")


def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return stream.fold(F.lit(1000).cast("bigint"), F.sum(cents), lambda a, b: a + b, ["event_type"])(events(spark, sf_dir))


def reduce_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that depends on the order: a running hash of each user's ids."""
    f = folds.reduce_in_order(7, lambda acc, x: (acc * 31 + x) % 1_000_003, "bigint", BY_USER, F.col("event_id"))
    return f(events(spark, sf_dir))


def reduce_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.fold(F.lit(42).cast("bigint"), F.sum("event_id"), lambda a, b: a + b)(events(spark, sf_dir).where("value < -1"))


def collect_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(stream.collect(100_000, order("n_nationkey", keys=("n_regionkey",)), F.col("n_name"))(table(spark, sf_dir, "nation")))


def collect_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.collect(None, order("n_nationkey"), F.col("n_name"))(table(spark, sf_dir, "nation").where("n_nationkey < 0")).select(F.size("items").alias("n_items"))


def ticks_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.ticks(spark, 100, 500)


def ticks_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a user's events as elapsed times: whole hours due, at most a day caught up."""
    w = BY_USER.window()
    gaps = events(spark, sf_dir).withColumn("dt", F.coalesce(micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w), F.lit(0)))
    return gaps.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "dt"))).alias("s")).select("user_id", F.array_join(stream.ticks_catch_up(F.col("s.dt"), HOUR, 24 * HOUR), ",").alias("due"))


def throttle_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.throttle(24 * HOUR, micros(F.col("ts")), BY_USER)(events(spark, sf_dir)).select("user_id", "event_id")


def debounce_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.debounce(6 * HOUR, micros(F.col("ts")), BY_USER)(events(spark, sf_dir)).select("user_id", "event_id")


def batch_by_time_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.batch_by_time(4, 12 * HOUR, micros(F.col("ts")), BY_USER)(events(spark, sf_dir)).select("user_id", "event_id", "batch_start", "batch_pos")


def session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.session_of(6 * HOUR, micros(F.col("ts")), BY_USER)(events(spark, sf_dir)).select("event_id", "session")


def from_rows_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(spark, [(3, "c"), (1, "a"), (2, "b")], "value int, name string")


def error_class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of action_events by retry class of the kind they would be reported as."""
    k = clean_id(F.col("kind"))
    kind = F.when(k == "timeout", "Timeout").when(k == "canceled", "Canceled").when(k == "error", "Internal").when(k == "retry", "Unavailable").otherwise("NotFound")
    return table(spark, sf_dir, "action_events").groupBy(error_class(kind).alias("class")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, map_project, filter_pred, mape_stop_at_error, flatmap_words, take_n, take_per_user, last_n_per_type, batch_3, batch_global, ordinal_global, distinct_first, distinct_by_user,
        reduce_sum, reduce_ordered, reduce_empty, collect_bounded, collect_empty, ticks_range, ticks_catch_up, throttle_evt, debounce_evt, batch_by_time_evt, session_numbers, from_rows_ordinal, error_class_count,
    )
}
WINDOWS = {"window_3_2": (3, 2), "window_2_5_gap": (2, 5), "window_3_1_overlap": (3, 1), "window_4_4_tumbling": (4, 4)}
QUERIES |= {name: _window(*args) for name, args in WINDOWS.items()}

_SEQ = "select *, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) i, count(*) over (partition by user_id) n from events"

#: Sequential folds: a recursion along each user's events.
_FOLD = "with recursive e as (" + _SEQ + "), r as ({first} from e where i = 1 union all {next} from r join e on e.user_id = r.user_id and e.i = r.i + 1) "


def fold_sql(first: str, then: str, final: str) -> str:
    return _FOLD.format(first="select e.user_id, e.i, e.event_id, " + first, next="select e.user_id, e.i, e.event_id, " + then) + final


def window_sql(size: int, step: int) -> str:
    return f"""with e as (select *, i - 1 as j from ({_SEQ})),
k as (select user_id, event_id, j, n, unnest(range(greatest(0, cast(ceil((j - {size} + 1) / {step}) as bigint)), cast(floor(j / {step}) as bigint) + 1)) as w from e)
select user_id, w as "window", string_agg(event_id, ',' order by j) as items from k group by user_id, w, n having w = 0 or (w - 1) * {step} + {size} <= n"""


_KIND = sql_id("kind")

SQL = {
    "flagship": "select event_id, user_id, round(value * 2, 4) as doubled from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts, event_id) = 1 order by ts, event_id limit 10",
    "map_project": "select event_id, cast(round(value * 100) as bigint) as cents from events",
    "filter_pred": "select event_id, event_type from events where value > 50",
    "mape_stop_at_error": "select event_id, case when value > 180 then null else round(sqrt(value), 6) end as root, case when value > 180 then 'Internal' end as error_kind from (select *, coalesce(sum(case when value > 180 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as b from events) where b = 0",
    "flatmap_words": "select word, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from documents) where word <> '' group by word",
    "take_n": "select event_id, ts from events order by ts, event_id limit 25",
    "take_per_user": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) <= 3",
    "last_n_per_type": "select event_type, event_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 5",
    "batch_3": f"select user_id, (i - 1) // 3 as batch, string_agg(event_id, ',' order by i) as items from ({_SEQ}) group by 1, 2",
    "batch_global": "select (i - 1) // 100 as batch, string_agg(event_id, ',' order by i) as items from (select *, row_number() over (order by ts, event_id) as i from events) group by 1",
    "ordinal_global": "select event_id, row_number() over (order by ts, event_id) - 1 as place from events",
    "distinct_first": "select event_type, event_id from events qualify row_number() over (partition by event_type order by ts, event_id) = 1",
    "distinct_by_user": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "reduce_sum": "select event_type, cast(1000 + sum(cast(round(value * 100) as bigint)) as bigint) as result from events group by 1",
    "reduce_ordered": fold_sql("(7 * 31 + e.event_id) % 1000003 as result", "(r.result * 31 + e.event_id) % 1000003", "select user_id, last(result order by i) as result from r group by 1"),
    "reduce_empty": "select cast(42 as bigint) as result",
    "collect_bounded": "select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as items from nation group by 1",
    "collect_empty": "select 0 as n_items",
    "ticks_range": "select range as tick, cast(10000000 as bigint) as dt_ns from range(500)",
    "ticks_catch_up": fold_sql(
        f"cast(0 as bigint) as acc, cast(0 as bigint) as due, e.t", f"least(r.acc + e.t - r.t, {24 * HOUR}) % {HOUR}, least(r.acc + e.t - r.t, {24 * HOUR}) // {HOUR}, e.t", "select user_id, string_agg(due, ',' order by i) as due from r group by 1"
    ),
    "throttle_evt": fold_sql("e.t as last, true as go", f"case when e.t - r.last >= {24 * HOUR} then e.t else r.last end, e.t - r.last >= {24 * HOUR}", "select user_id, event_id from r where go"),
    "debounce_evt": f"select user_id, event_id from (select *, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts) as gap from events) where gap is null or gap >= {6 * HOUR}",
    "batch_by_time_evt": fold_sql(
        "e.t as batch_start, 0 as batch_pos", f"case when r.batch_pos >= 3 or e.t >= r.batch_start + {12 * HOUR} then e.t else r.batch_start end, case when r.batch_pos >= 3 or e.t >= r.batch_start + {12 * HOUR} then 0 else r.batch_pos + 1 end",
        "select user_id, event_id, batch_start, batch_pos from r",
    ),
    "session_numbers": f"select event_id, cast(sum(case when g <= {6 * HOUR} then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) - 1 as bigint) as session from (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as g from events)",
    "from_rows_ordinal": "select * from (values (0::bigint, 3, 'c'), (1, 1, 'a'), (2, 2, 'b')) v(_i, value, name)",
    "error_class_count": f"select case when k in ('timeout', 'retry') then 'transient' when k in ('canceled', 'error') then 'neither' else 'permanent' end as class, count(*) as n from (select {_KIND} as k from action_events) group by 1",
}
SQL |= {name: window_sql(*args) for name, args in WINDOWS.items()}
