"""Queries p4 and p6 over action_events."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.values import clean_id, go_duration_ns
from weirflow.operators.feature_table import distinct_records
from weirflow.queries.dealt import GO_DURATION_SQL, RECORD, RECORDS_SQL, sql_id
from weirflow.session import table

from .distinct import P, estimated, merge_sketches, rollup, sketch, std_error
from .percentiles import merge, multi_select, states

#: Median and high percentiles, in per mille.
PERMILLE = (500, 900, 950, 990)
#: Leading bits of a duration that are kept: an error of at most 2^-9 (0.2 %).
BITS = 9



def duration_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, action, kind, bin, n): what is kept of each day. Each record counts once; records without a duration are left out;
    no action or kind is a null key; records without time have a null day."""
    df = table(spark, sf_dir, "action_events")
    ns = F.coalesce(F.col("duration_ns"), go_duration_ns(F.col("duration")))
    keep = {"day": F.to_date(F.col("time").cast("timestamp_ntz")), "action": clean_id(F.col("action")), "kind": clean_id(F.col("kind")), "ns": ns}
    return states(distinct_records(df, keep, **RECORD), ["day", "action", "kind"], "ns", BITS)


def _levels(day_states: DataFrame) -> DataFrame:
    """States of each action, each kind and each pair, combined over the days; rows without the key in question are left out."""
    pair = merge(day_states, ["action", "kind"])
    null = F.lit(None).cast("string")
    level = lambda name, a, k: F.struct(F.lit(name).alias("level"), a.alias("action"), k.alias("kind"))
    a, k = F.col("action"), F.col("kind")
    levels = F.explode(F.array(level("action+kind", a, k), level("action", a, null), level("kind", null, k)))
    wanted = F.expr("case l.level when 'action' then l.action is not null when 'kind' then l.kind is not null else l.action is not null and l.kind is not null end")
    return merge(pair.select(levels.alias("l"), "bin", "n").where(wanted).select("l.*", "bin", "n"), ["level", "action", "kind"])


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the duration of each action, kind and pair, over all days; within 2^-9 of the exact value."""
    picked = multi_select(_levels(duration_states(spark, sf_dir)), ["level", "action", "kind"], PERMILLE)
    return picked.groupBy("level", "action", "kind").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("permille") == q, F.col("value"))).alias(f"p{q}_ns") for q in PERMILLE])


def p4_daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each day, to be combined later."""
    return duration_states(spark, sf_dir)


def p4_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per month and action: another combination of the same daily states."""
    d = duration_states(spark, sf_dir).where("day is not null and action is not null").withColumn("month", F.date_format("day", "yyyy-MM"))
    picked = multi_select(merge(d, ["month", "action"]), ["month", "action"], PERMILLE)
    return picked.groupBy("month", "action").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("permille") == q, F.col("value"))).alias(f"p{q}_ns") for q in PERMILLE])


def _id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "action_events")
    ids = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), clean_id(F.col(c)).alias("id")) for c in ("user_id", "request_id")]))
    return df.select(F.to_date(F.col("time").cast("timestamp_ntz")).alias("day"), clean_id(F.col("tenant_id")).alias("tenant_id"), clean_id(F.col("action")).alias("action"), ids.alias("x")).select("day", "tenant_id", "action", "x.*")


def p6_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and requests of each day, tenant, action and combination of these, with the mergeable sketch. Repeated
    deliveries do not matter to a distinct count."""
    dims = ["day", "tenant_id", "action"]
    finest = sketch(_id_rows(spark, sf_dir), [*dims, "field"], "id")
    return estimated(rollup(finest, dims, ["field"])).withColumn("rel_std_error", F.lit(std_error(P)))


def p6_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and requests per week and tenant, combined from the stored sketches of the days."""
    daily = sketch(_id_rows(spark, sf_dir).where("day is not null and tenant_id is not null"), ["day", "tenant_id", "field"], "id")
    return estimated(merge_sketches(daily.withColumn("week", F.trunc("day", "week")), ["week", "tenant_id", "field"])).drop("sketch")


def p6_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per combination and field: groups, and how many of their estimates differ from the exact count by more than six standard errors (and one)."""
    dims = ["day", "tenant_id", "action"]
    rows = _id_rows(spark, sf_dir).where("id is not null")
    got = estimated(rollup(sketch(rows, [*dims, "field"], "id"), dims, ["field"])).select("level", *dims, "field", "estimate")
    combos = [c for n in (3, 2, 1) for c in itertools.combinations(dims, n)]
    # identifiers once per finest group, then once per group of each combination; no group's identifiers meet in one task
    level = lambda c: F.struct(F.lit("+".join(c)).alias("level"), *[F.col(d) if d in c else F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dims])
    each = rows.distinct().select("field", "id", F.explode(F.array(*[F.when(F.expr(" and ".join(f"{d} is not null" for d in c)), level(c)) for c in combos])).alias("l")).where("l is not null").select("l.*", "field", "id")
    exact = each.distinct().groupBy("level", *dims, "field").agg(F.count(F.lit(1)).alias("exact"))
    same = [got[c].eqNullSafe(exact[c]) for c in ("level", *dims, "field")]
    both = got.join(exact, functools.reduce(lambda a, b: a & b, same), "full").select(F.coalesce(got["level"], exact["level"]).alias("level"), F.coalesce(got["field"], exact["field"]).alias("field"), "estimate", "exact")
    beyond = F.coalesce(F.abs(F.col("estimate") - F.col("exact")) > 6 * std_error(P) * F.col("exact") + 1, F.lit(True))
    return both.groupBy("level", "field").agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(beyond, 1)).alias("n_beyond"))


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_daily_states, p4_by_month, p6_distinct, p6_weeks, p6_within_error)}

_NS = f"(select *, coalesce(duration_ns, {GO_DURATION_SQL.replace('(d)', '(duration)')}) as ns from {RECORDS_SQL})"
_BINS = f"""vals as (select *, case when ns >= 0 then ns else -(ns + 1) end as mag from {_NS} where ns is not null),
cut_ as (select *, greatest(length(bin(mag)) - {BITS}, 0) as dr from vals),
mids as (select *, (mag >> dr << dr) + case when dr > 0 then 1::bigint << (dr - 1) else 0 end as mid from cut_),
bins as (select *, case when ns >= 0 then mid else -mid - 1 end as b from mids)"""
_PICKS = ", ".join(f"max(case when rn = greatest((n * {q} + 999) // 1000, 1) then b end) as p{q}_ns" for q in PERMILLE)

_IDS = ", ".join(f"{sql_id(c)} as {c}" for c in ("tenant_id", "action", "user_id", "request_id"))
_LEVELS = " union all ".join(
    f"select '{'+'.join(c)}' as level, field, count(*) as n_groups, 0::bigint as n_beyond from (select distinct {', '.join(c)}, field from ids where {' and '.join(f'{d} is not null' for d in c)}) group by 1, 2"
    for n in (1, 2, 3)
    for c in itertools.combinations(("day", "tenant_id", "action"), n)
)

SQL = {
    "p6_within_error": f"""with ev as (select cast(time as date) as day, {_IDS} from action_events),
ids as (select day, tenant_id, action, 'user_id' as field from ev where user_id is not null union all select day, tenant_id, action, 'request_id' from ev where request_id is not null)
{_LEVELS}""",
    "p4_percentiles": f"""with {_BINS},
lv as (select 'action' as level, action, null as kind, b from bins where action is not null union all select 'kind', null, kind, b from bins where kind is not null
 union all select 'action+kind', action, kind, b from bins where action is not null and kind is not null),
r as (select *, row_number() over (partition by level, action, kind order by b) rn, count(*) over (partition by level, action, kind) n from lv)
select level, action, kind, any_value(n) as n, {_PICKS} from r group by 1, 2, 3""",
    "p4_daily_states": f"with {_BINS} select cast(time as date) as day, action, kind, b as bin, count(*) as n from bins group by 1, 2, 3, 4",
    "p4_by_month": f"""with {_BINS},
r as (select strftime(time, '%Y-%m') as month, action, b, row_number() over (partition by strftime(time, '%Y-%m'), action order by b) rn, count(*) over (partition by strftime(time, '%Y-%m'), action) n from bins where time is not null and action is not null)
select month, action, any_value(n) as n, {_PICKS} from r group by 1, 2""",
}

