"""Queries over composition, stateful operators, sinks and graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions.values import clean_id, micros
from ..operators import compose as k
from ..operators import folds, observe, stateful
from ..operators.feature_table import distinct_records
from ..order import order, ordinal
from ..plans.graph import Builder, layer_table, mermaid_lines, output
from ..session import table
from .dealt import DURATION_SQL, RECORD, RECORDS_SQL, event_duration, sql_id
from .streams import BY_USER, HOUR, WHOLE, events, fold_sql

CENTS = "cast(round(value * 100) as bigint)"


def _t() -> Column:
    return micros(F.col("ts"))


def pipe_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.pipe_with(lambda d: d.where("event_type = 'view'"), [F.col("user_id"), F.expr(CENTS).alias("cents")], lambda d: d.groupBy("user_id").agg(F.sum("cents").alias("cents")))(events(spark, sf_dir))


def chain_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [lambda d: d.withColumn("x", F.expr(CENTS)), lambda d: d.withColumn("x", F.col("x") + 10), lambda d: d.where("x % 2 = 0")]
    return k.chain(*ops)(events(spark, sf_dir)).select("event_id", "x")


def branch_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.branch("out", F.col("event_type"), {"purchase": F.expr(CENTS), "refund": -F.expr(CENTS), "view": F.lit(0).cast("bigint")})(events(spark, sf_dir))
    return out.select("event_id", "out", F.col("_error.kind").alias("error_kind"))


def switch_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.switch("weight", F.col("o_orderpriority"), {"1-URGENT": F.lit(5), "2-HIGH": F.lit(3)}, F.lit(1))(table(spark, sf_dir, "orders")).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


def branch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = k.branch_frames(F.col("o_orderstatus"), {"F": lambda d: d.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("f")), "O": lambda d: d.groupBy("o_custkey").agg(F.max("o_orderkey").alias("n")).withColumn("side", F.lit("o"))})
    return f(table(spark, sf_dir, "orders"))


def ternary_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.ternary("verdict", F.when(F.col("requires_auth"), "true").otherwise("no"), F.lit("guarded"), F.lit("open"))(table(spark, sf_dir, "action_catalog")).select("name", "verdict")


def parallel_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.parallel("r", [F.col("l_quantity"), F.col("l_quantity") * 2, F.round(F.col("l_extendedprice"))])(table(spark, sf_dir, "lineitem"))
    return out.groupBy("l_returnflag").agg(*[F.sum(F.col("r")[i].cast("bigint")).alias(f"b{i}") for i in range(3)])


def parallel_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.parallel_named("r", {"low": F.least("p_size", F.lit(10)), "high": F.greatest("p_size", F.lit(10)), "gone": None})(table(spark, sf_dir, "part"))
    return out.select("p_partkey", F.array_join(F.transform(F.map_entries("r"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("r"))


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.first_success("id", [(F.length(F.trim("user_id")) > 0, F.col("user_id")), (F.length(F.trim("request_id")) > 0, F.col("request_id"))])(table(spark, sf_dir, "action_events"))
    return out.select("line_no", "id", F.col("_error.kind").alias("error_kind"))


def catch_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.catch("n", F.expr("try_cast(get_json_object(props, '$.k') as bigint) is null"), F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.lit(-1).cast("bigint"))(events(spark, sf_dir))
    return out.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))


def loop_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halving (3n+1 on odd numbers) until 1, at most 40 turns."""
    out = k.loop("v", F.col("p_partkey"), lambda v: F.when(v % 2 == 0, F.floor(v / 2)).otherwise(v * 3 + 1).cast("bigint"), lambda v: v == 1, 40)(table(spark, sf_dir, "part"))
    return out.select("p_partkey", "v", "v_turns", F.col("_error.kind").alias("error_kind"))


def round_robin_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.round_robin("slot", F.col("_i"), 7)(ordinal(events(spark, sf_dir), WHOLE)).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def fan_out_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python worker over batches, the order kept by the ids."""
    work = k.worker_pool(lambda b: pd.DataFrame({"event_id": b["event_id"], "out": (b["value"] * 100).round().astype("int64") % 97}), "event_id bigint, out bigint, _error string", workers=4)
    return work(events(spark, sf_dir).select("event_id", "value")).select("event_id", "out")


def race_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request's records, the quickest success; else the quickest failure."""
    rec = table(spark, sf_dir, "action_events").select(clean_id(F.col("request_id")).alias("request_id"), clean_id(F.col("kind")).alias("kind"), event_duration().alias("d")).where("request_id is not null and d is not null")
    return k.race(rec.withColumn("ok", F.col("kind") == "success"), ["request_id"], "kind", "d", "ok")


def dedup_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.compute_once(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], lambda d: d.withColumn("work", F.col("l_partkey") * 31 % 1009))
    return out.groupBy("work").agg(F.count(F.lit(1)).alias("n"))


def idempotency_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls keyed by user and day, the type as payload."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return stateful.classify_claims(key, F.col("event_type"), WHOLE)(events(spark, sf_dir)).select("event_id", "claim")


def idempotency_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = folds.idempotency(24 * HOUR, _t(), F.when(F.col("event_id") % 11 != 0, F.lit("k")), F.col("event_type"), F.col("event_id") % 5 == 0, BY_USER)
    return f(events(spark, sf_dir)).select("event_id", "idempotency")


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.cache_replay(12 * HOUR, _t(), F.col("event_id") % 4 != 0, BY_USER)(events(spark, sf_dir)).select("event_id", "cache")


def cache_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fast layer of six hours before a slow one of two days, by user."""
    return folds.layered_cache([6 * HOUR, 48 * HOUR], _t(), F.col("event_id") % 4 != 0, BY_USER)(events(spark, sf_dir)).select("event_id", "layer")


def breaker_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("success", "timeout", "permanent", "timeout", "canceled"))), (F.col("event_id") % 5 + 1).cast("int"))
    return folds.circuit_breaker(2, 12 * HOUR, _t(), outcome, BY_USER)(events(spark, sf_dir)).select("event_id", "decision", "state", "failures")


def token_bucket_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per second is too much for events hours apart: time is scaled to seconds of an hour."""
    return folds.rate_limit(1, 3, F.floor(_t() / 7200).cast("bigint"), BY_USER, ttl_us=40 * 1_000_000)(events(spark, sf_dir)).select("event_id", "allowed", "tokens")


def concurrency_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.concurrency_limit(1, _t(), _t() + F.expr(CENTS) * 600_000_00, BY_USER)(events(spark, sf_dir)).select("event_id", "allowed")


EDGES = [("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "refund"), ("view", "purchase"), ("refund", "view"), ("signup", "view")]


def state_machine_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.transitions("event_type", EDGES, BY_USER)(events(spark, sf_dir)).select("event_id", "from_state", "valid")


def state_machine_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed: dict[str, set[str]] = {}
    for a, b in EDGES:
        allowed.setdefault(a, set()).add(b)
    return folds.state_machine(allowed, None, F.col("event_type"), BY_USER)(events(spark, sf_dir)).select("event_id", "verdict", "state")


def saga_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "saga_steps").groupBy("saga_run_id", "step_index").agg(F.max("success").alias("success"), F.max("skipped").alias("skipped"), F.max("error").alias("error"), F.max("duration_ms").alias("duration_ms"))
    return stateful.saga_outcomes(steps, "saga_run_id", "step_index", "success", "skipped", "error", "duration_ms")


def fenced_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.fenced("fence", BY_USER)(events(spark, sf_dir).withColumn("fence", F.col("event_id") * 7919 % 1000)).select("event_id", "accepted")


def retry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "action_events")
    keep = {"request_id": clean_id(F.col("request_id")), "kind": clean_id(F.col("kind")), "attempt": F.coalesce("attempt", F.lit(0)), "time": F.col("time")}
    rec = distinct_records(df, keep, **RECORD).where("request_id is not null")
    return rec.groupBy("request_id").agg(F.count(F.lit(1)).alias("records"), F.max("attempt").alias("attempts"), (F.max((F.col("kind") == "success").cast("int")) == 1).alias("succeeded"))


def timer_wheel_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    timers = events(spark, sf_dir).select(F.col("event_id").alias("timer_id"), (F.col("event_id") * 7919 % 100_003).alias("delay_ns"), (F.col("event_id") % 13 == 0).alias("canceled"))
    return stateful.timers_due(timers, "timer_id", "delay_ns", "canceled", 100, 60_000).select("timer_id", "due_tick", "firing")


def resume_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each later generation of an execution as a request to resume its generation 0."""
    e = table(spark, sf_dir, "execution_identities").select(
        clean_id(F.col("execution_id")).alias("id"), clean_id(F.col("parent_execution_id")).alias("parent"), "generation", F.col("source_digest").alias("source"), F.col("input_digest").alias("input"), F.col("contract_digest").alias("contract")
    ).distinct()
    a, b = e.where("generation = 0").alias("a"), e.where("generation > 0").alias("b")
    col = lambda s: {x: F.col(f"{s}.{x}") for x in ("id", "parent", "generation", "source", "input", "contract")}
    j = a.join(b, F.col("a.id") == F.col("b.id"))
    return j.select(F.col("b.id").alias("execution_id"), F.col("b.generation").alias("generation"), stateful.resume_outcome(col("a"), col("b"), F.col("b.generation") < 3, F.lit("rerun")).alias("outcome"))


def metrics_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "action_events").withColumns({"action": clean_id(F.col("action")), "kind": clean_id(F.col("kind"))})
    return observe.metrics(e, "action", "kind", order("line_no"))


def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "action_events").withColumns({"action": clean_id(F.col("action")), "kind": clean_id(F.col("kind"))})
    return observe.prometheus(observe.metrics(e, "action", "kind", order("line_no")))


def jsonl_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "action_events")
    lines = observe.json_lines(e, ["line_no", "kind", "action"], payloads=["request_type"], secrets=["error", "recovered"], time="time")
    return lines.select(F.sha2("line", 256).alias("digest"))


def topic_cursor_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.topic_read(events(spark, sf_dir).select(F.col("event_id").alias("seq"), "event_type"), "seq", 10, 40, 500)


def calls_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most calls of each action at once. A call is in flight from its ``time`` for its duration, up to and with the microsecond in
    which it ends; one of zero or negative duration only in the microsecond of its ``time``. Ends lie beyond 64 bits at the extremes."""
    e = table(spark, sf_dir, "action_events").select(clean_id(F.col("action")).alias("action"), micros(F.col("time")).cast("decimal(22,0)").alias("a"), event_duration().alias("d")).where("a is not null and d is not null")
    return observe.intervals_in_flight(e.select("action", "a", F.expr("cast(a + greatest(d, 0) div 1000 + 1 as decimal(22,0))").alias("b")), "a", "b", ["action"])


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = require(require(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 50_000, "Validation", "too small"), F.col("o_orderstatus") != "P", "Forbidden", "pending")
    return out.groupBy(F.col("_error.kind").alias("error_kind")).agg(F.count(F.lit(1)).alias("n"))


def dag_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as a graph of three levels, with shortcuts from the root to every second nation."""
    n = table(spark, sf_dir, "nation")
    name, region = F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey"))
    nodes = n.select(name.alias("id")).unionByName(n.select(region.alias("id")).distinct()).unionByName(spark.createDataFrame([("root",)], "id string"))
    edges = n.select(region.alias("from_id"), name.alias("to_id")).unionByName(n.select(F.lit("root").alias("from_id"), region.alias("to_id")).distinct()).unionByName(n.where("n_nationkey % 2 = 0").select(F.lit("root").alias("from_id"), name.alias("to_id")))
    return layer_table(nodes, edges)


def dag_fanin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph whose last node joins what two others made."""
    g = Builder()
    g.node("orders", lambda s: table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")))
    g.node("users", lambda s: table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    g.node("merge", lambda s: output(s, "users").join(output(s, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders")))
    g.edge("orders", "merge").edge("users", "merge")
    return output(g.compile().run(), "merge")


def dag_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A routed graph: drafts are revised until few rows are left."""
    g = Builder()
    g.node("draft", lambda s: (output(s, "review") if "tasks.review.output" in s else table(spark, sf_dir, "part").select("p_partkey")))
    g.node("review", lambda s: output(s, "draft").where("p_partkey % 2 = 0").select((F.col("p_partkey") / 2).cast("bigint").alias("p_partkey")))
    g.node("done", lambda s: output(s, "review").agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("top")))
    g.route("draft", lambda s: "review")
    g.route("review", lambda s: "done" if output(s, "review").count() < 500 else "draft")
    g.route("done", lambda s: "end")
    return output(g.compile().run(), "done")


def dag_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing of the action catalogue: header, nodes, and an edge between the actions of a node that follow one another by name."""
    n = table(spark, sf_dir, "action_catalog").select(F.col("name").alias("id"), "node")
    after = F.lead("id").over(Window.partitionBy("node").orderBy("id"))
    return mermaid_lines(n, n.where("node is not null").select(F.col("id").alias("from_id"), after.alias("to_id")).where("to_id is not null"))


def dag_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a graph made of chains of forty parts, with a shortcut over every tenth."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = lambda c: F.concat(F.lit("p"), c)
    step = p.where("k % 40 <> 0").select(name(F.col("k")).alias("from_id"), name(F.col("k") + 1).alias("to_id"))
    leap = p.where("k % 10 = 1").select(name(F.col("k")).alias("from_id"), name(F.col("k") + 9).alias("to_id"))
    return layer_table(p.select(name(F.col("k")).alias("id")), step.unionByName(leap))


def worker_pool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python worker that fails on some items: each failure is its item's, all others of a batch have their results."""

    def work(b: pd.DataFrame) -> pd.DataFrame:
        if (b["event_id"] % 97 == 5).any():
            raise ValueError("no such event")
        return pd.DataFrame({"event_id": b["event_id"], "out": b["event_id"] * 3})

    return k.worker_pool(work, "event_id bigint, out bigint, _error string", workers=4, keep=["event_id"])(events(spark, sf_dir).select("event_id")).withColumnRenamed("_error", "failure")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's log line, without its payloads."""
    e = table(spark, sf_dir, "action_events").select("line_no", clean_id(F.col("kind")).alias("kind"), "action", "error", "recovered")
    return observe.log_lines(e)


QUERIES = {
    f.__name__: f
    for f in (
        pipe_with, chain_3, branch_type, switch_default, branch_frames, ternary_truthy, parallel_3, parallel_named, first_success, catch_recover, loop_until, round_robin_route, fan_out_ordered, race_winner, dedup_join_back,
        idempotency_class, idempotency_ttl, cache_hit_miss, cache_layers, breaker_fold, token_bucket_fold, concurrency_fold, state_machine_valid, state_machine_strict, saga_outcome, fenced_writes, retry_log, timer_wheel_due, resume_outcomes,
        metrics_count, prometheus_text, jsonl_redacted, topic_cursor_read, calls_in_flight, validate_rows, dag_layers, dag_deep, dag_fanin_join, dag_dynamic, dag_mermaid, worker_pool_errors, log_lines,
    )
}

_KINDS = f"(select line_no, coalesce({sql_id('action')}, '') a, coalesce({sql_id('kind')}, '') k from action_events)"
_METRICS = f"""with kept as (select a, k, count(*) c, row_number() over (order by min(line_no)) r from {_KINDS} where strlen(a) <= 128 and strlen(k) <= 128 group by 1, 2),
over_ as (select cast(coalesce((select sum(c) from kept where r > 10000), 0) + (select count(*) from {_KINDS} where not (strlen(a) <= 128 and strlen(k) <= 128)) as bigint) as o)"""
_OUT = "case e.event_id % 5 when 0 then 'success' when 2 then 'permanent' when 4 then 'canceled' else 'timeout' end"
_ALLOWED = "(" + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ")"
_FROM = "(" + ", ".join(sorted({f"'{a}'" for a, _ in EDGES})) + ")"


def _breaker(reset: int) -> str:
    wait = f"r.state = 'open' and e.t - r.opened < {reset}"
    probe = f"r.state = 'open' and e.t - r.opened >= {reset}"
    fails = f"case when {wait} then r.failures when {probe} then case when {_OUT} in ('success', 'permanent') then 0 when {_OUT} = 'canceled' then r.failures else r.failures + 1 end when {_OUT} = 'success' then 0 when {_OUT} in ('permanent', 'canceled') then r.failures else r.failures + 1 end"
    opens = f"(({probe} and {_OUT} not in ('success', 'permanent')) or (r.state = 'closed' and {_OUT} = 'timeout' and r.failures + 1 >= 2))"
    state = f"case when {wait} then 'open' when {opens} then 'open' else 'closed' end"
    return fold_sql(
        f"'allowed' as decision, 'closed' as state, case when {_OUT} = 'timeout' then 1 else 0 end as failures, cast(0 as bigint) as opened",
        f"case when {wait} then 'rejected' when {probe} then 'probe' else 'allowed' end, {state}, {fails}, case when {opens} then e.t else r.opened end",
        "select event_id, decision, state, failures from r",
    )


_MERMAID_ID = "'id_' || replace(replace(replace(replace(replace({}, '.', '_'), '-', '_'), ' ', '_'), '(', ''), ')', '')"
_TT = "cast(floor(e.t / 7200) as bigint)"
_FULL = "least(3000000, case when x - seen > 40000000 then 3000000 else tokens + x - seen end)"

SQL = {
    "pipe_with": f"select user_id, cast(sum({CENTS}) as bigint) as cents from events where event_type = 'view' group by 1",
    "chain_3": f"select event_id, {CENTS} + 10 as x from events where ({CENTS} + 10) % 2 = 0",
    "branch_type": f"select event_id, case event_type when 'purchase' then {CENTS} when 'refund' then -{CENTS} when 'view' then 0 end as out, case when event_type not in ('purchase', 'refund', 'view') then 'NotFound' end as error_kind from events",
    "switch_default": "select case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 3 else 1 end as weight, count(*) as n from orders group by 1",
    "branch_frames": "select o_custkey, count(*) as n, 'f' as side from orders where o_orderstatus = 'F' group by 1 union all select o_custkey, max(o_orderkey), 'o' from orders where o_orderstatus = 'O' group by 1",
    "ternary_truthy": "select name, case when requires_auth then 'guarded' else 'open' end as verdict from action_catalog",
    "parallel_3": "select l_returnflag, cast(sum(cast(l_quantity as bigint)) as bigint) as b0, cast(sum(cast(l_quantity * 2 as bigint)) as bigint) as b1, cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) as b2 from lineitem group by 1",
    "parallel_named": "select p_partkey, 'high=' || greatest(p_size, 10) || ';low=' || least(p_size, 10) as r from part",
    "first_success": "select line_no, case when length(trim(user_id)) > 0 then user_id when length(trim(request_id)) > 0 then request_id end as id, case when coalesce(length(trim(user_id)), 0) = 0 and coalesce(length(trim(request_id)), 0) = 0 then 'Internal' end as error_kind from action_events",
    "catch_recover": "select coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as n, count(*) as rows from events group by 1",
    "loop_until": """with recursive r as (select p_partkey, p_partkey as v, 0 as turns, false as done from part
 union all select p_partkey, case when v % 2 = 0 then v // 2 else v * 3 + 1 end, turns + 1, (case when v % 2 = 0 then v // 2 else v * 3 + 1 end) = 1 from r where not done and turns < 40)
select p_partkey, case when done then v end as v, turns as v_turns, case when not done then 'Timeout' end as error_kind from r where done or turns = 40""",
    "round_robin_route": "select cast(i % 7 as integer) as slot, count(*) as n, min(event_id) as first_id from (select event_id, row_number() over (order by ts, event_id) - 1 as i from events) group by 1",
    "fan_out_ordered": "select event_id, cast(round_even(value * 100, 0) as bigint) % 97 as out from events",
    "race_winner": f"""with a as (select {sql_id('request_id')} as request_id, {sql_id('kind')} as kind, {DURATION_SQL} as d from action_events where {sql_id('request_id')} is not null and {DURATION_SQL} is not null)
select request_id, first(kind order by d, kind) filter (where kind = 'success') as winner, min(d) filter (where kind = 'success') as latency, bool_or(kind = 'success') as won, first(kind order by d, kind) filter (where kind <> 'success') as loser from a group by 1""",
    "dedup_join_back": "select l_partkey * 31 % 1009 as work, count(*) as n from lineitem group by 1",
    "idempotency_class": "select event_id, case when row_number() over w = 1 then 'executed' when first(event_type) over w = event_type then 'replayed' else 'conflict' end as claim from events window w as (partition by user_id, date_trunc('day', ts) order by ts, event_id)",
    "idempotency_ttl": fold_sql(
        f"case when e.event_id % 11 = 0 then 'passthrough' else 'executed' end as kind, case when e.event_id % 11 <> 0 and e.event_id % 5 <> 0 then e.t + {24 * HOUR} else 0 end as until, case when e.event_id % 11 <> 0 and e.event_id % 5 <> 0 then e.event_type end as payload",
        f"""case when e.event_id % 11 = 0 then 'passthrough' when e.t < r.until then case when e.event_type = r.payload then 'replayed' else 'conflict' end else 'executed' end,
 case when e.event_id % 11 = 0 or e.t < r.until then r.until when e.event_id % 5 = 0 then 0 else e.t + {24 * HOUR} end, case when e.event_id % 11 = 0 or e.t < r.until then r.payload else e.event_type end""",
        "select event_id, kind as idempotency from r",
    ),
    "cache_hit_miss": fold_sql(
        f"'miss' as cache, case when e.event_id % 4 <> 0 then e.t + {12 * HOUR} else 0 end as until", f"case when e.t < r.until then 'hit' else 'miss' end, case when e.t >= r.until and e.event_id % 4 <> 0 then e.t + {12 * HOUR} else r.until end", "select event_id, cache from r"
    ),
    "cache_layers": fold_sql(
        f"cast(null as integer) as layer, case when e.event_id % 4 <> 0 then e.t + {6 * HOUR} else 0 end as fast, case when e.event_id % 4 <> 0 then e.t + {48 * HOUR} else 0 end as slow",
        f"case when e.t < r.fast then 0 when e.t < r.slow then 1 end, case when e.t < r.fast then r.fast when e.t < r.slow or e.event_id % 4 <> 0 then e.t + {6 * HOUR} else r.fast end, case when e.t < r.fast or e.t < r.slow then r.slow when e.event_id % 4 <> 0 then e.t + {48 * HOUR} else r.slow end",
        "select event_id, layer from r",
    ),
    "breaker_fold": _breaker(12 * HOUR),
    "token_bucket_fold": fold_sql(
        f"true as allowed, cast(2000000 as bigint) as tokens, {_TT} as seen",
        f"{_FULL.replace('x', _TT).replace('seen', 'r.seen').replace('tokens', 'r.tokens').replace('case', 'case')} >= 1000000, {_FULL.replace('x', _TT).replace('seen', 'r.seen').replace('tokens', 'r.tokens')} - case when {_FULL.replace('x', _TT).replace('seen', 'r.seen').replace('tokens', 'r.tokens')} >= 1000000 then 1000000 else 0 end, {_TT}",
        "select event_id, allowed, tokens from r",
    ),
    "concurrency_fold": fold_sql(
        f"true as allowed, e.t + cast(round(e.value * 100) as bigint) * 60000000 as until", "e.t >= r.until, case when e.t >= r.until then e.t + cast(round(e.value * 100) as bigint) * 60000000 else r.until end", "select event_id, allowed from r"
    ),
    "state_machine_valid": f"select event_id, p as from_state, p is null or p = event_type or (p, event_type) in {_ALLOWED} as valid from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events)",
    "state_machine_strict": fold_sql(
        "'entered' as verdict, e.event_type as state",
        f"case when r.state not in {_FROM} then 'conflict' when e.event_type = r.state then 'same' when (r.state, e.event_type) in {_ALLOWED} then 'moved' else 'conflict' end, case when r.state in {_FROM} and (r.state, e.event_type) in {_ALLOWED} then e.event_type else r.state end",
        "select event_id, verdict, state from r",
    ),
    "saga_outcome": """with s as (select saga_run_id, step_index, bool_or(success) as success, bool_or(skipped) as skipped, max(duration_ms) as duration_ms from saga_steps group by 1, 2),
f as (select *, coalesce(success, false) and not coalesce(skipped, false) as good, not coalesce(success, false) and not coalesce(skipped, false) as fail from s)
select saga_run_id, count(*) as n_steps, count(*) filter (where good) as n_succeeded, count(*) filter (where coalesce(skipped, false)) as n_skipped, count(*) filter (where fail) as n_failed, min(case when fail then step_index end) as failed_step,
 cast(sum(duration_ms) as bigint) as duration, count(*) filter (where fail) = 0 as succeeded, count(*) filter (where fail) > 0 and count(*) filter (where good) > 0 as rolled_back from f group by 1""",
    "fenced_writes": "select event_id, coalesce(f >= max(f) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), true) as accepted from (select *, event_id * 7919 % 1000 as f from events)",
    "retry_log": f"select request_id, count(*) as records, max(coalesce(attempt, 0)) as attempts, bool_or(coalesce(kind = 'success', false)) as succeeded from {RECORDS_SQL} where request_id is not null group by 1",
    "timer_wheel_due": "select timer_id, due_tick, row_number() over (order by due_tick, timer_id desc) - 1 as firing from (select event_id as timer_id, greatest((event_id * 7919 % 100003 + 99) // 100, 1) as due_tick from events where event_id % 13 <> 0) where due_tick * 100 <= 60000",
    "resume_outcomes": f"""with e as (select distinct {sql_id('execution_id')} as id, {sql_id('parent_execution_id')} as parent, generation, source_digest s, input_digest i, contract_digest c from execution_identities)
select b.id as execution_id, b.generation, case when a.generation = b.generation and a.s = b.s and a.i = b.i and a.c = b.c then 'accepted' when not b.generation < 3 then 'conflict' when coalesce(b.generation > a.generation and b.parent = a.id, false) then 'successor' else 'validation' end as outcome
from e a join e b on a.id = b.id where a.generation = 0 and b.generation > 0""",
    "metrics_count": _METRICS + "select a as action, k as kind, c as count, cast(0 as bigint) as overflow from kept where r <= 10000 union all select null, null, 0, o from over_ where o > 0",
    "prometheus_text": _METRICS
    + """select row_number() over (order by o, a, k) as line_no, line from (select 0 as o, a, k, 'events_total{action="' || a || '",kind="' || k || '"} ' || c as line from kept where r <= 10000 union all select 1, '', '', 'events_total_overflow ' || o from over_ where o > 0)""",
    "jsonl_redacted": """select sha256('{' || array_to_string(list_filter([case when time is not null then '"time":"' || strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') || '"' end, '"line_no":' || line_no, '"kind":' || to_json(kind)::varchar, '"action":' || to_json(action)::varchar,
 case when request_type is not null then '"request_type":"string"' end, case when coalesce(error, '') <> '' then '"error":"[redacted]"' end, case when coalesce(recovered, '') <> '' then '"recovered":"[redacted]"' end], lambda x: x is not null), ',') || '}') as digest from action_events""",
    "topic_cursor_read": "select event_id as seq, event_type from events where event_id > 10 and event_id > (select max(event_id) from events) - 500 order by seq limit 40",
    "calls_in_flight": f"""with c as (select {sql_id('action')} as action, epoch_us(time)::hugeint as t, {DURATION_SQL}::hugeint as ns from action_events where time is not null),
m as (select action, t, 1 as d from c where ns is not null union all select action, t + greatest(ns, 0) // 1000 + 1, -1 from c where ns is not null)
select action, cast(max(r) as bigint) as most from (select action, sum(sum(d)) over (partition by action order by t, d rows unbounded preceding) as r from m group by action, t, d) group by 1""",
    "validate_rows": "select case when not o_totalprice > 50000 then 'Validation' when o_orderstatus = 'P' then 'Forbidden' end as error_kind, count(*) as n from orders group by 1",
    "dag_layers": "select 'root' as id, 0 as layer union all select distinct 'r' || n_regionkey, 1 from nation union all select 'n' || n_nationkey, 2 from nation",
    "dag_fanin_join": "select c_name, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name",
    "dag_dynamic": "with recursive r as (select p_partkey // 2 as k, 1 as step from part where p_partkey % 2 = 0 union all select k // 2, step + 1 from r where k % 2 = 0 and step < 30), c as (select step, count(*) as n, max(k) as top from r group by 1) select n, top from c where n < 500 order by step limit 1",
    "dag_mermaid": f"""with e as (select name as a, lead(name) over (partition by node order by name) as b from action_catalog where node is not null),
lines as (select 0 as p, '' as a, '' as b, 'flowchart LR' as line from action_catalog limit 1),
every as (select * from lines union all select 1, name, '', '    ' || {_MERMAID_ID.format('name')} || '["' || replace(name, '"', '#quot;') || '"]' from action_catalog
 union all select 2, a, b, '    ' || {_MERMAID_ID.format('a')} || ' --> ' || {_MERMAID_ID.format('b')} from e where b is not null)
select row_number() over (order by p, a, b, line) as line_no, line from every""",
    "dag_deep": """with recursive e as (select p_partkey as a, p_partkey + 1 as b from part where p_partkey % 40 <> 0 union select p_partkey, p_partkey + 9 from part where p_partkey % 10 = 1),
k as (select a, b from e where b in (select p_partkey from part)),
w as (select p_partkey as n, 0 as d from part where p_partkey not in (select b from k) union select k.b, w.d + 1 from w join k on k.a = w.n)
select 'p' || n as id, max(d) as layer from w group by 1""",
    "worker_pool_errors": "select event_id, case when event_id % 97 <> 5 then event_id * 3 end as out, case when event_id % 97 = 5 then 'ValueError: no such event' end as failure from events",
    "log_lines": f"""select case when coalesce({sql_id('kind')}, '') = 'error' then 'ERROR' else 'INFO' end as level, '{{' || array_to_string(list_filter(['"line_no":' || line_no, '"kind":' || to_json({sql_id('kind')})::varchar, '"action":' || to_json(action)::varchar], lambda x: x is not null), ',') || '}}' as line from action_events""",
}
