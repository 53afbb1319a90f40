"""Queries over the remaining sources, sinks, guards and errors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.coerce import coerce_fields, text_of
from ..functions.scalars import adaptive_timeout, redacted, scope_hash
from ..functions.values import clean_id, micros
from ..operators import compose, folds, observe, stateful, stream
from ..order import order
from ..plans.graph import Builder, ExecutionError, Suspend, key, load, output, save
from ..plans.hooks import inspected
from ..plans.policy import Journal
from ..plans.stage import Registry, distinct_stage, filter_stage
from ..session import ensure_checkpoint_dir, table
from .dealt import DURATION_SQL, event_duration, sql_id
from .streams import BY_USER, HOUR, events, fold_sql


def coerce_struct_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties as a struct, strictly: a value that does not fit makes the struct none."""
    made = coerce_fields(F.from_json("props", "map<string,string>"), {"k": "int8"})
    return events(spark, sf_dir).select("event_id", made["k"].cast("int").alias("k"), made.isNotNull().alias("fits"))


def text_of_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("result"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "text").otherwise("other"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text_of(m).alias("text"))


def history_per_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three records of each action, as they arrived."""
    e = table(spark, sf_dir, "action_events").withColumn("action", clean_id(F.col("action")))
    return stream.last_n(3, order("line_no", keys=("action",)))(e).select("action", "line_no", F.coalesce(F.length(F.trim("error")) > 0, F.lit(False)).alias("failed"))


def slow_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "action_events").select("kind", event_duration().alias("duration_ns"))
    return observe.slow(e, "duration_ns", 1_000_000_000).groupBy(clean_id(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("duration_ns").alias("slowest"))


def over_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that took longer than their action may, per action (an inner join to the catalogue)."""
    cat = table(spark, sf_dir, "action_catalog").select(clean_id(F.col("name")).alias("action"), "timeout_ns").where("timeout_ns > 0")
    e = table(spark, sf_dir, "action_events").select(clean_id(F.col("action")).alias("action"), event_duration().alias("duration_ns"))
    out = errors.require(e.join(cat, "action"), F.col("duration_ns").isNull() | (F.col("duration_ns") <= F.col("timeout_ns")), "Timeout", "deadline exceeded")
    return out.groupBy("action").agg(F.count("_error").alias("late"), F.count(F.lit(1)).alias("calls"))


def coalesced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work shared by calls of one action and payload type, computed once for each pair."""
    e = table(spark, sf_dir, "action_events").select("line_no", clean_id(F.col("action")).alias("action"), F.trim("request_type").alias("payload"))
    out = compose.compute_once(e, ["action", "payload"], lambda d: d.withColumn("weight", F.length(F.coalesce("action", F.lit(""))) + F.length(F.coalesce("payload", F.lit("")))))
    return out.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


def topic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("seq"), F.col("n_name").alias("payload"))
    return observe.topic_append(topic, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("payload")), "seq", order("payload")).select("seq", "payload")


def ring_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("payload"))
    return observe.ring_push(ring, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).alias("seq"), F.col("s_name").alias("payload")), 32, order("seq"))


def public_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Internal").when(F.col("o_orderstatus") == "O", "NotFound").otherwise("Odd")
    e = F.when(F.col("o_totalprice") > 100_000, F.struct(kind.alias("kind"), F.col("o_orderpriority").alias("message")))
    seen = errors.public(errors.transport(e))
    return o.groupBy(seen["error"].alias("error"), seen["message"].alias("message")).agg(F.count(F.lit(1)).alias("n"))


def saga_runs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each saga, how many runs succeeded, rolled back or failed with nothing to undo."""
    raw = table(spark, sf_dir, "saga_steps")
    steps = raw.groupBy("saga_run_id", "step_index").agg(F.max("success").alias("success"), F.max("skipped").alias("skipped"), F.max("error").alias("error"), F.max("duration_ms").alias("duration_ms"))
    runs = stateful.saga_outcomes(steps, "saga_run_id", "step_index", "success", "skipped", "error", "duration_ms").join(raw.groupBy("saga_run_id").agg(F.min(clean_id(F.col("saga"))).alias("saga")), "saga_run_id")
    one = lambda c: F.sum(c.cast("bigint"))
    return runs.groupBy("saga").agg(F.count(F.lit(1)).alias("runs"), one(F.col("succeeded")).alias("succeeded"), one(F.col("rolled_back")).alias("rolled_back"))


def idempotency_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries as they answer a retry a day after the last was stored: replay while kept, in progress, or a new claim."""
    e = table(spark, sf_dir, "idempotency_entries")
    newest = e.groupBy(F.trim("entry_key").alias("entry_key"), clean_id(F.col("action")).alias("action")).agg(F.max_by(F.struct("status", F.lower(F.trim("claim_state")).alias("state")), F.struct("stored_at", "request_hash")).alias("e"), F.max("stored_at").alias("at"))
    last = e.agg(F.max("stored_at")).scalar()
    kept = micros(last) - micros(F.col("at")) < 86_400_000_000
    answer = F.when(~kept, "acquired").when(F.col("e.status").isNotNull(), "completed").otherwise(F.coalesce("e.state", F.lit("in_progress")))
    return newest.groupBy(answer.alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's own structure, as a table."""
    g = Builder()
    for n in ("load", "clean", "count", "report"):
        g.node(n, lambda s: spark.range(1))
    g.edge("load", "clean").edge("clean", "count").edge("count", "report").edge("clean", "report")
    return inspected(spark, g.compile())[0]


QUERIES = {
    f.__name__: f
    for f in (coerce_struct_props, text_of_headers, history_per_action, slow_calls, over_timeout, coalesced_calls, topic_publish, ring_push, public_errors, saga_runs_by_name, idempotency_store, plan_nodes)
}

_ACTION = sql_id("action")

SQL = {
    "coerce_struct_props": """select event_id, cast(case when v between -128 and 127 then v end as integer) as k, t is null or coalesce(v between -128 and 127, false) as fits
 from (select event_id, t, try_cast(case when regexp_full_match(trim(t), '[+-]?[0-9]+') then trim(t) end as hugeint) as v from (select event_id, json_extract_string(props, '$.k') as t from events))""",
    "text_of_headers": "select p_partkey, case when p_partkey % 2 = 0 then p_brand else p_name end as text from part",
    "history_per_action": f"select {_ACTION} as action, line_no, coalesce(length(trim(error)) > 0, false) as failed from action_events qualify row_number() over (partition by {_ACTION} order by line_no desc) <= 3",
    "slow_calls": f"select {sql_id('kind')} as kind, count(*) as n, max({DURATION_SQL}) as slowest from action_events where {DURATION_SQL} > 1000000000 group by 1",
    "over_timeout": f"select e.action, count(*) filter (where duration_ns > timeout_ns) as late, count(*) as calls from (select {_ACTION} as action, {DURATION_SQL} as duration_ns from action_events) e join (select {sql_id('name')} as action, timeout_ns from action_catalog where timeout_ns > 0) c on e.action = c.action group by 1",
    "coalesced_calls": f"select cast(length(coalesce({_ACTION}, '')) + length(coalesce(trim(request_type), '')) as integer) as weight, count(*) as n from action_events group by 1",
    "topic_publish": "select row_number() over (order by s_name) + (select max(n_nationkey) + 1 from nation) as seq, s_name as payload from supplier",
    "ring_push": "select cast(n_nationkey as bigint) as seq, n_name as payload from nation union all (select s_suppkey + 100, s_name from supplier order by s_suppkey limit (select greatest(0, 32 - count(*)) from nation))",
    "public_errors": """select case when o_totalprice > 100000 then case o_orderstatus when 'F' then 'Internal' when 'O' then 'NotFound' else 'Unavailable' end end as error,
 case when o_totalprice > 100000 then case o_orderstatus when 'F' then 'internal server error' when 'O' then o_orderpriority else 'transport error' end end as message, count(*) as n from orders group by 1, 2""",
    "saga_runs_by_name": f"""with s as (select saga_run_id, step_index, min({sql_id('saga')}) as saga, bool_or(success) as ok, bool_or(skipped) as sk from saga_steps group by 1, 2),
r as (select saga_run_id, min(saga) as saga, count(*) filter (where not coalesce(ok, false) and not coalesce(sk, false)) as f, count(*) filter (where coalesce(ok, false) and not coalesce(sk, false)) as g from s group by 1)
select saga, count(*) as runs, count(*) filter (where f = 0) as succeeded, count(*) filter (where f > 0 and g > 0) as rolled_back from r group by 1""",
    "idempotency_store": f"""with n as (select trim(entry_key) as k, {_ACTION} as a, arg_max({{'status': status, 'state': lower(trim(claim_state))}}, (stored_at, request_hash)) as e, max(stored_at) as at_ from idempotency_entries group by 1, 2)
select case when not epoch_us((select max(stored_at) from idempotency_entries)) - epoch_us(at_) < 86400000000 then 'acquired' when e.status is not null then 'completed' else coalesce(e.state, 'in_progress') end as answer, count(*) as n from n group by 1""",
    "plan_nodes": "select * from (values (0, 'graph', 'graph', 0), (1, 'clean', 'node', 1), (2, 'count', 'node', 1), (3, 'load', 'node', 1), (4, 'report', 'node', 1)) v(id, name, kind, depth)",
}


def scope_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a scope: an action's node with its tags, whose order and repetitions do not matter."""
    tags = F.concat("tags", F.slice(F.col("tags"), 1, 1))
    return table(spark, sf_dir, "action_catalog").select("name", scope_hash([F.coalesce("node", F.lit(""))], [tags]).alias("scope"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct("n_nationkey", "n_name")), 256).alias("key"))


def ring_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.take(7, order("seq"))(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("payload")).where("seq > 3"))


def memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.last_n(1000, order("line_no"))(table(spark, sf_dir, "action_events")).select("line_no", clean_id(F.col("kind")).alias("kind"))


def collect_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded collection of each segment's customers; more than the bound would be refused."""
    c = stream.collect(1_000_000_000, order("c_custkey", keys=("c_mktsegment",)), F.col("c_custkey"), kind="Forbidden")(table(spark, sf_dir, "customer"))
    return c.select("c_mktsegment", F.size("items").alias("n"), F.element_at("items", 1).alias("first_key"), F.element_at("items", -1).alias("last_key"))


def redacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", redacted(F.col("c_name")).alias("c_name"))


def adaptive_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker whose calls get a timeout that grows with the failures counted."""
    e = events(spark, sf_dir).withColumn("o", F.when(F.col("event_id") % 3 == 0, "success").otherwise("timeout"))
    out = folds.circuit_breaker(5, 3 * HOUR, micros(F.col("ts")), F.col("o"), BY_USER)(e)
    return out.groupBy("user_id").agg(F.max(adaptive_timeout(1_000_000_007, F.col("failures"))).alias("longest"), F.sum((F.col("decision") == "rejected").cast("bigint")).alias("rejected"))


def named_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source and operators by name, configured from texts."""

    @dataclass
    class AtLeast:
        cents: int = 0

    r = Registry()
    r.add(
        sources={"events": lambda s, sf: table(s, sf, "events")},
        operators={"at_least": (lambda c: filter_stage("at_least", F.col("value") * 100 >= c.cents), AtLeast), "first": (lambda: distinct_stage("first", order("ts", "event_id"), "user_id"), None)},
        aliases={"clicks": "events"},
    )
    return r.pipeline(spark, "clicks", [("at_least", {"cents": " 12000 "}), ("first", {})], sf=sf_dir).select("user_id", "event_id")


def dag_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that is suspended after its first layer, written, read again and finished."""
    go = []

    def total(s):
        if not go:
            raise Suspend("not yet")
        return output(s, "orders").agg(F.sum("o_orderkey").alias("total"))

    g = Builder().node("orders", lambda s: table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")).node("total", total).edge("orders", "total").compile()
    try:
        g.run(materialize=True)
    except ExecutionError as e:
        folder = f"{ensure_checkpoint_dir(spark)}/weirflow-graphs/{uuid.uuid4().hex}"
        save(e.state, folder)
    go.append(True)
    return output(g.run(load(spark, folder, [key(n) for n in g.nodes])), "total")


def durable_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's result kept in a journal: the second call reads it."""
    j = Journal(spark, f"{ensure_checkpoint_dir(spark)}/weirflow-journal/{uuid.uuid4().hex}")
    j.step("e1", "count", lambda: table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
    return j.step("e1", "count", lambda: spark.range(0).select(F.lit("").alias("o_orderstatus"), F.lit(0).alias("n")))


QUERIES |= {f.__name__: f for f in (scope_hashes, cache_keys, ring_drain, memory_sink, collect_forbidden, redacted_rows, adaptive_breaker, named_pipeline, dag_resumed, durable_step)}

_PREFIX = "unhex(lpad(to_hex(strlen({0})), 16, '0')) || encode({0})"
_WAIT, _PROBE = f"r.state = 'open' and e.t - r.at_ < {3 * HOUR}", f"r.state = 'open' and e.t - r.at_ >= {3 * HOUR}"
_GOOD = "e.event_id % 3 = 0"
_FAILS = f"case when {_WAIT} then r.f when {_GOOD} then 0 else r.f + 1 end"
_OPENS = f"(not ({_WAIT}) and not ({_GOOD}) and ({_PROBE} or r.f + 1 >= 5))"

SQL |= {
    "scope_hashes": "select name, sha256(" + _PREFIX.format("coalesce(node, '')") + " || " + _PREFIX.format("coalesce(array_to_string(list_transform(list_sort(list_distinct(tags)), lambda v: lpad(to_hex(strlen(v)), 16, '0') || v), ''), '')") + ") as scope from action_catalog",
    "cache_keys": """select n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":' || to_json(n_name)::varchar || '}') as key from nation""",
    "ring_drain": "select s_suppkey as seq, s_name as payload from supplier where s_suppkey > 3 order by s_suppkey limit 7",
    "memory_sink": f"select line_no, {sql_id('kind')} as kind from action_events order by line_no desc limit 1000",
    "collect_forbidden": "select c_mktsegment, cast(count(*) as integer) as n, min(c_custkey) as first_key, max(c_custkey) as last_key from customer group by 1",
    "redacted_rows": "select c_custkey, case when c_name is not null then '[redacted]' end as c_name from customer",
    "adaptive_breaker": fold_sql(
        f"'closed' as state, case when {_GOOD} then 0 else 1 end as f, cast(0 as bigint) as at_, 'allowed' as d",
        f"case when {_WAIT} or {_OPENS} then 'open' else 'closed' end, {_FAILS}, case when {_OPENS} then e.t else r.at_ end, case when {_WAIT} then 'rejected' else 'allowed' end",
        "select user_id, max(1000000007::bigint * (1 + f // 10) + cast(100000000 * (f % 10) + 7 * (f % 10) // 10 as bigint)) as longest, count(*) filter (where d = 'rejected') as rejected from r group by 1",
    ),
    "named_pipeline": "select user_id, event_id from events where value * 100 >= 12000 qualify row_number() over (partition by user_id order by ts, event_id) = 1",
    "dag_resumed": "select cast(sum(o_orderkey) as bigint) as total from orders where o_orderstatus = 'F'",
    "durable_step": "select o_orderstatus, count(*) as n from orders group by 1",
}
