"""Queries p1, p2, p3 and p5 over action_events and execution_identities, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clean_id, go_duration_ns
from ..operators.feature_table import feature_table
from ..operators.hierarchy import ancestor_pairs, findings, hierarchy, links
from ..operators.hot_keys import compress, hot_keys, percentiles, profile, unpivot_keys
from ..operators.sessions import sessions
from ..session import table

#: Columns that make a record of action_events (repeated deliveries differ in line_no and received_at only).
EVENT_IDS = ["kind", "action", "request_id", "execution_id", "trace_id", "span_id", "tenant_id", "user_id"]
EVENT_TEXTS = ["duration", "request_type", "response_type", "error", "recovered"]
EVENT_OTHERS = ["time", "duration_ns", "attempt"]
RECORD = {"ids": EVENT_IDS, "texts": EVENT_TEXTS, "others": EVENT_OTHERS}
SESSION_GAP_US = 30 * 60 * 1_000_000


def event_duration() -> Column:
    """Nanoseconds of a row of action_events, from whichever of its two columns has a value."""
    return F.coalesce(F.col("duration_ns"), go_duration_ns(F.col("duration")))


def p1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(table(spark, sf_dir, "action_events"), "tenant_id", "kind", "time", "attempt", **RECORD).withColumnRenamed("entity", "tenant_id")


def p1_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of p1_features turned back into one row per tenant and kind it had, with its totals as kind null."""
    wide = p1_features(spark, sf_dir)
    stems = [c[3:] for c in wide.columns if c.startswith("n__")]
    q = lambda c: "`" + c + "`"
    cells = [f"named_struct('kind', '{s}', 'n', {q('n__' + s)}, 'last_us', {q('last_us__' + s)}, 'age_us', {q('age_us__' + s)}, 'total', {q('total__' + s)})" for s in stems]
    whole = "named_struct('kind', cast(null as string), 'n', n_records, 'last_us', last_us, 'age_us', cast(null as bigint), 'total', total)"
    return wide.selectExpr("tenant_id", f"explode(array({', '.join([whole, *cells])})) as c").select("tenant_id", "c.*").where("n > 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "action_events"), ["tenant_id", "action"], "kind", 3).select("key_field", "key_value")


def p2_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant and per action: rows, exact distinct users and commonest user, exact median and 95th percentile of the duration."""
    by = ["key_field", "key_value"]
    duration = F.coalesce(F.col("duration_ns"), go_duration_ns(F.col("duration")))
    rows = unpivot_keys(table(spark, sf_dir, "action_events"), ["tenant_id", "action"], {"u": clean_id(F.col("user_id")), "d": duration}).where("key_value is not null")
    users = profile(compress(rows, by, "u"), by).select(*by, "n_rows", F.col("n_distinct").alias("n_users"), F.col("mode").alias("top_user"), F.col("mode_rows").alias("top_user_rows"))
    ranks = percentiles(compress(rows, by, "d"), by, [500, 950]).groupBy(*by).agg(F.max(F.when(F.col("permille") == 500, F.col("value"))).alias("p50_ns"), F.max(F.when(F.col("permille") == 950, F.col("value"))).alias("p95_ns"))
    return users.join(ranks, by, "left")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "action_events"), "user_id", "time", SESSION_GAP_US, **RECORD).withColumnRenamed("key", "user_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("user_id", "start_us", "end_us")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation 0 of every execution: (node, parent, named_root), ids cleaned."""
    rows = table(spark, sf_dir, "execution_identities").where("generation = 0")
    return rows.select(clean_id(F.col("execution_id")).alias("node"), clean_id(F.col("parent_execution_id")).alias("parent"), clean_id(F.col("root_execution_id")).alias("named_root"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identities(spark, sf_dir)
    nodes = hierarchy(links(rows, "node", "parent"), with_paths=False)
    named = rows.where("node is not null").groupBy("node").agg(F.min("named_root").alias("named_root"))
    return findings(nodes, named).withColumnRenamed("node", "execution_id")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchy(links(_identities(spark, sf_dir), "node", "parent"))
    return nodes.select(F.col("node").alias("execution_id"), "state", "root", "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchy(links(_identities(spark, sf_dir), "node", "parent"))
    return ancestor_pairs(nodes)


QUERIES = {f.__name__: f for f in (p1_features, p1_long, p2_found, p2_profiles, p3_found, p3_sessions, p5_found, p5_hierarchy, p5_descendants)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def sql_id(c: str) -> str:
    return f"nullif(lower(trim({c}, {_BLANKS})), '')"


def sql_text(c: str) -> str:
    return f"nullif(trim({c}, {_BLANKS}), '')"


#: One row per record with cleaned columns.
RECORDS_SQL = "(select distinct " + ", ".join([f"{sql_id(c)} as {c}" for c in EVENT_IDS] + [f"{sql_text(c)} as {c}" for c in EVENT_TEXTS] + EVENT_OTHERS) + " from action_events)"

#: Nanoseconds of a Go duration text (column d): a sum over its parts.
GO_DURATION_SQL = r"""case when regexp_full_match(trim(d), '[+-]?0') then 0
 when regexp_full_match(trim(d), '[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(ns|us|µs|μs|ms|s|m|h))+') then
 (case when trim(d) like '-%' then -1 else 1 end) * cast(list_sum(list_transform(regexp_extract_all(trim(d), '([0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:ns|us|µs|μs|ms|s|m|h)'),
  lambda x: floor(cast(regexp_replace(x, '[^0-9.]', '', 'g') as decimal(28,9)) * case regexp_replace(x, '[0-9.]', '', 'g') when 'ns' then 1 when 'us' then 1000 when 'µs' then 1000 when 'μs' then 1000 when 'ms' then 1000000 when 's' then 1000000000 when 'm' then 60000000000 else 3600000000000 end))) as bigint) end"""

#: Nanoseconds of a row of action_events.
DURATION_SQL = f"coalesce(duration_ns, {GO_DURATION_SQL.replace('(d)', '(duration)')})"

_KEYS = f"(select 'tenant_id' as key_field, {sql_id('tenant_id')} as key_value, * from action_events union all select 'action', {sql_id('action')}, * from action_events)"

_P1 = f"""with recs as {RECORDS_SQL},
long as (select tenant_id, kind, count(*) n, epoch_us(max(time)) l, sum(coalesce(attempt, 0))::bigint t from recs group by 1, 2),
latest as (select max(l) a from long)
select tenant_id, regexp_replace(kind, '[^a-z0-9]+', '_', 'g') as kind, n, l as last_us, a - l as age_us, t as total from long cross join latest where tenant_id is not null and kind is not null union all
select tenant_id, null, sum(n)::bigint, max(l), null, sum(t)::bigint from long where tenant_id is not null group by 1"""

_P2_FOUND = f"select key_field, key_value from {_KEYS} where key_value is not null group by 1, 2 having count(*) * 100 >= 3 * (select count(*) from action_events)"

_P2_PROFILES = f"""with rows_ as (select key_field, key_value, {sql_id('user_id')} u, coalesce(duration_ns, d2) v from (select *, {GO_DURATION_SQL.replace('(d)', '(duration)')} as d2 from {_KEYS} where key_value is not null)),
us as (select key_field, key_value, u, count(*) w from rows_ group by 1, 2, 3),
best as (select key_field, key_value, u top_user, w top_user_rows from us where u is not null qualify row_number() over (partition by key_field, key_value order by w desc, u) = 1),
ranked as (select key_field, key_value, v, row_number() over (partition by key_field, key_value order by v) rn, count(*) over (partition by key_field, key_value) n from rows_ where v is not null),
pct as (select key_field, key_value, max(case when rn = greatest((n * 500 + 999) // 1000, 1) then v end) p50_ns, max(case when rn = greatest((n * 950 + 999) // 1000, 1) then v end) p95_ns from ranked group by 1, 2)
select key_field, key_value, cast(sum(w) as bigint) n_rows, count(u) n_users, any_value(top_user) top_user, coalesce(any_value(top_user_rows), 0) top_user_rows, any_value(p50_ns) p50_ns, any_value(p95_ns) p95_ns
from us left join best using (key_field, key_value) left join pct using (key_field, key_value) group by 1, 2"""

_P3 = f"""with ev as (select user_id, epoch_us(time) t from {RECORDS_SQL} where user_id is not null and time is not null),
o as (select *, case when t - lag(t) over (partition by user_id order by t) <= {SESSION_GAP_US} then 0 else 1 end as opens from ev),
s as (select *, sum(opens) over (partition by user_id order by t rows unbounded preceding) as g from o),
-- equal times: rows of one time share the session, as a gap of 0 opens none
r as (select user_id, min(t) start_us, max(t) end_us, max(t) - min(t) duration_us, count(*) n_events from s group by user_id, g)
"""

_P5_NODES = f"""with recursive g as (select {sql_id('execution_id')} node, min({sql_id('parent_execution_id')}) parent, min({sql_id('root_execution_id')}) named_root from execution_identities where generation = 0 and {sql_id('execution_id')} is not null group by 1),
e as (select g.node, g.parent, g.named_root, g.parent is not null and k.node is null as missing, k.node as up from g left join g k on g.parent = k.node),
walk as (select node, node as root, 0::bigint as depth, node as path from e where up is null union all
 select e.node, walk.root, walk.depth + 1, walk.path || '/' || e.node from walk join e on e.up = walk.node),
lost as (select node, up from e where node not in (select node from walk)),
climb as (select node, up as at_ from lost union select climb.node, lost.up from climb join lost on climb.at_ = lost.node),
n as (select e.node, e.parent, e.named_root, w.root, w.depth, w.path,
  case when e.missing then 'missing_parent' when w.node is not null then 'rooted' when exists (select 1 from climb c where c.node = e.node and c.at_ = e.node) then 'on_cycle' else 'below_cycle' end as state
  from e left join walk w on e.node = w.node)
"""

SQL = {
    "p1_long": _P1,
    "p2_found": _P2_FOUND,
    "p2_profiles": _P2_PROFILES,
    "p3_found": _P3 + "select user_id, start_us, end_us from r",
    "p3_sessions": _P3 + "select user_id, start_us, end_us, duration_us, n_events from r",
    "p5_found": _P5_NODES
    + "select node as execution_id, finding from (select n.node, case when n.state <> 'rooted' then n.state when n.named_root is not null and n.named_root <> n.root and t.state = 'rooted' then 'wrong_root' end finding from n left join n t on n.root = t.node) where finding is not null",
    "p5_hierarchy": _P5_NODES + "select node as execution_id, state, root, depth, path from n",
    "p5_descendants": _P5_NODES + "select p[i] as ancestor, node as descendant, depth - i + 1 as distance from (select node, depth, string_split(path, '/') p, unnest(range(1, depth + 1)) i from n where depth > 0)",
}
