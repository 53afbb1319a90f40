"""Queries over pure functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions import scalars as s
from ..functions.values import go_duration_ns
from ..session import table
from .dealt import DURATION_SQL, GO_DURATION_SQL, event_duration

#: Texts of all sorts of values, from the data: numbers with blanks, fractions, exponents, booleans, lists.
_TEXTS = "concat_ws('', case when event_id % 7 = 0 then '  ' else '' end, case event_id % 9 when 0 then 't' when 1 then 'false' when 2 then cast(user_id as string) when 3 then concat('-', user_id) when 4 then concat(user_id, '.5') when 5 then concat(user_id, 'e2') when 6 then 'yes' when 7 then concat(user_id, ',', event_id, ',,x') else cast(event_id * 977 as string) end)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_TEXTS).alias("raw"))


def coerce_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _texts(spark, sf_dir).select(
        "event_id", c.coerce(raw, "bool").alias("b"), c.coerce(raw, "int8").cast("int").alias("i8"), c.coerce(raw, "int32").alias("i32"), c.coerce(raw, "int").alias("i64"), c.coerce(raw, "uint16").alias("u16"), F.array_join(c.coerce(raw, "list:string"), "|").alias("parts")
    )


def coerce_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("event_id", c.coerce(F.col("raw"), "float64").alias("f"))


def coerce_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "action_events").select("line_no", go_duration_ns(F.col("duration")).alias("ns"))


def narrow_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") * F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0) + F.floor("value")
    return table(spark, sf_dir, "events").select("event_id", c.narrow(F.floor("value").cast("double"), "int8").cast("int").alias("whole"), c.narrow(v, "int32").alias("mixed"))


def truthy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("event_id", c.truthy(F.col("raw")).alias("truthy"))


def backoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod(F.col("event_id"), F.lit(40)).cast("int")
    base, top = F.col("user_id") * 1_000_000, F.lit(2_000_000_000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", s.exponential_backoff(base, top, n).alias("exponential"), s.linear_backoff(base, n).alias("linear"), s.jittered_backoff(base, top, n, F.pmod(F.col("event_id"), F.lit(100)) / 100).alias("jittered"), s.adaptive_timeout(base, n).alias("adaptive")
    )


def digest_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", s.payload_hash(F.col("text")).alias("digest"))


def scoped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "idempotency_entries").select("entry_key", "action", s.scoped_key("k-", F.lit("v1"), F.coalesce("action", F.lit("")), F.coalesce("entry_key", F.lit(""))).alias("storage_key")).distinct()


def valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "action_events").select("line_no", s.valid_key(F.col("request_id")).alias("valid"))


def hash_router_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.fnv1a64(F.col("p_name")).cast("string").alias("hash"), s.hash_slot(F.col("p_name"), 7).alias("slot"))


def power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.power_of_two_ceiling(F.col("p_partkey")).alias("capacity"))


def sanitized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "action_catalog").select("name", s.mermaid_id(F.col("name")).alias("node_id"), s.mermaid_label(F.col("description")).alias("label"), s.output_key(F.col("name")).alias("output_key"), s.label_escaped(F.col("description")).alias("escaped"))


def load_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("priority", F.element_at(F.array(F.lit("low"), F.lit("normal"), F.lit("critical")), (F.col("event_id") % 3 + 1).cast("int")))
    return e.select("event_id", s.shed(F.col("value"), (F.col("event_id") % 1000).cast("int"), F.col("priority"), 60.0, 999).alias("rejected"))


def filter_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = table(spark, sf_dir, "action_catalog")
    nodes = [r[0] for r in cat.select("node").where("node <> ''").distinct().orderBy("node").limit(1).collect()]
    return cat.where(s.matches_node(F.col("node"), F.col("scope"), nodes[0] if nodes else "", untagged_everywhere=True)).select("name")


def authz_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = table(spark, sf_dir, "action_catalog")
    return cat.select("name", s.has_permission(F.col("tags"), "read").alias("may_read"), s.has_features(F.col("tags"), ["cache", "audit"], every=False).alias("some_feature"))


def journal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "execution_identities").select(s.journal_namespace(F.col("execution_id"), F.col("generation")).alias("journal")).groupBy(F.replace("journal", F.lit("\x00"), F.lit("|")).alias("journal")).agg(F.count(F.lit(1)).alias("n"))


def hedged_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to a result of action_events' durations if a second attempt (the record's half) began after 50 ms. Negative durations
    count as they stand: the slowest is negative only where all of an action's are."""
    d = table(spark, sf_dir, "action_events").withColumn("duration_ns", event_duration()).where("duration_ns is not null")
    return d.groupBy(F.lower(F.trim("action")).alias("action")).agg(F.max(s.hedge(F.col("duration_ns"), F.shiftright("duration_ns", 1), 50_000_000)).alias("slowest"))


QUERIES = {
    f.__name__: f
    for f in (
        coerce_scalars, coerce_float, coerce_duration, narrow_numbers, truthy_table, backoff_table, digest_sha, scoped_keys, valid_keys, hash_router_slots, power_of_two, sanitized_ids, load_shed,
        filter_by_node, authz_filter, journal_names, hedged_latency,
    )
}

_RAW = "(select *, " + _TEXTS.replace("as string", "as varchar") + " as raw, value from events)"
_INT = "try_cast(case when regexp_full_match(trim(raw), '[+-]?[0-9]+') then trim(raw) end as hugeint)"
_TOP = "2000000000"


SQL = {
    "coerce_scalars": f"""select event_id, case when trim(raw) in ('1','t','T','TRUE','true','True') then true when trim(raw) in ('0','f','F','FALSE','false','False') then false end as b,
 cast(case when {_INT} between -128 and 127 then {_INT} end as integer) as i8, cast(case when {_INT} between -2147483648 and 2147483647 then {_INT} end as integer) as i32, cast({_INT} as bigint) as i64,
 cast(case when regexp_full_match(trim(raw), '[0-9]+') and {_INT} <= 65535 then {_INT} end as integer) as u16,
 array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from {_RAW}""",
    "coerce_float": f"select event_id, try_cast(case when regexp_full_match(trim(raw), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then trim(raw) end as double) as f from {_RAW}",
    "coerce_duration": f"select line_no, {GO_DURATION_SQL.replace('(d)', '(duration)')} as ns from action_events",
    "narrow_numbers": """select event_id, case when floor(value) between -128 and 127 then cast(floor(value) as integer) end as whole,
 case when v = floor(v) and v between -2147483648 and 2147483647 then cast(v as integer) end as mixed from (select *, value * case when event_id % 3 = 0 then 1.0::double else 0.0::double end + floor(value) as v from events)""",
    "truthy_table": f"select event_id, raw not in ('', 'false', 'no', '0') as truthy from {_RAW}",
    "backoff_table": f"""select event_id, ex as exponential, cast(b * n as bigint) as linear, cast(least(greatest(floor(ex * (1 + 0.3::double * (2 * ((event_id % 100) / 100) - 1))), least(b, {_TOP})), {_TOP}) as bigint) as jittered,
 cast(b * (1 + n // 10) + (b // 10) * (n % 10) + (b % 10) * (n % 10) // 10 as bigint) as adaptive
 from (select *, cast(least(cast(least(b, {_TOP}) as hugeint) * cast(pow(2, greatest(n - 1, 0)) as hugeint), {_TOP}) as bigint) as ex from (select event_id, event_id % 40 as n, user_id * 1000000 as b from events))""",
    "digest_sha": "select doc_id, sha256(coalesce(text, chr(0) || 'nil' || chr(0))) as digest from documents",
    "scoped_keys": """select distinct entry_key, action, 'k-' || sha256(unhex(lpad(to_hex(strlen('v1')), 16, '0')) || encode('v1') || unhex(lpad(to_hex(strlen(coalesce(action, ''))), 16, '0')) || encode(coalesce(action, '')) || unhex(lpad(to_hex(strlen(coalesce(entry_key, ''))), 16, '0')) || encode(coalesce(entry_key, ''))) as storage_key from idempotency_entries""",
    "valid_keys": "select line_no, coalesce(regexp_full_match(request_id, '[\\x21-\\x7e]{1,255}'), false) as valid from action_events",
    "hash_router_slots": """select p_partkey, cast(h as varchar) as hash, cast(h % 7 as integer) as slot from (select p_partkey, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::hugeint)),
 lambda h, b: ((h - h % 256 + xor(cast(h % 256 as integer), cast(b as integer))) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as h from part)""",
    "power_of_two": "select p_partkey, cast(pow(2, ceil(log2(greatest(p_partkey, 1)))) as bigint) as capacity from part",
    "sanitized_ids": """select name, 'id_' || replace(replace(replace(replace(replace(name, '.', '_'), '-', '_'), ' ', '_'), '(', ''), ')', '') as node_id, replace(description, '"', '#quot;') as label, 'tasks.' || name || '.output' as output_key,
 replace(replace(replace(description, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') as escaped from action_catalog""",
    "load_shed": "select event_id, case event_id % 3 when 0 then value > 60 * 0.7::double or event_id % 1000 > 699 when 1 then value > 60 * 0.85::double or event_id % 1000 > 849 else value > 60 or event_id % 1000 > 999 end as rejected from events",
    "filter_by_node": "select name from action_catalog where coalesce(scope = 'system', false) or node = (select min(node) from action_catalog where node <> '') or coalesce(node, '') = ''",
    "authz_filter": "select name, coalesce(list_has_any(tags, ['read', '*']), false) as may_read, coalesce(list_has_any(tags, ['all', '*', 'cache', 'audit']), false) as some_feature from action_catalog",
    "journal_names": "select case when generation > 0 then execution_id || '|generation:' || generation else execution_id end as journal, count(*) as n from execution_identities group by 1",
    "hedged_latency": f"select lower(trim(action)) as action, cast(max(least(ns, 50000000 + floor(ns / 2))) as bigint) as slowest from (select action, {DURATION_SQL}::hugeint::decimal(38,1) as ns from action_events) where ns is not null group by 1",
}
