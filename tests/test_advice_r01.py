"""Queries over small tables made here, their results worked out by hand: whole input, not only its convenient rows."""

import datetime as dt

import __spark_entry__ as entry
from weirflow.operators import observe
from weirflow.order import order

T0 = dt.datetime(2024, 1, 1)
EVENTS = "line_no bigint, time timestamp_ntz, duration string, duration_ns bigint, kind string, action string, request_id string"


def run(spark, folder, name, rows, schema=EVENTS, **tables):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/action_events.parquet")
    for t, (r, s) in tables.items():
        spark.createDataFrame(r, s).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect())


#: Durations as number only, as text only, as both, and none.
DURATIONS = [
    (1, T0, None, 500_000_000, "success", "a", "r1"),
    (2, T0, " 2s ", None, "Success", "A ", "r2"),
    (3, T0, "3s", 3_000_000_000, "retry", "a", "r2"),
    (4, T0, "soon", None, "success", "a", "r3"),
    (5, T0, None, None, "success", "a", "r3"),
]


def test_over_timeout_counts_durations_given_as_text(spark, tmp_path):
    assert run(spark, tmp_path, "over_timeout", DURATIONS, action_catalog=([("a", 1_000_000_000)], "name string, timeout_ns bigint")) == [("a", 2, 5)]


def test_slow_calls_counts_durations_given_as_text(spark, tmp_path):
    assert run(spark, tmp_path, "slow_calls", DURATIONS) == [("retry", 1, 3_000_000_000), ("success", 1, 2_000_000_000)]


def test_race_winner_takes_durations_given_as_text(spark, tmp_path):
    assert run(spark, tmp_path, "race_winner", DURATIONS) == [("r1", "success", 500_000_000, True, None), ("r2", "success", 2_000_000_000, True, "retry")]


def test_calls_in_flight_counts_durations_given_as_text(spark, tmp_path):
    assert run(spark, tmp_path, "calls_in_flight", DURATIONS) == [("a", 3)]


def test_hedged_latency_takes_durations_given_as_text(spark, tmp_path):
    assert run(spark, tmp_path, "hedged_latency", [DURATIONS[0], DURATIONS[1]]) == [("a", 1_050_000_000)]


#: More keys than a thousand, the first of them twice; letter case and blanks make no other key.
MANY_KEYS = [(i, T0, None, None, "Start ", f"a{i:04}", None) for i in range(1, 1201)] + [(1201, T0, None, None, "start", " A0001", None)]


def test_metrics_count_keeps_more_than_a_thousand_keys(spark, tmp_path):
    got = run(spark, tmp_path, "metrics_count", MANY_KEYS)
    assert got == [(f"a{i:04}", "start", 2 if i == 1 else 1, 0) for i in range(1, 1201)]


def test_prometheus_text_writes_more_than_a_thousand_keys(spark, tmp_path):
    got = run(spark, tmp_path, "prometheus_text", MANY_KEYS)
    assert len(got) == 1200 and got[0] == (1, 'events_total{action="a0001",kind="start"} 2') and got[-1] == (1200, 'events_total{action="a1200",kind="start"} 1')


def test_metrics_overflow(spark):
    """The keys first seen are kept; later keys and labels that are too long count as overflow."""
    rows = [(3, "c", "start"), (1, "b", "start"), (2, "a", "start"), (4, "a", "start"), (5, "x" * 129, "start"), (6, "c", "start")]
    out = observe.metrics(spark.createDataFrame(rows, "line_no int, action string, kind string"), "action", "kind", order("line_no"), max_keys=2)
    assert {tuple(r) for r in out.collect()} == {("b", "start", 1, 0), ("a", "start", 2, 0), (None, None, 0, 3)}


LONGEST = 2**63 - 1
DAY_NS = 86_400_000_000_000
HOURS = [T0 + dt.timedelta(hours=i) for i in range(100)]


def test_calls_in_flight_counts_long_and_negative_durations(spark, tmp_path):
    rows = [
        # three overlap on the fourth day, two of them longer than a day
        (1, HOURS[0], None, 4 * DAY_NS, "success", "long", None), (2, HOURS[1], None, LONGEST, "success", "long", None), (3, HOURS[80], None, 1, "success", "long", None),
        # a negative duration is in flight at its time only: beside the call it falls into, not beside one an hour later or before
        (4, HOURS[1], None, -DAY_NS, "success", "back", None), (5, HOURS[0], None, 5_400_000_000_000, "success", "back", None), (6, HOURS[2], None, -LONGEST - 1, "success", "back", None),
        (7, HOURS[0], None, -5, "success", "alone", None), (8, HOURS[1], None, 0, "success", "alone", None),
    ]
    assert run(spark, tmp_path, "calls_in_flight", rows) == [("alone", 1), ("back", 2), ("long", 3)]


def test_calls_in_flight_of_the_latest_time(spark, tmp_path):
    """Ends beyond 64 bits of microseconds."""
    rows = spark.createDataFrame([("a", None, LONGEST), ("a", None, 0)], "action string, duration string, duration_ns bigint")
    rows.selectExpr("*", "timestamp_ntz'+294247-01-10 04:00:54.775807' as time").write.parquet(f"{tmp_path}/action_events.parquet")
    assert [tuple(r) for r in entry.queries()["calls_in_flight"](spark, str(tmp_path)).collect()] == [("a", 2)]


def test_hedged_latency_takes_extreme_durations(spark, tmp_path):
    rows = [(1, T0, None, 5, "success", "a", None), (2, T0, None, LONGEST, "success", "a", None), (3, T0, None, -7, "success", "b", None), (4, T0, None, -9, "success", "b", None), (5, T0, None, 2 * DAY_NS + 3, "success", "c", None)]
    assert run(spark, tmp_path, "hedged_latency", rows) == [("a", LONGEST // 2 + 50_000_000), ("b", -7), ("c", DAY_NS + 1 + 50_000_000)]


def test_error_class_count_takes_kinds_in_any_spelling(spark, tmp_path):
    kinds = ["timeout", "Timeout", " RETRY\t", "Canceled ", "ERROR", "success", " ", None]
    rows = [(i, T0, None, None, k, "a", None) for i, k in enumerate(kinds)]
    assert run(spark, tmp_path, "error_class_count", rows) == [("neither", 2), ("permanent", 3), ("transient", 3)]
