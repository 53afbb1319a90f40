"""Policies in their fixed order, and the cache in layers."""

import threading

import pytest
from pyspark.sql import functions as F

from weirflow.errors import FlowError
from weirflow.operators import folds
from weirflow.order import order
from weirflow.plans.policy import Breaker, Resilience


def failing(times, kind="Timeout"):
    left = [times]

    def fn():
        if left[0]:
            left[0] -= 1
            raise FlowError(kind, "no")
        return "done"

    return fn


def test_retries_lie_within_the_breaker():
    """Three attempts that end well count as no failure; three that end badly as one."""
    now = [0.0]
    b = Breaker(2, 10, lambda: now[0])
    r = Resilience(retries=2, breaker=b, sleep=lambda s: None)
    assert r.call(failing(2)) == "done"
    for _ in range(2):
        with pytest.raises(FlowError):
            r.call(failing(3))
    with pytest.raises(FlowError) as e:
        r.call(failing(0))
    assert e.value.kind == "Unavailable"
    now[0] = 11
    assert r.call(failing(0)) == "done" and r.call(failing(0)) == "done"


def test_permanent_errors_neither_retry_nor_count():
    b = Breaker(1, 10)
    r = Resilience(retries=3, breaker=b, sleep=lambda s: None)
    for _ in range(3):
        with pytest.raises(FlowError) as e:
            r.call(failing(1, "NotFound"))
        assert e.value.kind == "NotFound"


def test_concurrency_comes_first():
    r, inside, go = Resilience(max_concurrent=1, breaker=Breaker(1, 10)), threading.Event(), threading.Event()
    t = threading.Thread(target=lambda: r.call(lambda: (inside.set(), go.wait(5))))
    t.start()
    inside.wait(5)
    with pytest.raises(FlowError) as e:
        r.call(lambda: 1)
    go.set()
    t.join()
    assert e.value.kind == "RateLimited" and r.call(lambda: 1) == 1  # the refusal was no failure of the breaker


def test_settings_are_checked():
    for bad in ({"retries": -1}, {"timeout_s": -1}, {"max_concurrent": -1}, {"breaker": Breaker(1, 1), "adaptive": Breaker(1, 1)}):
        with pytest.raises(FlowError):
            Resilience(**bad)
    with pytest.raises(FlowError):
        Breaker(0, 1)
    with pytest.raises(FlowError):
        Resilience(timeout_s=1).call(lambda: 1)


def test_cache_layers_fill_the_faster_ones(spark):
    rows = [(1, 0, True), (2, 5, True), (3, 15, True), (4, 20, True), (5, 120, False), (6, 121, True), (7, 122, True)]
    df = spark.createDataFrame(rows, "i int, t bigint, ok boolean").withColumn("k", F.lit("k"))
    out = folds.layered_cache([10, 100], F.col("t"), F.col("ok"), order("t", keys=("k",)))(df)
    # stored at 0; fast until 10; slow hit at 15 fills the fast one until 25; a failed miss at 120 stores nothing
    assert [r["layer"] for r in out.orderBy("i").collect()] == [None, 0, 1, 0, None, None, 0]
    with pytest.raises(ValueError):
        folds.layered_cache([], F.col("t"), F.col("ok"), order("t"))
