import pytest
from pyspark.sql import functions as F

from weirflow.errors import FlowError
from weirflow.plans.graph import Builder
from weirflow.plans.hooks import Hook, hooked, inspect, wrapped
from weirflow.plans.stage import Stage, compose, filter_stage
from weirflow.sources.writers import lines, once_per_batch, write_atomic


def test_hooks_tell_and_do_not_disturb(spark):
    told = []
    noisy = Hook(before=lambda s, d: told.append("before1"), after=lambda s, o, e: told.append(f"after1 {type(e).__name__}"), success=lambda s, o: 1 / 0)
    other = Hook(before=lambda s, d: told.append("before2"), after=lambda s, o, e: told.append("after2"), error=lambda s, e: told.append("error2"), timeout=lambda s: told.append("timeout2"))
    unwanted = Hook(before=lambda s, d: told.append("never"), wanted=lambda s: False)
    s = filter_stage("f", F.col("id") > 1)
    assert hooked(s, unwanted) is s
    assert hooked(s, noisy, other, unwanted)(spark.range(5)).count() == 3
    assert told == ["before1", "before2", "after2", "after1 NoneType"]
    told.clear()

    def late(df):
        raise FlowError("Timeout", "x")

    with pytest.raises(FlowError):
        hooked(Stage("t", late), noisy, other)(spark.range(1))
    assert told == ["before1", "before2", "timeout2", "error2", "after2", "after1 FlowError"]


def test_middleware_and_inspection(spark):
    seen = []

    def mark(name):
        return lambda fn: lambda df: (seen.append(name), fn(df))[1]

    s = filter_stage("f", F.col("id") > 1)
    assert wrapped(s, mark("outer"), mark("inner"))(spark.range(3)).count() == 1 and seen == ["outer", "inner"]
    nodes, edges, cut = inspect(compose(s, s))
    assert [n[1] for n in nodes] == ["compose(f -> f)", "f", "f"] and (1, 2, "then") in edges and not cut
    g = Builder().node("a", lambda st: None).node("b", lambda st: None).edge("a", "b").compile()
    assert inspect(g, max_nodes=2)[2] and len(inspect(g)[1]) == 3
    with pytest.raises(FlowError):
        inspect("x")


def test_writers(spark, tmp_path):
    write_atomic(str(tmp_path / "f"), b"one")
    write_atomic(str(tmp_path / "f"), b"two")
    assert (tmp_path / "f").read_bytes() == b"two" and [p.name for p in tmp_path.iterdir()] == ["f"]
    sink = once_per_batch(str(tmp_path / "out"))
    for _ in range(2):
        sink(spark.range(3), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    lines(spark.createDataFrame([("a",)], "line string"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "a"
