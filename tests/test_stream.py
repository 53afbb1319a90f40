import random

import pytest
from pyspark.sql import functions as F

from weirflow.errors import FlowError, error, no_error, split, stop_at_first
from weirflow.operators import compose as k
from weirflow.operators import folds, stream
from weirflow.order import order, ordinal
from weirflow.sources.readers import confined, from_rows, pull_source, verified_files

O = order("_i")  # noqa: E741


def ints(spark, *values):
    return from_rows(spark, [(v,) for v in values], "value int").repartition(3)


def items(df, by="batch"):
    return [list(r["items"]) for r in df.orderBy(by).collect()]


def test_vectors(spark):
    v = F.col("value")
    df = ints(spark, 1, 2, 3, 4)
    out = k.chain(stream.map_(value=v * 2), stream.filter_(v % 2 == 0), stream.take(2, O))(df)
    assert [r["value"] for r in out.orderBy("_i").collect()] == [2, 4]
    bad = stream.map_e("value", v, v == 2, order("_i"))(ints(spark, 1, 2, 3)).orderBy("_i").collect()
    assert [(r["value"], r["_error"] is not None) for r in bad] == [(1, False), (None, True)]
    assert items(stream.batch(2, O, v)(ints(spark, 1, 2, 3))) == [[1, 2], [3]]
    assert list(stream.collect(3, O, v)(ints(spark, 1, 2, 3)).first()["items"]) == [1, 2, 3]
    with pytest.raises(Exception, match="more than 2 items"):
        stream.collect(2, O, v)(ints(spark, 1, 2, 3)).collect()
    assert stream.fold(F.lit(0), F.sum("value"), lambda a, b: a + b)(ints(spark, 1, 2, 3)).first()["result"] == 6
    assert [r["v"] for r in stream.flat_map("v", F.array(v, v * 10))(ints(spark, 1, 2)).orderBy("_i", "v").collect()] == [1, 10, 2, 20]
    assert [r["value"] for r in stream.distinct_by(O, v)(ints(spark, 1, 2, 2, 3, 1, 4, 3, 5)).orderBy("_i").collect()] == [1, 2, 3, 4, 5]
    assert items(stream.window(3, 2, O, v)(ints(spark, 1, 2, 3, 4, 5)), "window") == [[1, 2, 3], [3, 4, 5], [5]]
    assert items(stream.window(2, 3, O, v)(ints(spark, 1, 2, 3, 4, 5)), "window") == [[1, 2], [4, 5]]
    assert items(stream.window(2, 1, O, v)(ints(spark, 1, 2, 3, 4)), "window") == [[1, 2], [2, 3], [3, 4], [4]]
    users = from_rows(spark, [("u1", "Alice"), ("u2", "Bob"), ("u1", "Alice Clone"), ("u3", "Charlie")], "id string, name string")
    assert [r["name"] for r in stream.distinct_by(O, F.col("id"))(users).orderBy("_i").collect()] == ["Alice", "Bob", "Charlie"]
    assert stream.take(0, O)(df).count() == 0 and stream.ticks(spark, 0, 5).count() == 0
    assert {r["dt_ns"] for r in stream.ticks(spark, 100, 5).collect()} == {10_000_000}
    for bad_call in (lambda: stream.batch(0, O, v), lambda: stream.window(1, 0, O, v), lambda: stream.ticks_checked(spark, 0, 1), lambda: stream.ticks(spark, 2 * 10**9, 1), lambda: stream.collect(0, O, v), lambda: order()):
        with pytest.raises((FlowError, ValueError)):
            bad_call()


def test_empty_streams(spark):
    none = ints(spark, 1).where("value > 1")
    v = F.col("value")
    assert stream.batch(2, O, v)(none).count() == 0 and stream.window(3, 1, O, v)(none).count() == 0
    assert ordinal(none.drop("_i"), order("value")).count() == 0
    assert list(stream.collect(None, O, v)(none).first()["items"]) == []
    assert stream.reduce_(F.lit(7), lambda a, x: a + x, O, v)(none).first()["result"] == 7


def test_errors_pass(spark):
    df = ints(spark, 1, 2, 3, 4).withColumn("_error", F.when(F.col("value") == 2, error("Timeout", "x")).otherwise(no_error()))
    kept = stream.take(2, O)(df).orderBy("_i").collect()
    assert [r["value"] for r in kept] == [1, 2, 3]
    assert [r["value"] for r in stop_at_first(df, O).orderBy("_i").collect()] == [1, 2]
    assert items(stream.batch(5, O, F.col("value"))(df)) == [[1]]
    assert [d.count() for d in split(df)] == [3, 1]
    assert [r["value"] for r in stream.filter_(F.col("value") > 3)(df).orderBy("_i").collect()] == [2, 4]


def test_global_ordinal_with_ties_elsewhere(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("x")).repartition(7)
    got = ordinal(df, order("x")).orderBy("x").collect()
    assert [r["_i"] for r in got] == list(range(2000))


def test_hot_keys_are_numbered_alike(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 50}", rnd.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    o = order("t", "id", keys=("k",))
    plain = sorted((r["id"], r["_i"]) for r in ordinal(df, o).collect())
    assert sorted((r["id"], r["_i"]) for r in ordinal(df, o, hot_rows=300).collect()) == plain
    a = sorted((r["k"] or "", r["batch"], list(r["items"])) for r in stream.batch(7, o, F.col("id"), hot_rows=300)(df).collect())
    assert a == sorted((r["k"] or "", r["batch"], list(r["items"])) for r in stream.batch(7, o, F.col("id"))(df).collect())
    assert ordinal(df, o, hot_rows=10**9).count() == 3000


def timed(spark, seed, users=4, n=160):
    rnd = random.Random(seed)
    rows = [(u, t, i) for i, (u, t) in enumerate((rnd.randrange(users), rnd.randrange(1000)) for _ in range(n))]
    return rows, spark.createDataFrame(rows, "u int, t bigint, id int").repartition(3)


def streams(rows):
    by = {}
    for u, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(u, []).append((t, i))
    return by


@pytest.mark.parametrize("seed", [1, 2])
def test_timed_operators_against_loops(spark, seed):
    rows, df = timed(spark, seed)
    o = order("t", "id", keys=("u",))
    t = F.col("t")
    go, quiet, batches, fold_ = set(), set(), {}, {}
    for u, s in streams(rows).items():
        last, first, n = None, None, 0
        for j, (x, i) in enumerate(s):
            if last is None or x - last >= 50:
                go.add(i)
                last = x
            if j + 1 == len(s) or s[j + 1][0] - x >= 20:
                quiet.add(i)
            if first is None or n >= 3 or x >= first + 40:
                first, n = x, 0
            batches[i] = (first, n)
            n += 1
        fold_[u] = s
    assert {r["id"] for r in folds.throttle(50, t, o)(df).collect()} == go
    assert {r["id"] for r in stream.debounce(20, t, o)(df).collect()} == quiet
    assert {r["id"]: (r["batch_start"], r["batch_pos"]) for r in folds.batch_by_time(3, 40, t, o)(df).collect()} == batches
    for size, step in ((3, 2), (2, 5), (4, 1), (3, 3)):
        want = set()
        for u, s in fold_.items():
            buffer, skip, out = [], 0, []
            for _, i in s:
                if skip:
                    skip -= 1
                    continue
                buffer.append(i)
                if len(buffer) == size:
                    out.append(tuple(buffer))
                    skip = max(0, step - size)
                    buffer = buffer[step:] if step < size else []
            if buffer:
                out.append(tuple(buffer))
            want |= {(u, *w) for w in out}
        assert {(r["u"], *r["items"]) for r in stream.window(size, step, o, F.col("id"))(df).collect()} == want, (size, step)


def test_breaker_probe(spark):
    calls = [(0, "timeout"), (1, "timeout"), (2, "success"), (12, "permanent"), (13, "timeout"), (14, "permanent"), (15, "timeout"), (25, "canceled"), (26, "success"), (35, "success"), (36, "success")]
    df = spark.createDataFrame([(t, o, 1) for t, o in calls], "t bigint, out string, k int")
    got = folds.circuit_breaker(2, 10, F.col("t"), F.col("out"), order("t", keys=("k",)))(df).orderBy("t").collect()
    assert [r["decision"] for r in got] == ["allowed", "allowed", "rejected", "probe", "allowed", "allowed", "allowed", "probe", "rejected", "probe", "allowed"]
    assert [r["state"] for r in got] == ["closed", "open", "open", "closed", "closed", "closed", "open", "open", "open", "closed", "closed"]


def test_composition(spark):
    df = ints(spark, 1, 2, 3)
    v = F.col("value")
    got = k.branch("out", v.cast("string"), {"1": v, "2": v * 10})(df).orderBy("_i").collect()
    assert [(r["out"], r["_error"] and r["_error"]["kind"]) for r in got] == [(1, None), (20, None), (None, "NotFound")]
    first = k.first_success("x", [(v > 1, F.lit(None).cast("int")), (F.lit(True), v)])(df).orderBy("_i").collect()
    assert [(r["x"], r["_error"]) for r in first] == [(1, None), (None, None), (None, None)]  # a null result is a success
    with pytest.raises(FlowError):
        k.parallel_map("m", [("a", v), ("a", v)])
    late = k.loop("x", v, lambda x: x + 1, lambda x: x >= 4, 2)(df).orderBy("_i").collect()
    assert [(r["x"], r["x_turns"]) for r in late] == [(None, 2), (4, 2), (4, 1)]

    def work(b):
        if (b["value"] == 2).any():
            raise RuntimeError("bad")
        return b[["value"]]

    got = k.worker_pool(work, "value int, _error string")(df.repartitionByRange(3, "value")).collect()
    assert sorted((r["value"] or 0, bool(r["_error"])) for r in got) == [(0, True), (1, False), (3, False)]


def test_sources(spark, tmp_path):
    spark.dataSource.register(pull_source("pulled", "n int", lambda p: ((p * 10 + i,) for i in range(2)), partitions=2))
    assert sorted(r["n"] for r in spark.read.format("pulled").load().collect()) == [0, 1, 10, 11]
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = verified_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("f"), "length", "digest").first()
    assert files["length"] == 3 and files["digest"].startswith("ba7816bf")
    assert confined("/r", "a/../b") == "/r/b"
    for p in ("../x", "/etc", "", "a/../../x"):
        with pytest.raises(FlowError):
            confined("/r", p)
