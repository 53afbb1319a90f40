from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from weirflow.errors import FlowError, is_permanent, is_transient, require
from weirflow.operators import observe, stateful
from weirflow.order import order
from weirflow.plans.graph import Builder, ExecutionError, Suspend, key, layer_table, layers, load, mermaid, output, save
from weirflow.plans.policy import Drain, FencedLock, Journal, Saga, deadline, first_done, in_parallel, retry
from weirflow.plans.stage import Meta, Proxy, Registry, Stage, compose, distinct_stage, filter_stage, once, take_stage


def num(spark, n):
    return spark.range(n).withColumnRenamed("id", "x")


def test_layers_and_compile(spark):
    assert layers(dict.fromkeys("abc"), {("a", "c"), ("b", "c")}) == [["a", "b"], ["c"]]
    make = lambda s: num(spark, 1)
    with pytest.raises(FlowError, match="cycle"):
        Builder().node("a", make).node("b", make).edge("a", "b").edge("b", "a").compile()
    with pytest.raises(FlowError, match="do not mix"):
        Builder().node("a", make).node("b", make).edge("a", "b").route("a", lambda s: "b").compile()
    for b in (Builder().node("a", make).node("a", make), Builder().node("a", make).edge("a", "z"), Builder(), Builder().node("", make)):
        with pytest.raises(FlowError):
            b.compile()
    with pytest.raises(FlowError, match="cycle"):
        layer_table(spark.createDataFrame([("a",), ("b",), ("s",)], "id string"), spark.createDataFrame([("a", "b"), ("b", "a"), ("s", "a")], "from_id string, to_id string"))
    assert mermaid(["ai.synthesize", "a"], [("a", "ai.synthesize")]).splitlines() == ["flowchart LR", '    id_a["a"]', '    id_ai_synthesize["ai.synthesize"]', "    id_a --> id_ai_synthesize"]


def test_run_checkpoint_and_resume(spark, tmp_path):
    ran = []

    def node(name, f):
        def make(s):
            ran.append(name)
            return f(s)

        return make

    broken = [True]

    def last(s):
        if broken[0]:
            raise Suspend("later")
        return output(s, "a").join(output(s, "b"), "x")

    g = Builder().node("a", node("a", lambda s: num(spark, 5))).node("b", node("b", lambda s: num(spark, 3))).node("c", node("c", last)).edge("a", "c").edge("b", "c").compile()
    seen = []
    with pytest.raises(ExecutionError) as e:
        g.run(on_layer=lambda names, s: seen.append(names), materialize=True)
    assert e.value.suspended and e.value.completed == ["a", "b"] and seen == [["a", "b"]]
    save(e.value.state, str(tmp_path))
    broken[0], ran[:] = False, []
    state = g.run(load(spark, str(tmp_path), [key(n) for n in "abc"]))
    assert output(state, "c").count() == 3 and ran == ["c"]
    with pytest.raises(FlowError, match="no output"):
        output(state, "zz")


def test_routed_runs_and_nested_graphs(spark):
    runs = []

    def draft(s):
        runs.append("draft")
        return num(spark, len([r for r in runs if r == "draft"]))

    g = Builder().node("draft", draft).node("review", lambda s: (runs.append("review"), output(s, "draft"))[1])
    g = g.route("draft", lambda s: "review" if output(s, "draft").count() < 2 else "end").route("review", lambda s: "draft").compile()
    g.run()
    assert runs == ["draft", "review", "draft"]
    with pytest.raises(ExecutionError, match="steps"):
        Builder().node("a", lambda s: num(spark, 1)).route("a", lambda s: "a").compile(max_steps=3).run()
    inner = Builder().node("seed", lambda s: num(spark, 4)).node("twice", lambda s: output(s, "seed").select((F.col("x") * 2).alias("x"))).edge("seed", "twice").compile()
    outer = Builder().node("sub", inner).node("end_", lambda s: output(s, "sub").where("x > 2")).edge("sub", "end_").compile()
    assert output(outer.run(), "end_").count() == 2


def test_stages_and_registry(spark):
    o = order("x")
    p = compose(filter_stage("f", F.col("x") > 1), filter_stage("g", F.col("x") < 8), distinct_stage("d", o, "x"), distinct_stage("d2", o, "x"), take_stage("t5", 5, o), take_stage("t3", 3, o))
    assert p.explain() == ["f&g", "d", "t3"] and sorted(r["x"] for r in p(num(spark, 20)).collect()) == [2, 3, 4]
    assert p.name.startswith("compose(f -> g")
    with pytest.raises(FlowError):
        compose()
    with pytest.raises(FlowError, match="no column"):
        Stage("s", lambda d: d, in_schema=spark.range(1).withColumnRenamed("id", "q").schema)(num(spark, 1))

    @dataclass
    class Config:
        least: int = 0
        names: list = field(default_factory=list)
        strict: bool = False

    r = Registry()
    r.add(sources={"numbers": lambda s, n: num(s, n)}, operators={"above": (lambda c: filter_stage("above", F.col("x") > c.least), Config)}, aliases={"nums": "numbers"}, metas=[Meta("numbers", tags=("a",))])
    assert r.pipeline(spark, "nums", [("above", {"least": " 7 ", "strict": "t", "names": "a,,b"})], n=10).count() == 2
    for bad in ({"sources": {"numbers": None}}, {"aliases": {"z": "nothing"}}, {"override": ["nothing"]}):
        with pytest.raises(FlowError):
            r.add(**bad)
    for params in ({"least": "x"}, {"unknown": 1}, {"strict": "yes"}):
        with pytest.raises(FlowError):
            r.operator("above", **params)
    r.add(sources={"numbers": lambda s, n: num(s, 1)}, override=["numbers"])
    assert r.pipeline(spark, "numbers", [], n=10).count() == 1 and r.names() == ["above", "numbers", "nums"] and r.table(spark).count() == 1
    proxy = Proxy(lambda d: d.limit(1))
    before = proxy(num(spark, 5))
    proxy.swap(lambda d: d)
    assert (before.count(), proxy(num(spark, 5)).count()) == (1, 5)
    calls = []
    get = once(lambda: (calls.append(1), num(spark, 2))[1])
    assert get().count() + get().count() == 4 and len(calls) == 1


def test_policies(spark, tmp_path):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise FlowError("Timeout", "x")
        return "done"

    assert retry(flaky, 5, sleep=lambda s: None) == "done" and len(tries) == 3
    with pytest.raises(FlowError):
        retry(lambda: (_ for _ in ()).throw(FlowError("NotFound", "x")), 5, sleep=lambda s: None)
    assert deadline(spark, 60, lambda: num(spark, 3).count()) == 3
    assert first_done(lambda: (_ for _ in ()).throw(FlowError("Canceled", "x")), lambda: 7) == 7
    assert [r for r, _ in in_parallel([lambda: 1, lambda: 1 / 0, lambda: 3])] == [1, None, 3]
    undone = []
    saga = Saga().step("a", lambda x: x + 10, undone.append).step("b", lambda x: x * 2, undone.append)
    assert saga.run(5) == 10 and saga.run(5, chained=True) == 30
    saga.step("skip", lambda x: 1 / 0, optional=True).step("c", lambda x: [][0])
    with pytest.raises(IndexError):
        saga.run(5)
    assert saga.rolled_back and undone == [10, 15] and [s["success"] for s in saga.log] == [True, True, False, False]
    lock = FencedLock()
    with lock.hold("k") as fence:
        assert fence == 1
        with pytest.raises(FlowError), lock.hold("k"):
            pass
    with lock.hold("k") as fence:
        assert fence == 2
    drain = Drain()
    with drain.work():
        assert not drain.drain(0.01)
    assert drain.drain(1)
    with pytest.raises(FlowError), drain.work():
        pass
    journal, made = Journal(spark, str(tmp_path)), []
    for _ in range(2):
        assert journal.step("e1", "s", lambda: (made.append(1), num(spark, 3))[1]).count() == 3
    assert len(made) == 1
    with pytest.raises(FlowError):
        journal.step("e1", "", lambda: None)


def test_sinks_and_logs(spark):
    e = spark.createDataFrame([(1, "a" * 129, "k"), (2, 'x"\\', "ok"), (3, "y", "ok"), (4, "z", "ok"), (5, "y", "ok")], "id int, action string, kind string")
    m = observe.metrics(e, "action", "kind", order("id"), max_keys=2)
    assert {(r["action"], r["count"], r["overflow"]) for r in m.collect()} == {('x"\\', 1, 0), ("y", 2, 0), (None, 0, 2)}
    assert [r["line"] for r in observe.prometheus(m, "n").orderBy("line_no").collect()] == ['n{action="x\\"\\\\",kind="ok"} 1', 'n{action="y",kind="ok"} 2', "n_overflow 2"]
    t = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "seq bigint, v int")
    assert [r["v"] for r in observe.topic_read(t, "seq", 0, 2, 3).collect()] == [30, 40]
    assert [r["seq"] for r in observe.topic_append(t, spark.createDataFrame([(5,), (4,)], "v int"), "seq", order("v")).orderBy("v").collect()] == [6, 7]
    assert observe.ring_push(t, t, 7, order("seq")).count() == 7
    due = spark.createDataFrame([(i, d, i in (2, 8)) for i, d in enumerate([1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 100, 300])], "id int, delay bigint, c boolean")
    fired = stateful.timers_due(due, "id", "delay", "c", 1, 100).orderBy("firing").collect()
    assert [(r["id"], r["due_tick"]) for r in fired] == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 7), (6, 8), (7, 15), (9, 17), (10, 100)]
    kinds = spark.createDataFrame([("Timeout",), ("NotFound",), ("Internal",), (None,)], "k string")
    assert [tuple(r) for r in kinds.select(is_transient(F.col("k")), is_permanent(F.col("k"))).collect()] == [(True, False), (False, True), (False, False), (False, False)]
    assert require(kinds, F.col("k") == "Timeout", "Validation", "m").where("_error is null").count() == 1


def test_context(spark):
    from weirflow import context as x

    df = spark.createDataFrame([("u", "t", ["admin"], ["read"]), (None, "", None, ["*"])], "u string, t string, r array<string>, p array<string>")
    c = x.context({"user_id": F.col("u"), "tenant_id": F.col("t"), "roles": F.col("r"), "permissions": F.col("p")})
    got = df.withColumn("c", c).select(*[f.alias(n) for n, f in {"a": x.authenticated(F.col("c")), "t": x.of_tenant(F.col("c")), "r": x.has_role(F.col("c"), "admin", "x"), "m": x.may(F.col("c"), "write"), "s": F.length(x.scope(F.col("c")))}.items()]).collect()
    assert [tuple(r) for r in got] == [(True, True, True, False, 64), (False, False, False, True, 64)]
    assert df.select(c.alias("c")).schema["c"].dataType.simpleString().startswith("struct<request_id:string")
    with pytest.raises(ValueError):
        x.context({"nobody": F.col("u")})
    x.session_values(spark, {"release": "7"})
    assert x.with_session_values(df, "release").first()["release"] == "7"
