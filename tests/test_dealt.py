import datetime as dt
import random

from pyspark.sql import functions as F

from weirflow.operators.feature_table import column_stems, feature_table, pivot_features
from weirflow.operators.hierarchy import ancestor_pairs, descendant_counts, findings, hierarchy, links
from weirflow.operators.hot_keys import compress, hot_keys, percentiles, profile, unpivot_keys
from weirflow.operators.sessions import sessions
from weirflow.operators.skew import join_to_unique

SCHEMA = "tenant string, kind string, time timestamp_ntz, attempt int, n bigint, `__fp_a` string, `a.b` string"
T = dt.datetime(2020, 1, 1)


def features(spark, rows, **kw):
    return feature_table(spark.createDataFrame(rows, SCHEMA), "tenant", "kind", "time", "attempt", ids=["tenant", "kind", "a.b"], others=["time", "attempt"], **kw)


def test_feature_table_cases(spark):
    h = dt.timedelta(hours=1)
    rows = [
        (" A ", "x.y", T, 1, 1, "clash", "1"), ("a", "X.Y", T, 1, 2, "clash", "1"),  # one record, delivered twice, spelled otherwise
        ("a", "x.y", T + h, None, 3, None, "2"), ("a", None, T + 2 * h, 5, 4, None, "3"), ("a", "z", None, 2, 5, None, "4"), (None, "x.y", T + 9 * h, 1, 6, None, "5"), ("  ", "z", T, 1, 7, None, "6"),
    ]
    got = features(spark, rows).collect()
    assert len(got) == 1
    r, us = got[0], int(T.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    assert (r["entity"], r["n_records"], r["total"], r["last_us"]) == ("a", 4, 8, us + 7_200_000_000)
    assert (r["n__x_y"], r["total__x_y"], r["last_us__x_y"], r["age_us__x_y"]) == (2, 1, us + 3_600_000_000, 8 * 3_600_000_000)
    assert (r["n__z"], r["last_us__z"], r["total__z"]) == (1, None, 2)
    assert features(spark, [], types=["q"]).collect() == [] and features(spark, []).collect() == []
    assert features(spark, rows, types=["none"]).first()["n__none"] == 0


def test_too_many_types_is_an_error(spark):
    long = spark.range(20).select(F.lit("e").alias("entity"), F.col("id").cast("string").alias("event_type"), F.lit(1).alias("n"), F.lit(1).alias("last_us"), F.lit(0).alias("total"))
    try:
        pivot_features(long, max_types=10)
    except ValueError as e:
        assert "explicit list" in str(e)
    else:
        raise AssertionError
    assert column_stems(["a.b", "a_b", "a-b", "a_b_2"]) == ["a_b", "a_b_2", "a_b_3", "a_b_2_2"] or len(set(column_stems(["a.b", "a_b", "a-b", "a_b_2"]))) == 4


def test_hot_keys_and_profiles(spark):
    rows = [("hot", "k%d" % (i % 3), i) for i in range(300)] + [(f"t{i}", "k", None) for i in range(60)] + [(None, "k", 5), (" ", "k", 5), (" HOT", "q", 1)]
    df = spark.createDataFrame(rows, "tenant string, kind string, v bigint").withColumn("action", F.lit("x"))
    found = {(r["key_field"], r["key_value"]): r["n_rows"] for r in hot_keys(df, ["tenant", "action"], "kind", 3).collect()}
    assert found == {("tenant", "hot"): 301, ("action", "x"): 363}
    assert hot_keys(df.limit(0), ["tenant"], "kind", 3).count() == 0
    p = {r["key_value"]: r for r in profile(compress(unpivot_keys(df, ["tenant"], {"v": F.col("v")}), ["key_value"], "v"), ["key_value"]).collect()}
    assert (p["hot"]["n_distinct"], p["hot"]["mode"], p["hot"]["mode_rows"]) == (300, 1, 2) and (p["t1"]["n_values"], p["t1"]["mode"]) == (0, None)


def test_percentiles_against_sorting(spark):
    rnd = random.Random(3)
    values = {"a": [rnd.randrange(-(10**6), 10**9) for _ in range(500)] + [-(2**63), 2**63 - 1, 0, 0, 0], "b": [7] * 40, "c": [1, 2]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("d", None)], "k string, v bigint")
    got = {(r["k"], r["permille"]): r["value"] for r in percentiles(compress(df, ["k"], "v"), ["k"], [0, 500, 990, 1000], bits=4).collect()}
    want = {(k, p): sorted(vs)[max(1, -(-len(vs) * p // 1000)) - 1] for k, vs in values.items() for p in (0, 500, 990, 1000)}
    assert got == want


def test_sessions_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [("hot", T + dt.timedelta(minutes=rnd.randrange(6000)), rnd.randrange(3)) for _ in range(900)] + [(f"u{i % 40}", T + dt.timedelta(minutes=rnd.randrange(3000)), 0) for i in range(300)]
    rows += rows[:200] + [(None, T, 0), ("x", None, 0), (" HOT ", T, 1), ("edge", T, 0), ("edge", T + dt.timedelta(minutes=30), 0), ("edge", T + dt.timedelta(minutes=60, seconds=1), 0)]
    df = spark.createDataFrame(rows, "u string, t timestamp_ntz, x int").withColumn("edge", F.lit(1)).withColumn("k", F.lit("clash"))
    by = {}
    for u, t, x in rows:
        if u and t:
            by.setdefault(u.strip().lower(), set()).add((t, x))
    want = set()
    for u, s in by.items():
        s = sorted(s)
        begin, last, n = s[0][0], s[0][0], 0
        for t, _ in s:
            if t - last > dt.timedelta(minutes=30):
                want.add((u, begin, last, n))
                begin, n = t, 0
            last = t
            n += 1
        want.add((u, begin, last, n))
    us = lambda t: int(t.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    for parts in (None, 1, 13):
        got = {(r["key"], r["start_us"], r["end_us"], r["n_events"]) for r in sessions(df, "u", "t", 30 * 60 * 10**6, ids=["u"], others=["t", "x"], partitions=parts).collect()}
        assert got == {(u, us(a), us(b), n) for u, a, b, n in want}
    assert sessions(df.limit(0), "u", "t", 1).count() == 0
    assert sum(r["n_events"] for r in sessions(df, "u", "t", 1).collect()) == len([r for r in rows if r[0] and r[1]])


def brute(parent):
    out = {}
    for n in parent:
        path, seen, x = [n], {n}, parent[n]
        while x is not None and x in parent and x not in seen:
            path.append(x)
            seen.add(x)
            x = parent[x]
        if x in seen:
            ring, y = {x}, parent[x]
            while y != x:
                ring.add(y)
                y = parent[y]
            out[n] = ("on_cycle" if n in ring else "below_cycle", None, None, None)
        else:
            own = parent[n] is not None and parent[n] not in parent
            out[n] = ("missing_parent" if own else "rooted", path[-1], len(path) - 1, path[::-1])
    return out


def test_hierarchy_against_walking(spark):
    rnd = random.Random(11)
    parent = {f"n{i}": (f"n{rnd.randrange(i)}" if i and rnd.random() < 0.9 else None) for i in range(120)}
    parent |= {f"c{i}": f"c{i + 1}" for i in range(37)} | {"c37": None}  # a chain
    parent |= {"r0": "r1", "r1": "r2", "r2": "r0", "s": "s", "b1": "r0", "b2": "b1", "m": "gone", "m2": "m", "b3": "s"}
    parent |= {f"h{i}": "n0" for i in range(60)}  # a hot parent
    df = spark.createDataFrame(list(parent.items()), "node string, parent string").repartition(3)
    want = brute(parent)
    nodes = hierarchy(links(df, "node", "parent"), hot_rows=20)
    got = {r["node"]: (r["state"], r["root"], r["depth"], list(r["path"]) if r["path"] else None) for r in nodes.collect()}
    assert got == want
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in ancestor_pairs(nodes).collect()}
    assert pairs == {(p[i], n, len(p) - 1 - i) for n, (_, _, _, p) in want.items() if p for i in range(len(p) - 1)}
    assert {r["node"]: r["n_descendants"] for r in descendant_counts(nodes).collect()}["c37"] == 37
    bare = {r["node"]: (r["state"], r["root"], r["depth"]) for r in hierarchy(links(df, "node", "parent"), with_paths=False).collect()}
    assert bare == {n: w[:3] for n, w in want.items()}
    roots = spark.createDataFrame([("c0", "c37"), ("c1", "n0"), ("m2", "zzz"), ("s", "q"), ("n0", None)], "node string, named_root string")
    found = {r["node"]: r["finding"] for r in findings(nodes, roots).collect()}
    assert found == {n: w[0] for n, w in want.items() if w[0] != "rooted"} | {"c1": "wrong_root"}
    assert hierarchy(df.limit(0)).count() == 0


def test_only_a_cycle_and_only_a_chain(spark):
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)], "node string, parent string")
    assert {r["state"] for r in hierarchy(ring).collect()} == {"on_cycle"}
    chain = spark.createDataFrame([("a", None)] + [(chr(98 + i), chr(97 + i)) for i in range(5)], "node string, parent string")
    assert sorted(r["depth"] for r in hierarchy(chain).collect()) == list(range(6))


def test_levels_and_bands_agree(spark):
    """A bush, a long chain and nodes below a cycle: level by level to the end, in bands from the start, and as both take turns."""
    rnd = random.Random(5)
    parent = {f"n{i}": (f"n{rnd.randrange(max(1, i // 3))}" if i else None) for i in range(150)}
    parent |= {f"c{i}": f"c{i - 1}" if i else "n149" for i in range(23)} | {"s": "s", "s1": "s", "s2": "s1", "s3": "s2"}
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    want = brute(parent)
    for thin in (0, 0.125, 1.1):
        got = {r["node"]: (r["state"], r["root"], r["depth"], list(r["path"]) if r["path"] else None) for r in hierarchy(df, thin=thin).collect()}
        assert got == want


def test_salted_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, "hot").when(F.col("id") < 710, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("710", 2), ("nobody", 3)], "rk string, v int")
    got = join_to_unique(left, right, "k", "rk", hot_rows=100, salts=8)
    assert got.count() == 1000 and got.where("v = 1").count() == 700 and got.where("v is null").count() == 299
