import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weirflow.llm import distinct as d
from weirflow.llm import percentiles as p


def want(values, q):
    return sorted(values)[max(1, -(-len(values) * q // 1000)) - 1]


def frame(spark, groups):
    rows = [(day, g, v) for g, vs in groups.items() for day, v in vs]
    return spark.createDataFrame(rows, "day int, g string, v bigint").repartition(3)


def test_selection_is_exact_over_many_chunks(spark):
    rnd = random.Random(2)
    groups = {"wide": [(i % 3, rnd.randrange(-(10**12), 10**15)) for i in range(3000)], "few": [(0, 5), (1, 5), (2, 9)], "same": [(0, 4)] * 500, "ends": [(0, -(2**63)), (0, 2**63 - 1)], None: [(0, i) for i in range(300)]}
    groups["skewed"] = [(0, 1)] * 2000 + [(1, i) for i in range(400)]
    df = frame(spark, groups)
    s = p.merge(p.states(df, ["day", "g"], "v", bits=63), ["g"])
    qs = [0, 500, 900, 990, 1000]
    rounds = []
    got = {(r["g"], r["permille"]): (r["value"], r["n"]) for r in p.multi_select(s, ["g"], qs, chunk=64, rounds=rounds).collect()}
    assert rounds[0] == len(groups) * len(qs) and len(rounds) > 5  # every rank of every group takes the rounds
    assert got == {(g, q): (want([v for _, v in vs], q), len(vs)) for g, vs in groups.items() for q in qs}
    assert p.multi_select(s.limit(0), ["g"], qs).count() == 0


def test_bins_bound_the_error_and_days_combine(spark):
    rnd = random.Random(4)
    values = [rnd.randrange(-(10**6), 10**6) * 10 ** rnd.randrange(12) for _ in range(2000)] + [0, 1, -1, 511, 512, -(2**63), 2**63 - 1]
    df = frame(spark, {"g": [(i % 5, v) for i, v in enumerate(values)]}).unionByName(spark.createDataFrame([(1, "g", None)], "day int, g string, v bigint"))
    for v, b in df.where("v is not null").select("v", p.bin_of(F.col("v"), 9)).collect():
        assert abs(b - v) <= abs(v) / 2**9 and (abs(v) >= 512 or b == v)
    days = p.states(df, ["day", "g"], "v", 9)
    whole = p.states(df, ["g"], "v", 9)
    a = sorted(map(tuple, p.merge(days, ["g"]).collect()))
    assert a == sorted(map(tuple, whole.collect()))
    for r in p.multi_select(p.merge(days, ["g"]), ["g"], [500, 990]).collect():
        exact = want(values, r["permille"])
        assert abs(r["value"] - exact) <= abs(exact) / 2**9


def ids(spark, n, off=0):
    return spark.range(off, off + n).select(F.concat(F.lit("u"), F.col("id")).alias("id"), (F.col("id") % 3).alias("day"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("t"))


def sketch_of(spark, df):
    return bytes(d.sketch(df.withColumn("k", F.lit(1)), ["k"], "id").first()["sketch"])


def test_estimates_are_within_the_stated_error(spark):
    errors = []
    for n in (1, 10, 300, 5000, 60000):
        for part in range(4):
            e = d.ml_estimate(pa.array([sketch_of(spark, ids(spark, n, part * 10**6))]))[0]
            errors.append((e - n) / n / d.std_error())
    assert max(map(abs, errors)) < 4 and np.mean(np.square(errors)) < 1.6
    assert d.ml_estimate(pa.array([b"", None], pa.binary())).tolist() == [0, 0] and len(d.ml_estimate(pa.array([], pa.binary()))) == 0


def test_merging_is_lossless(spark):
    df = ids(spark, 9000).unionByName(ids(spark, 3000)).repartition(5)
    whole = d.sketch(df.withColumn("k", F.lit(1)), ["k"], "id")
    by_day = d.sketch(df, ["day"], "id").withColumn("k", F.lit(1))
    merged = d.merge_sketches(by_day, ["k"])
    again = d.merge_sketches(by_day.unionByName(by_day), ["k"])
    one = bytes(whole.first()["sketch"])
    assert bytes(merged.first()["sketch"]) == one == bytes(again.first()["sketch"])
    assert len(one) == 1 << d.P


def test_packing_of_registers():
    rnd = random.Random(3)
    for n in (0, 1, 5, 600, 681, 683, 5000, 80000):
        codes = {rnd.randrange(1 << d.P) * 64 + min(53, 1 + int(-np.log2(1 - rnd.random()))) for _ in range(n)}
        got = d._pack(2, *d._bytes_of(np.ones(len(codes), int), np.array(sorted(codes), int)), d.P)
        assert got[0] == b"" and len(got[1]) <= 1 << d.P
        row, reg, byte = d.unpack(pa.array(got))
        back = {int(c) for c in d._codes_of(row, reg, byte)[1]}
        top = {}
        for c in codes:
            top[c >> 6] = max(top.get(c >> 6, 0), c & 63)
        assert set(row.tolist()) <= {1} and back == {c for c in codes if top[c >> 6] - (c & 63) <= 2}


def test_rollup_levels_and_missing_values(spark):
    df = ids(spark, 3000)
    out = d.estimated(d.rollup(d.sketch(df, ["day", "t"], "id"), ["day", "t"])).collect()
    assert {r["level"] for r in out} == {"day+t", "day", "t"} and len(out) == 6 + 3 + 2
    n = {r["day"]: r["estimate"] for r in out if r["level"] == "day"}
    assert all(abs(v - 1000) < 80 for v in n.values())  # ids without t count for their day
    assert abs(sum(r["estimate"] for r in out if r["level"] == "t") - 3000 * 6 / 7) < 160
    assert d.sketch(df.withColumn("id", F.lit(None).cast("string")), ["day"], "id").count() == 0
    assert d.estimated(d.rollup(d.sketch(df.limit(0), ["day", "t"], "id"), ["day", "t"])).count() == 0
