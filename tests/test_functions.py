import hashlib

import pytest
from pyspark.sql import functions as F

from weirflow.functions import coerce as c
from weirflow.functions import scalars as s
from weirflow.functions.values import clean_id, fingerprint, go_duration_ns, micros


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_coercion(spark):
    vectors = [
        ("  padded  ", "string", "  padded  "), ("0", "bool", False), ("  t  ", "bool", True), ("yes", "bool", None), ("-128", "int8", -128), ("300", "int8", None), ("  7 ", "int", 7), ("-1", "uint", None),
        ("18446744073709551615", "uint64", 18446744073709551615), ("1e3", "float64", 1000.0), ("abc", "float64", None), ("1m30s", "duration", 90 * 10**9), (" 5s ", "duration", 5 * 10**9), ("10", "duration", None),
        ("a,,b", "list:string", ["a", "b"]), ("a,b,", "list:string", ["a", "b"]), ("", "list:string", []), (" 1 , 2 ,3 ", "list:int", [1, 2, 3]), ("1,x,3", "list:int", None), ("7.5", "int", None), ("9223372036854775808", "int64", None),
        ("1e39", "float32", None), ("-Inf", "float64", float("-inf")), (None, "int", None),
    ]
    for raw, target, want in vectors:
        got = one(spark, c.coerce(F.lit(raw).cast("string"), target))
        assert (int(got) if target == "uint64" else got) == want, (raw, target)
    assert str(one(spark, c.coerce(F.lit("2026-01-15T10:30:00Z"), "time"))) == "2026-01-15 10:30:00"
    with pytest.raises(ValueError):
        c.coerce(F.lit("x"), "complex")


def test_narrow_and_text_of(spark):
    assert [one(spark, c.narrow(F.lit(v), "int8").cast("int")) for v in (7.0, 7.5, 128.0, -128.0, float("nan"))] == [7, None, None, -128, None]
    assert one(spark, c.text_of(F.create_map(F.lit("text"), F.lit("b"), F.lit("output"), F.lit("c")))) == "b"
    assert one(spark, c.truthy_map(F.create_map(F.lit("a"), F.lit("no"), F.lit("b"), F.lit("x")))) is True


def test_durations_and_ids(spark):
    rows = [("1.5ms", 1_500_000), ("2m3s", 123 * 10**9), ("812µs", 812_000), ("-1h0.5m", -3630 * 10**9), ("0", 0), ("n/a", None), ("661 us", None), ("12", None), (None, None), ("9223372036854775808ns", None), ("-9223372036854775808ns", -(2**63)), ("0.1234567899s", 123456789), ("0.00000000011h", 396), (".5s", 5 * 10**8), ("1.s", 10**9), ("99999999999999999999999h", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "d string")
    assert [r[0] for r in df.select(go_duration_ns(F.col("d"))).collect()] == [r[1] for r in rows]
    assert [one(spark, clean_id(F.lit(x).cast("string"))) for x in (" Ab\t", "  ", None)] == ["ab", None, None]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for text, want in (("1970-01-02", 86_400_000_000), ("2018-07-05 00:09:13.080019", 1530749353080019), ("1969-12-31 23:59:59.5", -500_000), ("2018-03-11 02:30:00", 1520735400000000)):
            assert one(spark, micros(F.lit(text).cast("timestamp_ntz"))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_fingerprint_marks_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (" A", None), ("", "a")], "x string, y string")
    got = [tuple(r) for r in df.select(*fingerprint([F.col("x"), F.col("y")])).collect()]
    assert got[0] != got[1] and got[1] == got[2] and got[0] == got[3]


def test_backoffs(spark):
    for base, top, n, want in [(1, 2 * 10**9, 30, 2**29), (1, 2 * 10**9, 31, 2**30), (1, 2 * 10**9, 32, 2 * 10**9), (2**62, 2**63 - 1, 2, 2**63 - 1), (10**10, 10**9, 1, 10**9), (-(10**9), 10**9, 2, 0), (10**9, -(10**9), 2, 0), (5, 100, 0, 5)]:
        assert one(spark, s.exponential_backoff(base, top, F.lit(n))) == want
    assert one(spark, s.linear_backoff(2**62, F.lit(3))) == 2**63 - 1 and one(spark, s.linear_backoff(-(2**62), F.lit(3))) == -(2**63)
    assert one(spark, s.adaptive_timeout(1005, F.lit(7))) == 1005 + 100 * 7 + 5 * 7 // 10 and one(spark, s.adaptive_timeout(2**62, F.lit(40))) == 2**63 - 1
    assert one(spark, s.jittered_backoff(100, 1000, F.lit(2), F.lit(0.0))) == 140


def test_hashes_and_keys(spark):
    def fnv(b):
        h = 14695981039346656037
        for x in b:
            h = ((h ^ x) * 1099511628211) % 2**64
        return h

    for t in ("", "a", "foobar", "grüße"):
        assert int(one(spark, s.fnv1a64(F.lit(t)))) == fnv(t.encode())
    parts = b"".join(len(p).to_bytes(8, "big") + p for p in (b"v1", b"ns", b"tok"))
    assert one(spark, s.scoped_key("k-", F.lit("v1"), F.lit("ns"), F.lit("tok"))) == "k-" + hashlib.sha256(parts).hexdigest()
    assert [one(spark, s.valid_key(F.lit(x).cast("string"))) for x in ("abc", "", "a b", "x" * 256, "abc\n", None)] == [True, False, False, False, False, False]
    assert one(spark, s.scope_hash([F.lit("t")], [F.array(F.lit("b"), F.lit("a"))])) == one(spark, s.scope_hash([F.lit("t")], [F.array(F.lit("a"), F.lit("b"), F.lit("a"))]))
    assert [one(spark, s.power_of_two_ceiling(F.lit(x))) for x in (0, 1, 3, 1024, 1025)] == [1, 1, 4, 1024, 2048]
    assert one(spark, s.label_escaped(F.lit('a\\b"c\nd'))) == 'a\\\\b\\"c\\nd'


def test_durations_against_a_parser(spark):
    """Random duration texts against a parser on whole numbers."""
    import random
    import re
    from fractions import Fraction

    units = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}

    def parse(t):
        t = t.strip(" \t\r\n\f\v ")
        sign, body = (-1, t[1:]) if t[:1] == "-" else (1, t[1:] if t[:1] == "+" else t)
        if body == "0":
            return 0
        parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", body)
        if not parts or "".join(a + b for a, b in parts) != body:
            return None
        n = 0
        for a, b in parts:
            whole, _, rest = a.partition(".")
            n += int(whole or 0) * units[b] + int(Fraction(int((rest[:17] or "0")), 10 ** len(rest[:17] or "0")) * units[b])
        n *= sign
        return n if -(2**63) <= n < 2**63 else None

    rnd = random.Random(12)
    number = lambda: rnd.choice(["%d", "%d.", ".%d", "%d.5", "0%d", "%d.000000001"]) % rnd.randrange(10 ** rnd.randrange(1, 12))
    texts = [rnd.choice(["", "-", "+", " ", "--"]) + "".join(number() + rnd.choice([*units, "", "x", " s"]) for _ in range(rnd.randrange(4))) + rnd.choice(["", " ", "\n"]) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string").orderBy("i").select(go_duration_ns(F.col("d"))).collect()]
    assert [(t, g) for t, g in zip(texts, got) if g != parse(t)] == []
