import datetime as dt

from pyspark.sql import functions as F

from weirflow.functions.values import micros
from weirflow.operators import folds
from weirflow.order import order
from weirflow.streaming import processors as p

T = dt.datetime(2020, 1, 1)


def files(spark, tmp_path, rows):
    """Rows as a stream of two files, in order of time."""
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, "u int, ts timestamp, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            import time

            time.sleep(1.1)  # file sources take files by their time
    return spark.readStream.schema("u int, ts timestamp, id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


ROWS = [(u, T + dt.timedelta(minutes=7 * i + u), 10 * i + u) for i in range(30) for u in range(3)]


def test_machines_give_what_batches_give(spark, tmp_path):
    t = micros(F.col("ts"))
    stream = files(spark, tmp_path, ROWS)
    batch = spark.createDataFrame(ROWS, "u int, ts timestamp, id int")
    hour = 3_600_000_000
    out = drained(p.fold_stream(stream, folds.throttle_machine(hour), ["u"], ["ts", "id"], {"t": t}), tmp_path, "throttled").where("__go")
    want = folds.throttle(hour, t, order("ts", "id", keys=("u",)))(batch)
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in want.collect())
    out = drained(p.fold_stream(stream, folds.bucket_machine(1, 2), ["u"], ["ts", "id"], {"t": F.floor(t / 1000)}), tmp_path, "limited")
    want = folds.rate_limit(1, 2, F.floor(t / 1000), order("ts", "id", keys=("u",)))(batch)
    assert sorted((r["id"], r["allowed"]) for r in out.collect()) == sorted((r["id"], r["allowed"]) for r in want.collect())


def test_debounce_and_windows(spark, tmp_path):
    gaps = [0, 1, 2, 60, 61, 200, 400]
    rows = [(1, T + dt.timedelta(minutes=m), i) for i, m in enumerate(gaps)]
    stream = files(spark, tmp_path, rows).withWatermark("ts", "0 seconds")
    got = drained(p.debounce_stream(stream, ["u"], ["ts", "id"], 30 * 60 * 1000), tmp_path, "debounced")
    assert {r["id"] for r in got.collect()} >= {2, 4, 5} and not {r["id"] for r in got.collect()} & {0, 1, 3}
    assert drained(p.distinct_stream(files(spark, tmp_path / "b", rows).withWatermark("ts", "1 hour"), ["u"]), tmp_path, "firsts").count() >= 1
    counts = drained(p.counted_stream(files(spark, tmp_path / "c", rows), "ts", "1 hour", "0 seconds", "u"), tmp_path, "counted")
    assert sum(r["n"] for r in counts.collect()) == 6  # the last window is still open
