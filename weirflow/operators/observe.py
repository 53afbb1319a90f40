"""Event sinks as tables and texts: metrics, Prometheus exposition, redacted JSON lines, topics, rings, history."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_escaped
from ..order import Order
from ..session import col, cut

#: Limits of the metrics sink (fixed values).
MAX_KEYS = 10_000
MAX_LABEL_BYTES = 128


def metrics(events: DataFrame, action: str, kind: str, o: Order, max_keys: int = MAX_KEYS, max_bytes: int = MAX_LABEL_BYTES) -> DataFrame:
    """(action, kind, count, overflow): events per key, of the first ``max_keys`` keys by first appearance; labels longer than
    ``max_bytes`` and later keys count as overflow (a row with null keys, present only if there is any)."""
    a, k = F.coalesce(col(action), F.lit("")), F.coalesce(col(kind), F.lit(""))
    fits = (F.octet_length(a) <= max_bytes) & (F.octet_length(k) <= max_bytes)  # both or neither
    keyed = events.groupBy(F.when(fits, a).alias("action"), F.when(fits, k).alias("kind")).agg(F.count(F.lit(1)).alias("count"), F.min(o.struct()).alias("__first"))
    # a top-k plan: each task keeps its first max_keys keys; what is over is the rest of the whole
    kept = keyed.where("action is not null and kind is not null").orderBy("__first").limit(max_keys).select("action", "kind", "count", F.lit(0).cast("bigint").alias("overflow"))
    null = F.lit(None).cast("string")
    whole = keyed.agg(F.sum("count").alias("n")).unionByName(kept.agg((-F.sum("count")).alias("n"))).agg(F.sum("n").alias("overflow"))
    over = whole.where("overflow > 0").select(null.alias("action"), null.alias("kind"), F.lit(0).cast("bigint").alias("count"), "overflow")
    return kept.unionByName(over)


def prometheus(counted: DataFrame, name: str = "events_total") -> DataFrame:
    """(line_no, line) of the text format: keys by action and kind, the overflow line only if there is any."""
    body = counted.where("action is not null").select(
        F.concat(F.lit(name + '{action="'), label_escaped(F.col("action")), F.lit('",kind="'), label_escaped(F.col("kind")), F.lit('"} '), F.col("count").cast("string")).alias("line"), F.col("action").alias("a"), F.col("kind").alias("k"), F.lit(0).alias("o")
    )
    over = counted.where("overflow > 0").select(F.concat(F.lit(name + "_overflow "), F.col("overflow").cast("string")).alias("line"), F.lit("").alias("a"), F.lit("").alias("k"), F.lit(1).alias("o"))
    # ten thousand lines and one at most (the metrics sink's limit), so one window is no bottleneck
    return body.unionByName(over).select(F.row_number().over(Window.orderBy("o", "a", "k")).cast("bigint").alias("line_no"), "line")


def utc_text(t: Column) -> Column:
    """RFC 3339 text of a timestamp without zone, taken as UTC. (``date_format`` would read it in the session's zone.)"""
    two = lambda unit: F.lpad(F.extract(F.lit(unit), t).cast("string"), 2, "0")
    return F.concat(F.to_date(t).cast("string"), F.lit("T"), two("HOUR"), F.lit(":"), two("MINUTE"), F.lit(":"), F.lpad(F.extract(F.lit("SECOND"), t).cast("decimal(8,6)").cast("string"), 9, "0"), F.lit("Z"))


def json_lines(events: DataFrame, plain: list[str], payloads: list[str] = (), secrets: list[str] = (), time: str | None = None) -> DataFrame:
    """One JSON text per event: ``payloads`` only by type name, ``secrets`` redacted, the time in UTC."""
    fields = [utc_text(col(time).cast("timestamp_ntz")).alias(time)] if time else []
    fields += [col(c) for c in plain] + [F.when(col(c).isNotNull(), F.lit(events.schema[c].dataType.simpleString())).alias(c) for c in payloads]
    fields += [F.when(F.coalesce(col(c).cast("string"), F.lit("")) != "", F.lit("[redacted]")).alias(c) for c in secrets]
    return events.select(F.to_json(F.struct(*fields)).alias("line"))


def topic_read(topic: DataFrame, seq: str, cursor: int, n: int, capacity: int) -> DataFrame:
    """The next n messages of a bounded log for a reader that has seen up to ``cursor`` (exclusive of it): one that lags behind the
    capacity goes on at the oldest message kept."""
    head = topic.agg(F.max(seq)).scalar()
    return topic.where((col(seq) > cursor) & (col(seq) > head - capacity)).orderBy(seq).limit(n)


def topic_append(topic: DataFrame, messages: DataFrame, seq: str, o: Order) -> DataFrame:
    """Messages with sequence numbers that go on after the topic's last."""
    from ..order import ordinal

    last = F.coalesce(topic.agg(F.max(seq)).scalar(), F.lit(0))
    return ordinal(messages, o).withColumn(seq, F.col("_i") + 1 + last).drop("_i")


def ring_push(ring: DataFrame, arriving: DataFrame, capacity: int, o: Order) -> DataFrame:
    """Slots after arrivals: a full ring refuses the newest."""
    from .stream import take

    free = max(0, capacity - ring.count())
    return ring.unionByName(take(free, o)(arriving))


def slow(df: DataFrame, duration: str, threshold: int) -> DataFrame:
    return df.where(col(duration) > threshold)


def intervals_in_flight(df: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Most calls in flight at once per key, from +1 / -1 marks (an end comes before a start of the same time)."""
    # a key's marks are summed per time, then per range of times over all tasks, and only then run over within a range
    marks = df.select(*keys, F.explode(F.array(F.struct(col(start).alias("t"), F.lit(1).alias("d")), F.struct(col(end).alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.*")
    summed = marks.groupBy(*keys, "t", "d").agg(F.sum("d").alias("s"))
    by = [*[col(k) for k in keys], F.col("t"), F.col("d")]
    # over many tasks: rows sorted by (key, time) in ranges; a range's running sum is shifted by the ranges before it
    placed = cut(summed.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()))
    run = F.sum("s").over(Window.partitionBy("__p", *keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = placed.withColumn("r", run).groupBy("__p", *keys).agg(F.max("r").alias("most"), F.sum("s").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("most", F.col("most") + before).groupBy(*keys).agg(F.max("most").alias("most"))


#: Columns that no log line shows.
PAYLOADS = ("request", "response", "error", "recovered")


def log_lines(events: DataFrame, kind: str = "kind") -> DataFrame:
    """(level, line) of every event: ``ERROR`` for kind ``error`` only, else ``INFO``; the line is JSON without payloads and nulls."""
    level = F.when(F.coalesce(col(kind) == "error", F.lit(False)), "ERROR").otherwise("INFO")
    return events.select(level.alias("level"), F.to_json(F.struct(*[col(c) for c in events.columns if c not in PAYLOADS])).alias("line"))


def log_batches(logger: str, kind: str = "kind"):
    """A ``foreachBatch`` sink: one line per event to the logger of that name in the tasks' own processes, where it needs a handler."""

    def write(df: DataFrame, batch_id: int) -> None:
        def log(rows) -> None:
            out = logging.getLogger(logger)
            for level, line in rows:
                out.log(getattr(logging, level), "batch %s: %s", batch_id, line)

        log_lines(df, kind).foreachPartition(log)

    return write


def observed(name: str, **exprs: Column):
    """Metrics beside the rows (``df.observe``), with no extra pass."""
    return lambda df: df.observe(name, *[e.alias(k) for k, e in exprs.items()])
