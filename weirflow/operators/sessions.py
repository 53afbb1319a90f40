"""Sessions: each key's events split at inactivity gaps.

Secondary sort by (key, time) with a range exchange, so that even a key with a third of all rows is spread over many tasks in
time order; one linear scan per partition emits sessions with constant memory; only the first and last session of a partition
can go on in a neighbour, and these few (two a partition) are stitched afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clean_id, fingerprint, micros
from ..session import col, cut

_OUT = "k string, start_us bigint, end_us bigint, n_events bigint, edge boolean"


def _scan(gap_us: int, once: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # key, time, fingerprint of the last row
        start = n = 0
        first = True

        def out(keys, starts, ends, counts, edges) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(counts, pa.int64()), pa.array(edges, pa.bool_())], ["k", "start_us", "end_us", "n_events", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(0)
            t, fa, fb = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            size = len(t)
            same = np.zeros(size, bool)  # same key as the row before
            same[1:] = pc.equal(k.slice(1), k.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            before = np.empty(size, np.int64)
            before[1:] = t[:-1]
            again = np.zeros(size, bool)  # the record before, delivered again
            again[1:] = once & same[1:] & (t[1:] == t[:-1]) & (fa[1:] == fa[:-1]) & (fb[1:] == fb[:-1])
            if last is not None:
                same[0] = k[0].as_py() == last[0]
                before[0] = last[1]
                again[0] = once and same[0] and (t[0], fa[0], fb[0]) == tuple(last[1:])
            else:
                before[0] = t[0]
            new = ~same | (t - before > gap_us)
            at = np.flatnonzero(new)
            ones = (~again).astype(np.int64)
            if last is None:
                start, n = int(t[0]), 0
                at = at[1:]
            head = at[0] if len(at) else size
            n += int(ones[:head].sum())
            if len(at):
                keys, starts, ends, counts, edges = [last[0] if last is not None and head == 0 else k[int(max(head - 1, 0))].as_py()], [start], [last[1] if head == 0 else int(t[head - 1])], [n], [first]
                first = False
                if len(at) > 1:
                    keys += k.take(pa.array(at[:-1])).to_pylist()
                    starts += t[at[:-1]].tolist()
                    ends += t[at[1:] - 1].tolist()
                    counts += np.add.reduceat(ones, at)[:-1].tolist()
                    edges += [False] * (len(at) - 1)
                yield out(keys, starts, ends, counts, edges)
                start, n = int(t[at[-1]]), int(ones[at[-1] :].sum())
            last = [k[size - 1].as_py(), int(t[-1]), int(fa[-1]), int(fb[-1])]
        if last is not None:
            yield out([last[0]], [start], [last[1]], [n], [True])

    return scan


def sessions(df: DataFrame, key: str, time: str, gap_us: int, *, ids: Sequence[str] = (), texts: Sequence[str] = (), others: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """(key, start_us, end_us, duration_us, n_events): a key's event opens a session if it lies more than ``gap_us`` after the
    key's event before it. Keys are read as ids.

    Defined cases: rows without key or time are left out; order of the input means nothing; equal times belong together; rows
    equal in ``ids``, ``texts``, ``others`` (and key and time) are one event; with none of these given, every row is an event;
    empty table - no rows; further columns are ignored.
    """
    once = bool(ids or texts or others)
    a, b = fingerprint([col(c) for c in ids], [col(c) for c in texts], [col(c) for c in others]) if once else [F.lit(0).cast("bigint")] * 2
    rows = df.select(clean_id(col(key)).alias("k"), micros(col(time)).alias("t"), a.alias("a"), b.alias("b")).where("k is not null and t is not null")
    spread = rows.repartitionByRange(*([partitions] if partitions else []), "k", "t")
    found = cut(spread.sortWithinPartitions("k", "t", "a", "b").mapInArrow(_scan(gap_us, once), _OUT))
    inner = found.where("not edge").select("k", "start_us", "end_us", "n_events")
    w = Window.partitionBy("k").orderBy("start_us", "end_us")
    edge = found.where("edge").withColumn("p", F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    edge = edge.withColumn("g", F.sum(F.when(F.col("p").isNull() | (F.col("start_us") - F.col("p") > gap_us), 1).otherwise(0)).over(w))
    edge = edge.groupBy("k", "g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events")).drop("g")
    return inner.unionByName(edge).select(F.col("k").alias("key"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
