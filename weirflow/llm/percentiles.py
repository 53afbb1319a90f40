"""Percentiles per group over very many numbers, with a bounded error and mergeable partial results.

State: (day, group, bin, n) - how many values fell into each bin, a bin keeping a value's ``bits`` leading bits. States of
different partitions or days are combined by adding up ``n``. A bin's middle differs from every value in it by at most
2^-bits of the value; values below 2^bits are kept exactly.

Selection: distributed multi-select. A hash of the bin deals every group's state into chunks, which no task gathers again. Every
chunk proposes the median of its values still in play, the weighted median of the proposals becomes the group's pivot, all
chunks count below / at / above it, the ruled-out range is dropped, and so on per (group, rank) until the pivot is the value
sought. All ranks of all groups move together; there is no other way for small groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.session import cut

#: Chunks of a group at least, and bins a chunk holds at most on average.
CHUNKS = 4
CHUNK = 4096
#: Groups still open up to which their ranges and pivots (some 100 bytes a rank) are broadcast to the chunks; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def bin_of(v: Column, bits: int) -> Column:
    """The middle of the bin of a bigint: its ``bits`` leading bits are kept. Order-preserving, negative values mirrored
    (``~v``, so that the least 64-bit value does not overflow)."""
    mag = F.when(v >= 0, v).otherwise(F.bitwise_not(v))
    drop = F.greatest(F.length(F.bin(mag)) - bits, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", mag, drop), drop)
    mid = low + F.when(drop > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), drop - 1)).otherwise(F.lit(0))
    return F.when(v >= 0, mid).otherwise(F.bitwise_not(mid))


def states(rows: DataFrame, keys: Sequence[str], value: str, bits: int = 10) -> DataFrame:
    """(keys..., bin, n) of rows that have a value. ``keys`` may hold the day or whatever else is to be combined later."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bin_of(F.col(value), bits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States combined over everything but ``keys``."""
    return state.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def _median(c: np.ndarray, u: int, v: int) -> int:
    """Index of the weighted median of the bins u to v (``c``: weights summed up from the left, beginning with 0)."""
    return int(np.searchsorted(c[u + 1 : v + 1], c[u] + (c[v] - c[u] + 1) // 2)) + u


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk: the median of all its values, and how many it has."""
    for b in batches:
        out = []
        for gid, bins, ns in zip(b["gid"], b["bins"], b["ns"]):
            c = np.concatenate([[0], np.cumsum(np.asarray(ns))])
            out.append((gid, int(bins[_median(c, 0, len(bins))]), int(c[-1])))
        yield pd.DataFrame(out, columns=["gid", "med", "w"])


_TOLD = "gid string, permille int, n bigint, rank bigint, lo bigint, hi bigint, pivot bigint, side int, med bigint, w bigint"


def _round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk and open rank: what it counts below, at and above the pivot, with its median of each side."""
    for b in batches:
        out: list[tuple] = []
        for gid, bins, ns, targets in zip(b["gid"], b["bins"], b["ns"], b["targets"]):
            x, c = np.asarray(bins), np.concatenate([[0], np.cumsum(np.asarray(ns))])
            at = np.array([(t["lo"], t["pivot"], t["hi"]) for t in targets])
            i, l = np.searchsorted(x, at[:, :2].T, "left")
            r, j = np.searchsorted(x, at[:, 1:].T, "right")
            for k, t in enumerate(targets):
                for side, u, v in ((-1, int(i[k]), int(l[k])), (0, int(l[k]), int(r[k])), (1, int(r[k]), int(j[k]))):
                    if v > u:
                        out.append((gid, t["permille"], t["n"], t["rank"], t["lo"], t["hi"], t["pivot"], side, int(x[_median(c, u, v)]), int(c[v] - c[u])))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _TOLD.split(", ")])


def _weighted_median(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., med, w): the weighted median of the proposals and the sum of their weights."""
    each = Window.partitionBy(*by)
    run = each.orderBy("med").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.select(*by, "med", F.sum("w").over(run).alias("to"), "w", F.sum("w").over(each).alias("all"))
    return r.where("2 * to >= all and 2 * (to - w) < all").select(*by, "med", F.col("all").alias("w"))


def multi_select(state: DataFrame, keys: Sequence[str], permille: Sequence[int], chunk: int = CHUNK, rounds: list[int] | None = None) -> DataFrame:
    """(keys..., permille, value, n) - the least bin with at least that share of the group's values at or below it.

    ``state``: (keys..., bin, n), one row per bin of a group. Keys may be null. A share of 0 is the least value. Exact over the
    bins given, so with bins that keep all bits (``bits=63``) it selects exact values. ``rounds`` is given the number of
    (group, rank) pairs each round had open.
    """
    keys = list(keys)
    gid = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}).alias("gid")
    base = state.select(*keys, gid, "bin", "n")
    # the number of chunks is the same for all groups, so that a bin's chunk follows from the bin
    salted = cut(base.withColumn("salt", F.pmod(F.xxhash64("bin"), F.lit(1 << 16))))
    most = salted.groupBy("gid").count().agg(F.max("count")).first()[0] or 0
    chunks = min(max(CHUNKS, -(-most // chunk)), 1 << 16)
    packed = salted.groupBy("gid", (F.col("salt") % chunks).alias("salt")).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("s"), *[F.first(k).alias(k) for k in keys])
    packed = cut(packed.select("gid", F.col("s.bin").alias("bins"), F.col("s.n").alias("ns"), *keys))
    chunked = packed.select("gid", "bins", "ns")
    first = _weighted_median(chunked.mapInPandas(_propose, "gid string, med bigint, w bigint"), ["gid"])
    # of each group, the ranks still open: (permille, n, rank, lo, hi, pivot)
    rank = "greatest((w * p + 999) div 1000, 1L)"
    start = f"transform(array({', '.join(map(str, permille))}), p -> named_struct('permille', p, 'n', w, 'rank', {rank}, 'lo', {-(1 << 63) + 1}L - 1L, 'hi', {(1 << 63) - 1}L, 'pivot', med, 'go', 1))"
    step = cut(first.select("gid", F.expr(start).alias("targets")))
    done: list[DataFrame] = []
    while left := step.agg(F.sum(F.expr("size(filter(targets, t -> t.go <> 0))"))).first()[0]:
        if rounds is not None:
            rounds.append(left)
        todo = step.select("gid", F.expr("filter(targets, t -> t.go <> 0)").alias("targets")).where("size(targets) > 0")
        told = chunked.join(F.broadcast(todo) if left <= BROADCAST_GROUPS * len(permille) else todo, "gid").mapInPandas(_round, _TOLD)
        sides = _weighted_median(told.repartition("gid"), ["gid", "permille", "n", "rank", "lo", "hi", "pivot", "side"])
        pick = "max(case when side = {} then {} end)".format
        per = sides.groupBy("gid", "permille", "n", "rank", "lo", "hi", "pivot").agg(
            F.expr(f"coalesce({pick(-1, 'w')}, 0L)").alias("below"), F.expr(pick(0, "w")).alias("at"), F.expr(pick(-1, "med")).alias("left"), F.expr(pick(1, "med")).alias("right")
        )
        per = per.withColumn("go", F.expr("case when rank <= below then -1 when rank <= below + at then 0 else 1 end"))
        new = F.expr("""named_struct('permille', permille, 'n', n, 'rank', if(go = 1, rank - below - at, rank), 'lo', if(go = 1, pivot + 1, lo),
            'hi', if(go = -1, pivot - 1, hi), 'pivot', case go when -1 then left when 1 then right else pivot end, 'go', go)""")
        step = cut(per.groupBy("gid").agg(F.collect_list(new).alias("targets")))
        done.append(step.select("gid", F.explode(F.expr("filter(targets, t -> t.go = 0)")).alias("t")).select("gid", "t.permille", F.col("t.pivot").alias("value"), "t.n"))
    names = packed.groupBy("gid").agg(*[F.first(k).alias(k) for k in keys])
    if not done:
        return names.select(*keys, F.lit(0).alias("permille"), F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("n")).where("false")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(names, "gid").select(*keys, "permille", "value", "n")
