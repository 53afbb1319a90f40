"""Distinct counts over identifier sets too large to hold, with a known error and mergeable partial results.

A sketch has 2^p registers. A register stores the largest rank (leading-zero run of the hash, plus one) it has seen and two
bits that tell whether the two ranks below it were seen as well: one byte a register, six bits and two. A sketch is stored as
its 2^p bytes, or, while fewer than a third of the registers are in use, as three bytes a used register. Merging is lossless, in
any order, over Arrow batches. Counts are estimated by maximum likelihood; the relative standard error is about 0.76 / sqrt(2^p)
(a sketch of six-bit highest ranks alone needs 1.87 times the registers, 1.4 times the bytes, for it).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from weirflow.session import cut

#: Registers: 2^P.
P = 11


def std_error(p: int = P) -> float:
    """Relative standard error (theoretical constant of 8-bit registers with two indicator bits under maximum likelihood)."""
    return 0.7608 / 2 ** (p / 2)


def code(value: Column, p: int = P) -> Column:
    """Register * 64 + rank of a value."""
    h = F.xxhash64(value)
    # the register is the low p bits; the rank is the number of leading zeros of the other 64 - p bits, plus one
    rest = F.call_function("shiftrightunsigned", h, F.lit(p))
    rank = F.lit(64 - p + 1) - F.when(rest == 0, F.lit(0)).otherwise(F.length(F.bin(rest)))
    return h.bitwiseAND(F.lit((1 << p) - 1).cast("bigint")).cast("int") * 64 + rank


def _ends(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys end."""
    return np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1) if len(key) else np.zeros(0, np.int64)


def _bytes_of(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, register, byte) of codes (register * 64 + rank) of rows; each pair of row and register once, in order."""
    key = np.unique((row.astype(np.int64) << 32) | code)
    last = _ends(key >> 6)  # the highest rank of each register
    top = np.repeat(key[last], np.diff(np.append(-1, last)))
    bits = np.select([top - key == 1, top - key == 2], [2, 1], 0)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    below = np.add.reduceat(bits, first) if len(key) else bits
    key = key[last]
    return key >> 32, (key & 0xFFFFFFFF) >> 6, ((key & 63) << 2) | below


def _codes_of(row: np.ndarray, reg: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of registers: the inverse."""
    rank = byte >> 2
    two, one = (byte & 2) > 0, (byte & 1) > 0
    base = reg * 64 + rank
    return np.concatenate([row, row[two], row[one]]), np.concatenate([base, base[two] - 1, base[one] - 2])


def _pack(rows: int, row: np.ndarray, reg: np.ndarray, byte: np.ndarray, p: int) -> list[bytes]:
    """Sketches of rows 0 .. rows - 1 from their registers, in order."""
    trip = np.stack([reg & 255, reg >> 8, byte], axis=1).astype(np.uint8)
    at = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for i in range(rows):
        a, b = at[i], at[i + 1]
        if 3 * (b - a) < 1 << p:
            out.append(trip[a:b].tobytes())
        else:
            full = np.zeros(1 << p, np.uint8)
            full[reg[a:b]] = byte[a:b]
            out.append(full.tobytes())
    return out


def unpack(sketches: pa.Array, p: int = P) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, register, byte) of binary sketches."""
    sketches = sketches.cast(pa.large_binary())
    if sketches.null_count:
        sketches = sketches.fill_null(b"")
    off = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(sketches) + 1]
    data = np.frombuffer(sketches.buffers()[2] or b"", np.uint8)
    size = np.diff(off)
    full = np.flatnonzero(size == 1 << p)
    few = np.flatnonzero((size > 0) & (size < 1 << p))
    rows, regs, bytes_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(full):
        all_ = data[off[full][:, None] + np.arange(1 << p)].astype(np.int64)
        r, g = np.nonzero(all_)
        rows.append(full[r]), regs.append(g), bytes_.append(all_[r, g])
    if len(few):
        n = size[few] // 3
        at = np.repeat(off[few] - np.append(0, np.cumsum(n)[:-1]) * 3, n) + np.arange(n.sum()) * 3
        rows.append(np.repeat(few, n)), regs.append(data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8), bytes_.append(data[at + 2].astype(np.int64))
    return np.concatenate(rows), np.concatenate(regs), np.concatenate(bytes_)


def _packed(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(b.num_columns - 1)
            size = codes.value_lengths().to_numpy(zero_copy_only=False)
            row, reg, byte = _bytes_of(np.repeat(np.arange(b.num_rows), size), codes.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_pack(b.num_rows, row, reg, byte, p), pa.binary())], [*b.schema.names[:-1], "sketch"])

    return run


def _schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    return StructType([*(StructField(k, df.schema[k].dataType) for k in keys), StructField("sketch", BinaryType())])


def sketch(rows: DataFrame, keys: Sequence[str], value: str, p: int = P) -> DataFrame:
    """(keys..., sketch) of rows that have a value."""
    seen = rows.where(F.col(value).isNotNull()).select(*keys, code(F.col(value), p).alias("c"))
    sets = seen.groupBy(*keys).agg(F.collect_set("c").alias("c")).select(*keys, "c")
    return sets.mapInArrow(_packed(p), _schema(rows, keys))


def _merged(keys: int, p: int):
    """Merges the sketches of neighbouring rows of equal keys; the last run of a batch is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t.cast(held.schema)])
            t = t.combine_chunks()
            if not t.num_rows:
                continue
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in range(keys):
                ids = pc.fill_null(t.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= ids[1:] != ids[:-1]
            first = np.flatnonzero(new)
            row, reg, byte = unpack(t.column(keys).combine_chunks(), p)
            row, reg, byte = _bytes_of(*_codes_of((np.cumsum(new) - 1)[row], reg, byte))
            done = t.select(range(keys)).take(first).append_column("sketch", pa.array(_pack(len(first), row, reg, byte, p), pa.binary()))
            held = done.slice(len(first) - 1)
            if len(first) > 1:
                yield from done.slice(0, len(first) - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def merge_sketches(sketches: DataFrame, keys: Sequence[str], p: int = P) -> DataFrame:
    """Sketches combined over everything but ``keys``: exactly the sketch of the combined values. Each task first merges the
    sketches it has, so that of a hot group one sketch a task is shuffled."""
    keys = list(keys)
    rows, schema = sketches.select(*keys, "sketch"), _schema(sketches, keys)
    part = rows.sortWithinPartitions(*keys).mapInArrow(_merged(len(keys), p), schema)
    return part.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(len(keys), p), schema)


def rollup(finest: DataFrame, dims: Sequence[str], keep: Sequence[str] = (), p: int = P) -> DataFrame:
    """Sketches of every non-empty combination of ``dims`` from those of all of them: ``level`` names the combination
    (``a+b``), dims outside it are null. A null dim is "no value": such rows count only in combinations without that dim.

    A combination is derived from one that has one dim more, which was written once to the shared folder, not from the rows.
    """
    have: dict[tuple[str, ...], DataFrame] = {tuple(dims): cut(finest)}
    for size in range(len(dims) - 1, 0, -1):
        for combo in itertools.combinations(dims, size):
            parent = next(c for c in have if len(c) == size + 1 and set(combo) < set(c))
            merged = merge_sketches(have[parent], [*keep, *combo], p)
            have[combo] = cut(merged) if size > 1 else merged
    out = None
    for combo, d in have.items():
        named = d.where(" and ".join(f"{c} is not null" for c in combo))
        one = named.select(F.lit("+".join(combo)).alias("level"), *[F.col(x) if x in combo else F.lit(None).cast(finest.schema[x].dataType).alias(x) for x in dims], *keep, "sketch")
        out = one if out is None else out.unionByName(one)
    return out


def _max_rank(p: int) -> int:
    return 64 - p + 1


def ml_estimate(sketches: pa.Array, p: int = P) -> np.ndarray:
    """Maximum-likelihood estimates of many binary sketches at once.

    With n distinct values, rank k of a register stays unseen with probability exp(-n q_k / m), q_k = 2^-k (the last rank has
    q of the one before). The log-likelihood is a sum over all ranks a register tells about: unseen ones give -n q / m, seen
    ones log(1 - exp(-n q / m)). Ranks more than two below the highest tell nothing. Its derivative is solved by Newton steps
    in log-log coordinates, once for all sketches with equal counts of ranks.
    """
    m, last = 1 << p, _max_rank(p)
    q = np.array([0.0] + [2.0 ** -min(k, last - 1) for k in range(1, last + 1)])
    tail = np.array([q[k + 1 :].sum() for k in range(last + 1)])  # mass of the ranks above k
    rows = len(sketches)
    n = np.zeros(rows)
    owner, reg, byte = unpack(sketches, p)
    if not len(owner):
        return n
    top = byte >> 2
    row, codes = _codes_of(owner, reg, byte)
    rank = codes & 63
    seen = np.bincount(row * (last + 1) + rank, minlength=rows * (last + 1)).reshape(rows, -1).astype(float)
    # unseen mass: above the highest rank, and of the two below it what is not there
    below = q[np.maximum(top - 1, 0)] + q[np.maximum(top - 2, 0)]  # q[0] = 0
    found = np.arange(len(row)) >= len(owner)
    unseen = np.bincount(owner, tail[top] + below, rows) - np.bincount(row[found], q[rank[found]], rows)
    unseen += (m - np.bincount(owner, minlength=rows)) * q[1:].sum()
    # sketches with equal counts have equal estimates
    mark = seen @ np.random.default_rng(1).random(last + 1) + unseen * np.pi
    _, one, which = np.unique(mark, return_index=True, return_inverse=True)
    seen, unseen = seen[one, 1:], unseen[one]
    some = seen.sum(1) > 0
    x = np.where(some, np.log(np.maximum(seen.sum(1), 1) / np.maximum(unseen, 1e-300)), 0.0)
    x = np.minimum(x, last)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for _ in range(12):
            e = np.exp(x)[:, None] * q[None, 1:]
            grow = np.expm1(np.minimum(e, 700))
            f = (seen * q[None, 1:] / grow).sum(1)
            slope = (seen * q[None, 1:] * e * (grow + 1) / grow**2).sum(1) / f
            step = (np.log(f) - np.log(unseen)) / slope
            x = x + np.clip(np.nan_to_num(step), -3, 3)
    return np.where(some, m * np.exp(x), 0.0)[which]


def estimated(sketches: DataFrame, p: int = P) -> DataFrame:
    """``sketches`` with ``estimate`` (rounded to whole values) beside each sketch."""

    @F.arrow_udf("bigint")
    def estimate(s: pa.Array) -> pa.Array:
        return pa.array(np.rint(ml_estimate(s, p)).astype(np.int64))

    return sketches.withColumn("estimate", estimate("sketch"))
