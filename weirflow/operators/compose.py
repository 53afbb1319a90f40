"""Composition: pipes of frame operators, and routing, fallback and repetition as expressions of a row."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ERROR, FlowError, error, no_error
from ..functions.coerce import truthy
from ..functions.scalars import hash_slot
from ..session import col
from .skew import join_to_unique
from .stream import Op


def pipe(*ops: Op) -> Op:
    """Operators one after the other; none: the frame itself."""
    return lambda df: functools.reduce(lambda d, f: f(d), ops, df)


chain = pipe


def pipe_with(first: Op, projection: Sequence[Column], second: Op) -> Op:
    return lambda df: second(first(df).select(*projection))


def _routed(name: str, key: Column, cases: Mapping[str, Column], default: Column | None) -> Op:
    def op(df: DataFrame) -> DataFrame:
        value = None
        for k, v in cases.items():
            value = F.when(key == k, v) if value is None else value.when(key == k, v)
        if default is not None:
            return df.withColumn(name, value.otherwise(default))
        now = F.when(key.isin(*cases), no_error()).otherwise(error("NotFound", F.concat(F.lit("no branch for "), F.coalesce(key, F.lit("null")))))
        return df.withColumns({name: value, ERROR: F.coalesce(F.col(ERROR), now) if ERROR in df.columns else now})

    return op


def branch(name: str, key: Column, cases: Mapping[str, Column]) -> Op:
    """``name`` by the row's key; a key without branch is an error."""
    return _routed(name, key, cases, None)


def switch(name: str, key: Column, cases: Mapping[str, Column], default: Column | None = None) -> Op:
    """Exact match of the key, else the default; without default, unhandled keys are errors."""
    return _routed(name, key, cases, default)


def branch_frames(key: Column, branches: Mapping[str, Op]) -> Op:
    """Each branch is an operator on the rows of its key; results are unioned. The input is read once per branch, filtered at the scan."""
    return lambda df: functools.reduce(DataFrame.unionByName, [f(df.where(key == k)) for k, f in branches.items()])


def ternary(name: str, condition: Column, then: Column, otherwise: Column | None = None) -> Op:
    """By the truth of a text; without else: null."""
    return lambda df: df.withColumn(name, F.when(truthy(condition), then).otherwise(otherwise) if otherwise is not None else F.when(truthy(condition), then))


def parallel(name: str, branches: Sequence[Column]) -> Op:
    """Results of all branches of a row, as an array in their order."""
    return lambda df: df.withColumn(name, F.array(*branches))


def parallel_named(name: str, branches: Mapping[str, Column | None]) -> Op:
    """Results by branch name, in order of the names; absent branches are left out."""
    there = {k: v for k, v in sorted(branches.items()) if v is not None}
    return lambda df: df.withColumn(name, F.create_map(*[x for k, v in there.items() for x in (F.lit(k), v)]))


def parallel_map(name: str, branches: Sequence[tuple[str, Column]]) -> Op:
    """As ``parallel_named``, but a name that occurs twice is an error when the plan is built."""
    if len({k for k, _ in branches}) < len(branches):
        raise FlowError("Conflict", "two branches have the same name")
    return parallel_named(name, dict(branches))


def merged_last(branches: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """Names that collide: the one declared last wins."""
    return dict(branches)


def first_success(name: str, candidates: Sequence[tuple[Column, Column]], message: str = "all failed") -> Op:
    """The value of the first candidate (succeeded, value) that succeeds, even if the value is null; none: an error."""
    if not candidates:
        raise FlowError("Validation", "no candidates")

    def op(df: DataFrame) -> DataFrame:
        value, any_ = None, F.lit(False)
        for good, v in candidates:
            good = F.coalesce(good, F.lit(False))
            value = F.when(good, v) if value is None else value.when(good, v)
            any_ = any_ | good
        return df.withColumns({name: value, ERROR: F.when(any_, no_error()).otherwise(error("Internal", message))})

    return op


def catch(name: str, failed: Column, value: Column, recovery: Column) -> Op:
    """The recovery's value where the row failed."""
    return lambda df: df.withColumn(name, F.when(F.coalesce(failed, F.lit(False)), recovery).otherwise(value))


def loop(name: str, start: Column, body: Callable[[Column], Column], done: Callable[[Column], Column], max_turns: int = 15) -> Op:
    """The body until the predicate holds of its result; not within ``max_turns``: a timeout. Per row, as one expression."""

    def op(df: DataFrame) -> DataFrame:
        zero = F.struct(start.alias("v"), F.lit(False).alias("done"), F.lit(0).alias("turns"))

        def turn(s: Column, _: Column) -> Column:
            v = body(s["v"])
            return F.when(s["done"], s).otherwise(F.struct(v.alias("v"), F.coalesce(done(v), F.lit(False)).alias("done"), (s["turns"] + 1).alias("turns")))

        out = df.withColumn("__loop", F.aggregate(F.sequence(F.lit(1), F.lit(max_turns)), zero, turn))
        late = F.when(F.col("__loop.done"), no_error()).otherwise(error("Timeout", "the loop did not end"))
        return out.withColumns({name: F.when(F.col("__loop.done"), F.col("__loop.v")), f"{name}_turns": F.col("__loop.turns"), ERROR: late}).drop("__loop")

    return op


def round_robin(name: str, i: Column, n: int) -> Op:
    """The slot of the i-th row among n."""
    return lambda df: df.withColumn(name, F.pmod(i, F.lit(n)).cast("int"))


def hash_router(name: str, key: Column, n: int) -> Op:
    """The slot of a key among n by its FNV-1a hash."""
    return lambda df: df.withColumn(name, hash_slot(key, n))


def race(candidates: DataFrame, keys: Sequence[str], value: str, latency: str, succeeded: str, substantive: str | None = None) -> DataFrame:
    """Per key the value of the quickest success; if none succeeds, the error of the quickest substantive failure, else of the quickest."""
    good = F.col(succeeded)
    real = F.coalesce(F.col(substantive), F.lit(True)) if substantive else F.lit(True)
    return candidates.groupBy(*keys).agg(
        F.min_by(value, F.when(good, F.struct(F.col(latency), F.col(value)))).alias("winner"), F.min(F.when(good, F.col(latency))).alias("latency"),
        F.max(good.cast("int")).cast("boolean").alias("won"), F.min_by(value, F.when(~good, F.struct((~real).alias("r"), F.col(latency), F.col(value)))).alias("loser"),
    )


def worker_pool(fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int | None = None, keep: Sequence[str] = ()) -> Op:
    """Any Python function over Arrow batches, in as many tasks as wanted. An item that fails becomes one row with the error and its
    ``keep`` columns; the others of its batch are not affected. ``schema`` must hold ``_error string``. The order of results is
    unspecified. A batch that fails is halved until the failing items stand alone, so ``fn`` may see an item several times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done: dict[tuple, list[pd.DataFrame]] = {}
            failed, errors = [], []
            parts = [(0, len(b))]
            half = whole = -1
            bad = 0  # the end of a part that must fail, as its whole did and the half before it did not
            while parts:
                begin, end = parts.pop()
                if end == bad and end - begin > 1:
                    half, whole = (begin + end) // 2, end
                    parts += [(half, end), (begin, half)]
                    bad = 0
                    continue
                try:
                    out = fn(b.iloc[begin:end])
                    # results of one shape are given on together; others are not, as that would change their types
                    done.setdefault(tuple(out.dtypes.items()), []).append(out)
                    if end == half:
                        bad = whole
                except Exception as e:  # noqa: BLE001
                    if end - begin > 1:
                        half, whole = (begin + end) // 2, end
                        parts += [(half, end), (begin, half)]
                    elif end > begin:
                        failed.append(begin)
                        errors.append(f"{type(e).__name__}: {e}")
            for same in done.values():
                yield (same[0] if len(same) == 1 else pd.concat(same, ignore_index=True)).assign(_error=None)
            if failed:
                yield b.iloc[failed][list(keep)].assign(_error=errors)

    def op(df: DataFrame) -> DataFrame:
        names = [f.split()[0] for f in schema.split(",")]
        spread = df.repartition(max(1, workers)) if workers is not None else df
        return spread.mapInPandas(lambda it: (x.reindex(columns=names) for x in run(it)), schema)

    return op


def compute_once(df: DataFrame, keys: Sequence[str], op: Op) -> DataFrame:
    """Work shared by equal keys: computed once per distinct key, then joined back to every row (null keys match null keys)."""
    results = op(df.select(*keys).distinct())
    # as one value, nulls equal nulls; rows of a hot key are salted
    whole = lambda name: F.struct(*[col(k) for k in keys]).alias(name)
    named = results.select(whole("__result_of"), *[c for c in results.columns if c not in keys])
    return join_to_unique(df.withColumn("__work", whole("__work")), named, "__work", "__result_of").drop("__work", "__result_of")
