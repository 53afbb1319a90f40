"""Folds that depend on everything before in a stream, as linear scans: rows are brought to their key's task in order and pass a
state machine one by one, with constant memory. (An array of a whole stream would have to fit a task; this never holds one.)

Streams of one key are sequential by meaning. ``throttle`` and ``batch_by_time`` still spread a hot key: after a gap of at least the
interval their state is as new, so each stretch between such gaps is a stream of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..order import Order
from ..session import col
from .stream import Op


@dataclass(frozen=True)
class Machine:
    """``step(state, *inputs)`` gives a row's outputs (DDL ``outputs``) and may change ``state``, which begins as ``fresh()``. The
    state holds plain values only, so the same machine runs over sorted batches and as a streaming processor."""

    outputs: str
    step: Callable[..., tuple]
    fresh: Callable[[], dict] = dict


def scan(df: DataFrame, o: Order, inputs: dict[str, Column], m: Machine) -> DataFrame:
    """``df`` with the machine's outputs, for each row in its stream's order."""
    fresh, step, outputs = m.fresh, m.step, m.outputs
    names = df.columns
    keyed = df.withColumns({f"__in{i}": c for i, c in enumerate(inputs.values())})
    keys = [col(k) for k in o.keys]
    # one stream is one task by meaning; what comes before it still runs in many
    placed = keyed.repartition(*keys) if keys else keyed.repartition(1)
    placed = placed.sortWithinPartitions(*keys, *[col(c) for c in o.by])
    out = StructType.fromDDL(outputs)
    n, nk = len(inputs), [names.index(k) for k in o.keys]
    arrow = [_arrow(f.dataType.simpleString()) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            ins = [b.column(len(names) + i).to_pylist() for i in range(n)]
            ks = list(zip(*[b.column(i).to_pylist() for i in nk])) if nk else [()] * b.num_rows
            rows = []
            for k, *x in zip(ks, *ins):
                if k != last:
                    last, state = k, fresh()
                rows.append(step(state, *x))
            made = [pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * len(arrow), arrow)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + made, names + [f.name for f in out.fields])

    return placed.mapInArrow(run, StructType(df.schema.fields + out.fields))


def _arrow(kind: str) -> pa.DataType:
    return {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind]


def _split_at_gaps(df: DataFrame, o: Order, t: Column, gap: int) -> tuple[DataFrame, Order]:
    """Stretches between gaps of at least ``gap`` as streams of their own."""
    w = o.window()
    far = F.when(t - F.lag(t).over(w) >= gap, 1).otherwise(0)
    out = df.withColumn("__far", far).withColumn("__part", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__far")
    return out, Order(o.by, (*o.keys, "__part"))


def throttle_machine(interval: int) -> Machine:
    def step(s: dict, x: int) -> tuple:
        go = "t" not in s or x - s["t"] >= interval
        if go:
            s["t"] = x
        return (go,)

    return Machine("__go boolean", step)


def throttle(interval: int, t: Column, o: Order) -> Op:
    """Rows at least ``interval`` after the stream's last row that passed; the first passes. Event time."""

    def op(df: DataFrame) -> DataFrame:
        parts, po = _split_at_gaps(df, o, t, interval)
        return scan(parts, po, {"t": t}, throttle_machine(interval)).where("__go").drop("__go", "__part")

    return op


def batch_by_time_machine(size: int, timeout: int) -> Machine:
    def step(s: dict, x: int) -> tuple:
        if not s or s["n"] >= size or x >= s["t"] + timeout:
            s["t"], s["n"] = x, 0
        s["n"] += 1
        return s["t"], s["n"] - 1

    return Machine("batch_start bigint, batch_pos int", step)


def batch_by_time(size: int, timeout: int, t: Column, o: Order) -> Op:
    """Each row with ``batch_start``, the time of its batch's first row, and ``batch_pos``: a batch ends when it has ``size`` rows
    or its first row is ``timeout`` old. Event time."""

    def op(df: DataFrame) -> DataFrame:
        parts, po = _split_at_gaps(df, o, t, timeout)
        return scan(parts, po, {"t": t}, batch_by_time_machine(size, timeout)).drop("__part")

    return op


def breaker_machine(threshold: int, reset: int) -> Machine:
    """Each call with ``decision`` (allowed, probe, rejected), the ``state`` after it and the failures counted. ``outcome``:
    ``success``, ``permanent``, ``canceled``, anything else is a failure. One call at a time.

    Closed: ``threshold`` failures in a row open it; success resets the count; permanent errors and cancellation leave it. Open:
    rejects until ``reset`` has passed, then one probe: success or a permanent error closes, a failure or cancellation opens anew.
    """

    def step(s: dict, x: int, out: str) -> tuple:
        if s["state"] == "open":
            if x - s["at"] < reset:
                return "rejected", "open", s["failures"]
            if out in ("success", "permanent"):
                s.update(state="closed", failures=0)
            else:
                s.update(at=x, failures=s["failures"] + (out != "canceled"))
            return "probe", s["state"], s["failures"]
        if out == "success":
            s["failures"] = 0
        elif out not in ("permanent", "canceled"):
            s["failures"] += 1
            if s["failures"] >= threshold:
                s.update(state="open", at=x)
        return "allowed", s["state"], s["failures"]

    return Machine("decision string, state string, failures int", step, lambda: {"state": "closed", "failures": 0, "at": 0})


def circuit_breaker(threshold: int, reset: int, t: Column, outcome: Column, o: Order) -> Op:
    """``breaker_machine`` over each stream's calls."""
    return lambda df: scan(df, o, {"t": t, "out": outcome}, breaker_machine(threshold, reset))


def bucket_machine(per_second: int, burst: int, ttl_us: int = 180_000_000) -> Machine:
    """Each call with ``allowed`` by a token bucket of its key, exact in millionths of a token; a bucket unused for longer than
    ``ttl_us`` begins full. A burst under 1 counts as 1."""
    burst = max(burst, 1) * 1_000_000

    def step(s: dict, x: int) -> tuple:
        if not s or x - s["seen"] > ttl_us:
            s.update(tokens=burst, at=x)
        s["seen"] = x
        s["tokens"] = min(burst, s["tokens"] + (x - s["at"]) * per_second)
        s["at"] = x
        go = s["tokens"] >= 1_000_000
        if go:
            s["tokens"] -= 1_000_000
        return go, s["tokens"]

    return Machine("allowed boolean, tokens bigint", step)


def rate_limit(per_second: int, burst: int, t_us: Column, o: Order, ttl_us: int = 180_000_000) -> Op:
    """``bucket_machine`` over each key's calls."""
    return lambda df: scan(df, o, {"t": t_us}, bucket_machine(per_second, burst, ttl_us))


def concurrency_limit(limit: int, start: Column, end: Column, o: Order) -> Op:
    """Each call with ``allowed``: rejected while ``limit`` admitted ones are in flight. A call that ends at the very start of another is over."""

    def step(s: dict, a: int, b: int) -> tuple:
        ends = s.setdefault("ends", [])
        while ends and ends[0] <= a:
            heapq.heappop(ends)
        go = len(ends) < limit
        if go:
            heapq.heappush(ends, b)
        return go, len(ends)

    return lambda df: scan(df, o, {"a": start, "b": end}, Machine("allowed boolean, in_flight int", step))


def cache_replay(ttl: int, t: Column, succeeded: Column, o: Order) -> Op:
    """Each lookup of a key with ``cache``: ``hit`` within ``ttl`` of the stored success, else ``miss``; a miss that succeeds stores."""

    def step(s: dict, x: int, good: bool) -> tuple:
        if s and x < s["until"]:
            return ("hit",)
        if good:
            s["until"] = x + ttl
        return ("miss",)

    return lambda df: scan(df, o, {"t": t, "ok": succeeded}, Machine("cache string", step))


def layered_cache(ttls: Sequence[int], t: Column, succeeded: Column, o: Order) -> Op:
    """Each lookup of a key in layers, the fastest first, with ``layer``: the first that has an unexpired value (from 0), or null for a
    miss. A hit fills the faster layers again; a miss that succeeds writes to all. ``ttls``: how long each layer keeps a value."""
    if not ttls or min(ttls) <= 0:
        raise ValueError("each layer needs a positive time to live")

    def step(s: dict, x: int, good: bool) -> tuple:
        until = s.setdefault("until", [None] * len(ttls))
        hit = next((i for i, u in enumerate(until) if u is not None and x < u), None)
        for i in range(len(ttls) if hit is None and good else hit or 0):
            until[i] = x + ttls[i]
        return (hit,)

    return lambda df: scan(df, o, {"t": t, "ok": succeeded}, Machine("layer int", step))


def idempotency_machine(ttl: int) -> Machine:
    """Each call with ``idempotency``: ``passthrough`` (no key), ``executed``, ``replayed`` (same payload within ``ttl`` of the
    stored result), ``conflict`` (another payload). A failed execution frees the key. Streams are keys (``o.keys``)."""

    def step(s: dict, x: int, k: str | None, p: str | None, bad: bool) -> tuple:
        if not k:
            return ("passthrough",)
        if s and x < s["until"]:
            return ("replayed",) if p == s["payload"] else ("conflict",)
        s.clear()
        if not bad:
            s.update(until=x + ttl, payload=p)
        return ("executed",)

    return Machine("idempotency string", step)


def idempotency(ttl: int, t: Column, key: Column, payload: Column, failed: Column, o: Order) -> Op:
    """``idempotency_machine`` over each key's calls."""
    return lambda df: scan(df, o, {"t": t, "k": key, "p": payload, "f": failed}, idempotency_machine(ttl))


def reduce_in_order(initial, step: Callable, kind: str, o: Order, item: Column, name: str = "result") -> Op:
    """A strict left fold of each stream, ``step(result, item)``, in a scan with constant memory: (keys..., name). Without keys an
    empty stream gives ``initial``."""

    def one(s: dict, x) -> tuple:
        s["r"] = step(s["r"], x)
        return (s["r"],)

    def op(df: DataFrame) -> DataFrame:
        run = scan(df, o, {"x": item}, Machine(f"__r {kind}", one, lambda: {"r": initial}))
        return run.groupBy(*[col(k) for k in o.keys]).agg(F.coalesce(F.max_by("__r", o.struct()), F.lit(initial).cast(kind)).alias(name))

    return op


def state_machine(allowed: dict[str, set[str]], initial: str | None, to: Column, o: Order) -> Op:
    """Each wanted transition with ``verdict`` and the ``state`` after it: a transition that is not allowed is a conflict and changes
    nothing; staying is allowed; so is anything from no state yet (``initial`` None takes the first state as it is)."""

    def step(s: dict, want: str) -> tuple:
        now = s.get("state", initial)
        if now is None or want == now or want in allowed.get(now, ()):
            if now is not None and now not in allowed:
                return "conflict", now
            s["state"] = want
            return ("entered" if now is None else "same" if want == now else "moved"), want
        return "conflict", now

    return lambda df: scan(df, o, {"to": to}, Machine("verdict string, state string", step))
