"""Streaming forms of the stateful operators on Structured Streaming. Each runs the state machine of its batch form, so over the
same rows in the same order both give the same results."""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.folds import Machine


class FoldProcessor(StatefulProcessor):
    """A machine per key. Rows of a micro-batch are put in order first; the state is kept as JSON, with a time to live if given."""

    def __init__(self, machine: Machine, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], columns: Sequence[str], ttl_ms: int | None):
        self.machine, self.keys, self.order, self.inputs, self.columns, self.ttl_ms = machine, list(keys), list(order), list(inputs), list(columns), ttl_ms
        self.names = [f.name for f in StructType.fromDDL(machine.outputs).fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "json string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.fresh()
        args = [[None if pd.isna(v) else v for v in batch[c].tolist()] for c in self.inputs]
        made = [self.machine.step(state, *x) for x in zip(*args)]
        self.state.update((json.dumps(state),))
        yield pd.concat([batch[self.columns], pd.DataFrame(made, columns=self.names)], axis=1)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, machine: Machine, keys: Sequence[str], order: Sequence[str], inputs: dict[str, Column], *, mode: str = "append", ttl_ms: int | None = None) -> DataFrame:
    """A streaming frame with the machine's outputs per key. Order holds within each micro-batch and over micro-batches as they come."""
    columns = df.columns
    fed = df.withColumns({f"in_{k}": c for k, c in inputs.items()})
    out = StructType(df.schema.fields + StructType.fromDDL(machine.outputs).fields)
    processor = FoldProcessor(machine, keys, order, [f"in_{k}" for k in inputs], columns, ttl_ms)
    return fed.groupBy(*keys).transformWithStateInPandas(processor, out, mode, "none")


class DebounceProcessor(StatefulProcessor):
    """The row of a key that no newer one follows within the interval: kept back until event time has passed it by that much."""

    def __init__(self, interval_ms: int, order: Sequence[str], columns: Sequence[str], schema: str):
        self.interval_ms, self.order, self.columns, self.schema = interval_ms, list(order), list(columns), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "row string, at bigint")

    def _row(self, text: str) -> pd.DataFrame:
        return pd.DataFrame([pickle.loads(base64.b64decode(text))], columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if len(batch) > 1:
            batch = batch.sort_values(self.order, kind="stable", ignore_index=True)
        times = batch[self.order[0]].astype("datetime64[us]").astype("int64").to_numpy()
        last = self.pending.get()
        if last is not None:
            self.handle.deleteTimer(last[1] // 1000 + self.interval_ms)
            if times[0] - last[1] >= self.interval_ms * 1000:
                yield self._row(last[0])
        quiet = np.flatnonzero(np.diff(times) >= self.interval_ms * 1000)
        if len(quiet):
            yield batch.iloc[quiet][self.columns]
        at = int(times[-1])
        # the one row that is kept, its values as they are
        self.pending.update((base64.b64encode(pickle.dumps([batch[c].iloc[-1] for c in self.columns])).decode(), at))
        self.handle.registerTimer(at // 1000 + self.interval_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.pending.get()
        if last is not None:
            self.pending.clear()
            yield self._row(last[0])

    def close(self) -> None:
        pass


def debounce_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], interval_ms: int) -> DataFrame:
    """Debounced rows of a streaming frame with a watermark on ``order[0]`` (a timestamp)."""
    processor = DebounceProcessor(interval_ms, order, df.columns, "")
    return df.groupBy(*keys).transformWithStateInPandas(processor, df.schema, "append", "eventTime")


def distinct_stream(df: DataFrame, keys: Sequence[str], within: bool = True) -> DataFrame:
    """First rows by key; with a watermark (``within``) the memory of keys is bounded by it."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if within else df.dropDuplicates(list(keys))


def counted_stream(df: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per time window and key, with late rows accepted up to ``late``."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def session_stream(df: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Sessions of event time, closed once the watermark has passed them."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
