"""Work of the worker pool and of the streaming debounce that must not grow with every row."""

import numpy as np
import pandas as pd

from weirflow.operators import compose as k
from weirflow.streaming.processors import DebounceProcessor


def test_worker_pool_halves_failing_batches(spark):
    calls = spark.sparkContext.accumulator(0)
    big = 2**53 + 1

    def work(b):
        calls.add(1)
        if (b["id"] % 97 == 5).any():
            raise ValueError("no")
        return pd.DataFrame({"id": b["id"], "out": b["id"] + big})

    got = k.worker_pool(work, "id bigint, out bigint, _error string", workers=1, keep=["id"])(spark.range(1940)).collect()
    assert sorted((r["id"], r["out"], r["_error"]) for r in got) == [(i, None, "ValueError: no") if i % 97 == 5 else (i, i + big, None) for i in range(1940)]
    assert calls.value < 1940 / 4


class _State:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1


def test_debounce_asks_the_store_a_few_times_a_batch():
    rows = pd.DataFrame({"u": 1, "at": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(300) ** 2, unit="s"), "id": np.arange(300) + 2**53})
    p = DebounceProcessor(300_000, ["at", "id"], list(rows.columns), "")
    p.handle = p.pending = state = _State()
    got = [pd.concat(list(p.handleInputRows((1,), iter([part]), None))) for part in (rows[:200], rows[200:])]
    # the gap after row i is 2 i + 1 seconds
    assert sum((x["id"].tolist() for x in got), []) == [i + 2**53 for i in range(150, 299)]
    assert state.calls <= 12
