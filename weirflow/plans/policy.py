"""Driver-side execution policies around building and running frames: retry, breaker, deadline, hedge, locks, drain, journal."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Hashable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import TRANSIENT, FlowError


def retry(fn: Callable[[], Any], times: int, wait_s: Callable[[int], float] = lambda n: min(2.0, 0.1 * 2 ** (n - 1)) * random.uniform(0.7, 1.3), when: Callable[[Exception], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Up to ``times`` further attempts while the failure is transient (or ``when`` says so)."""
    when = when or (lambda e: getattr(e, "kind", "") in TRANSIENT)
    for n in range(times + 1):
        try:
            return fn()
        except Exception as e:  # noqa: BLE001
            if n == times or not when(e):
                raise
            sleep(wait_s(n + 1))
    return None


def deadline(spark: SparkSession, seconds: float, fn: Callable[[], Any]) -> Any:
    """Spark work of ``fn`` under a job group that is cancelled at the deadline."""
    group = f"deadline-{threading.get_ident()}-{time.monotonic_ns()}"
    late = threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    spark.sparkContext.setJobGroup(group, "with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        return fn()
    except Exception as e:
        if late.is_set():
            raise FlowError("Timeout", f"not done in {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)


def first_done(*fns: Callable[[], Any], substantive: Callable[[Exception], bool] = lambda e: getattr(e, "kind", "") != "Canceled", spark: SparkSession | None = None) -> Any:
    """The first success by the clock; if none, the first substantive failure, else the first. The others are not waited for; with
    ``spark``, their Spark jobs are cancelled."""
    if not fns:
        return None
    sc = spark.sparkContext if spark is not None else None
    tag = f"race-{threading.get_ident()}-{time.monotonic_ns()}"

    def run(f: Callable[[], Any]) -> Any:
        if sc is not None:
            sc.addJobTag(tag)
        return f()

    pool = ThreadPoolExecutor(len(fns))
    try:
        pending: set[Future] = {pool.submit(run, f) for f in fns}
        errors: list[Exception] = []
        while pending:
            done, pending = wait(pending, return_when=FIRST_COMPLETED)
            for d in done:
                if d.exception() is None:
                    return d.result()
                errors.append(d.exception())
    finally:
        if sc is not None:
            sc.cancelJobsWithTag(tag)
        pool.shutdown(wait=False, cancel_futures=True)
    raise next((e for e in errors if substantive(e)), errors[0])


class Breaker:
    """Opens after ``threshold`` failures in a row, lets one attempt through ``reset_s`` later and closes when that succeeds."""

    def __init__(self, threshold: int, reset_s: float, clock: Callable[[], float] = time.monotonic):
        if threshold < 1 or reset_s <= 0:
            raise FlowError("Validation", "a breaker needs a positive threshold and reset time")
        self._threshold, self._reset, self._clock = threshold, reset_s, clock
        self._mutex, self._failures, self._opened, self._probing = threading.Lock(), 0, None, False

    def call(self, fn: Callable[[], Any]) -> Any:
        with self._mutex:
            if self._opened is not None:
                if self._probing or self._clock() - self._opened < self._reset:
                    raise FlowError("Unavailable", "the circuit is open")
                self._probing = True
        try:
            out = fn()
        except Exception as e:
            with self._mutex:
                counted = getattr(e, "kind", "") in TRANSIENT
                self._failures = self._failures + 1 if counted else self._failures
                if counted and (self._probing or self._failures >= self._threshold):
                    self._opened = self._clock()
                elif self._probing and getattr(e, "kind", "") != "Canceled":
                    self._opened, self._failures = None, 0
                self._probing = False
            raise
        with self._mutex:
            self._failures, self._opened, self._probing = 0, None, False
        return out


@dataclass
class Resilience:
    """Policies in one fixed order, whatever the order they are named in: concurrency, breaker, retries, a deadline per attempt."""

    retries: int = 0
    timeout_s: float = 0
    max_concurrent: int = 0
    breaker: Breaker | None = None
    adaptive: Breaker | None = None
    wait_s: Callable[[int], float] = lambda n: min(5.0, 0.2 * 2 ** (n - 1)) * random.uniform(0.7, 1.3)
    when: Callable[[Exception], bool] | None = None
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        for name in ("retries", "timeout_s", "max_concurrent"):
            if getattr(self, name) < 0:
                raise FlowError("Validation", f"{name} must not be negative")
        if self.breaker is not None and self.adaptive is not None:
            raise FlowError("Validation", "a breaker and an adaptive breaker exclude each other")
        self._slots = threading.BoundedSemaphore(self.max_concurrent) if self.max_concurrent else None

    def call(self, fn: Callable[[], Any], spark: SparkSession | None = None) -> Any:
        """``fn`` under the policies; a deadline needs ``spark``, whose jobs it cancels."""
        if self.timeout_s and spark is None:
            raise FlowError("Validation", "a deadline needs the session")
        attempt = (lambda: deadline(spark, self.timeout_s, fn)) if self.timeout_s else fn
        tried = lambda: retry(attempt, self.retries, self.wait_s, self.when, self.sleep)
        guard = self.breaker or self.adaptive
        if self._slots is not None and not self._slots.acquire(blocking=False):
            raise FlowError("RateLimited", "too many calls at once")
        try:
            return guard.call(tried) if guard else tried()
        finally:
            if self._slots is not None:
                self._slots.release()


def in_parallel(fns: list[Callable[[], Any]], workers: int = 16) -> list[tuple[Any, Exception | None]]:
    """(result, error) of each, in their order."""

    def safe(f: Callable[[], Any]) -> tuple[Any, Exception | None]:
        try:
            return f(), None
        except Exception as e:  # noqa: BLE001
            return None, e

    with ThreadPoolExecutor(max(1, min(workers, len(fns)))) as pool:
        return list(pool.map(safe, fns))


@dataclass
class Saga:
    """Forward steps; on failure the completed ones are undone, last first. ``log`` is the step log."""

    steps: list[tuple[str, Callable[[Any], Any], Callable[[Any], None] | None, bool]] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)
    rolled_back: bool = False

    def step(self, name: str, do: Callable[[Any], Any], undo: Callable[[Any], None] | None = None, optional: bool = False) -> Saga:
        self.steps.append((name, do, undo, optional))
        return self

    def run(self, request: Any, chained: bool = False) -> Any:
        """Every step gets the request (``chained``: the step before's output); the result is the last success."""
        done: list[tuple[str, Callable | None, Any]] = []
        out = value = request
        self.log, self.rolled_back = [], False
        for name, do, undo, optional in self.steps:
            began = time.monotonic()
            try:
                out = do(value)
                ok, err = True, ""
            except Exception as e:  # noqa: BLE001
                ok, err, failure = False, str(e), e
            self.log.append({"step": name, "success": ok, "skipped": not ok and optional, "error": err, "duration_ms": int((time.monotonic() - began) * 1000)})
            if ok:
                done.append((name, undo, out))
                value = out if chained else request
            elif not optional:
                clean = True
                for _, back, made in reversed(done):
                    try:
                        clean = clean and back is not None
                        if back:
                            back(made)
                    except Exception:  # noqa: BLE001
                        clean = False
                self.rolled_back = bool(done) and clean
                raise failure
        return out


class FencedLock:
    """Try-locks by key with an ever growing fence."""

    def __init__(self) -> None:
        self._mutex, self._held, self._fence = threading.Lock(), set(), {}

    @contextmanager
    def hold(self, key: Hashable):
        if not key:
            yield 0
            return
        with self._mutex:
            if key in self._held:
                raise FlowError("Conflict", f"{key} is locked")
            self._held.add(key)
            fence = self._fence[key] = self._fence.get(key, 0) + 1
        try:
            yield fence
        finally:
            with self._mutex:
                self._held.discard(key)


class Drain:
    """Refuses new work once draining and waits for what is under way. Used once."""

    def __init__(self) -> None:
        self._state, self._active, self._closed = threading.Condition(), 0, False

    @contextmanager
    def work(self):
        with self._state:
            if self._closed:
                raise FlowError("Shutdown", "draining")
            self._active += 1
        try:
            yield
        finally:
            with self._state:
                self._active -= 1
                self._state.notify_all()

    def drain(self, timeout: float | None = None) -> bool:
        with self._state:
            self._closed = True
            return self._state.wait_for(lambda: not self._active, timeout)


class Journal:
    """Step results as Parquet by (execution, step): a step that was recorded is read, not run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def step(self, execution: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not name:
            raise FlowError("Validation", "a step needs a name")
        if not execution:
            return make()
        path = f"{self.folder}/{execution}/{name}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
