"""Observers and wrappers of stages, and a bounded export of what a plan is made of."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import FlowError
from .graph import Graph
from .stage import Pipeline, Stage

log = logging.getLogger(__name__)
Middleware = Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Hook:
    """Called around the building of a stage's frame. ``wanted`` decides once, when the hook is attached. ``before`` may refuse by
    raising; what the others raise is logged and ignored."""

    before: Callable[[Stage, DataFrame], None] | None = None
    after: Callable[[Stage, DataFrame | None, Exception | None], None] | None = None
    success: Callable[[Stage, DataFrame], None] | None = None
    error: Callable[[Stage, Exception], None] | None = None
    timeout: Callable[[Stage], None] | None = None
    cancel: Callable[[Stage], None] | None = None
    wanted: Callable[[Stage], bool] = lambda s: True


def _quietly(f: Callable[..., Any] | None, *args: Any) -> None:
    if f:
        try:
            f(*args)
        except Exception:  # noqa: BLE001
            log.exception("a hook failed")


def hooked(stage: Stage, *hooks: Hook) -> Stage:
    """``stage`` with those hooks that want it; those that do not cost nothing. Exits are told in reverse order."""
    mine = [h for h in hooks if h.wanted(stage)]
    if not mine:
        return stage

    def fn(df: DataFrame) -> DataFrame:
        for h in mine:
            if h.before:
                h.before(stage, df)
        try:
            out = stage.fn(df)
        except Exception as e:
            for h in reversed(mine):
                kind = getattr(e, "kind", "")
                if kind == "Timeout":
                    _quietly(h.timeout, stage)
                if kind == "Canceled":
                    _quietly(h.cancel, stage)
                else:
                    _quietly(h.error, stage, e)
                _quietly(h.after, stage, None, e)
            raise
        for h in reversed(mine):
            _quietly(h.success, stage, out)
            _quietly(h.after, stage, out, None)
        return out

    return Stage(stage.name, fn, stage.in_schema, stage.out_schema, stage.kind, stage.args, stage.description)


def wrapped(stage: Stage, *middleware: Middleware) -> Stage:
    """Middleware around a stage, the first outermost."""
    fn = stage.fn
    for m in reversed(middleware):
        fn = m(fn)
    return Stage(stage.name, fn, stage.in_schema, stage.out_schema, "", (), stage.description)


def inspect(root: Stage | Pipeline | Graph, max_nodes: int = 10_000, max_edges: int = 20_000) -> tuple[list[tuple[int, str, str, int]], list[tuple[int, int, str]], bool]:
    """(nodes (id, name, kind, depth), edges (from, to, relation), whether something was left out for the bounds)."""
    nodes: list[tuple[int, str, str, int]] = []
    edges: list[tuple[int, int, str]] = []
    cut = False

    def add(name: str, kind: str, depth: int) -> int | None:
        nonlocal cut
        if len(nodes) >= max_nodes:
            cut = True
            return None
        nodes.append((len(nodes), name, kind, depth))
        return len(nodes) - 1

    def link(a: int | None, b: int | None, relation: str) -> None:
        nonlocal cut
        if a is None or b is None or len(edges) >= max_edges:
            cut = True
        else:
            edges.append((a, b, relation))

    if isinstance(root, Stage):
        add(root.name, root.kind or "stage", 0)
    elif isinstance(root, Pipeline):
        top = add(root.name, "pipeline", 0)
        before = None
        for s in root.stages:
            at = add(s.name, s.kind or "stage", 1)
            link(top, at, "contains")
            if before is not None:
                link(before, at, "then")
            before = at
    elif isinstance(root, Graph):
        top = add("graph", "graph", 0)
        at = {n: add(n, "routed" if n in root.routers else "node", 1) for n in sorted(root.nodes)}
        for n in at.values():
            link(top, n, "contains")
        for a, b in sorted(root.edges):
            link(at[a], at[b], "feeds")
    else:
        raise FlowError("Validation", "not a plan")
    return nodes, edges, cut


def inspected(spark: SparkSession, root: Stage | Pipeline | Graph) -> tuple[DataFrame, DataFrame]:
    """The same as tables."""
    nodes, edges, _ = inspect(root)
    return spark.createDataFrame(nodes, "id int, name string, kind string, depth int"), spark.createDataFrame(edges, "from_id int, to_id int, relation string")


