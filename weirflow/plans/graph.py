"""Graphs of named nodes that make frames: topological layers, static and routed execution, checkpoints and resumption, drawings."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FlowError
from ..functions.scalars import mermaid_id, mermaid_label
from ..order import order, ordinal
from ..session import cut

State = Mapping[str, DataFrame]
Node = Callable[[State], DataFrame]
END = ("", "end")


def key(node: str) -> str:
    return f"tasks.{node}.output"


def output(state: State, node: str) -> DataFrame:
    """A node's output; there or not, whatever its rows."""
    try:
        return state[key(node)]
    except KeyError:
        raise FlowError("NotFound", f"no output of {node}") from None


class ExecutionError(FlowError):
    """A run that failed or was suspended, with what had been completed."""

    def __init__(self, node: str, cause: Exception, state: State, suspended: bool = False):
        super().__init__("Internal", f"{node}: {cause}")
        self.node, self.cause, self.state, self.suspended = node, cause, state, suspended
        self.completed = sorted(k.split(".", 1)[1].rsplit(".", 1)[0] for k in state if k.startswith("tasks."))


class Suspend(Exception):
    """Raised by a node to pause the run."""


@dataclass
class Builder:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: set[tuple[str, str]] = field(default_factory=set)
    routers: dict[str, Callable[[State], str]] = field(default_factory=dict)
    error: FlowError | None = None

    def _fail(self, kind: str, message: str) -> None:
        self.error = self.error or FlowError(kind, message)

    def node(self, name: str, make: Node | Graph) -> Builder:
        if not name:
            self._fail("Validation", "a node needs a name")
        elif name in self.nodes:
            self._fail("Conflict", f"node {name} twice")
        else:
            self.nodes[name] = make.as_node(name) if isinstance(make, Graph) else make
        return self

    def edge(self, a: str, b: str) -> Builder:
        if (a, b) in self.edges:
            self._fail("Conflict", f"edge {a} -> {b} twice")
        self.edges.add((a, b))
        return self

    def route(self, a: str, router: Callable[[State], str]) -> Builder:
        if a in self.routers:
            self._fail("Conflict", f"node {a} has two routers")
        self.routers[a] = router
        return self

    def compile(self, max_steps: int = 32, entry: str | None = None) -> Graph:
        if self.error:
            raise self.error
        if not self.nodes:
            raise FlowError("Validation", "a graph needs a node")
        if self.routers and self.edges:
            raise FlowError("Validation", "static and conditional edges do not mix")
        for n in [x for e in self.edges for x in e] + list(self.routers) + ([entry] if entry else []):
            if n not in self.nodes:
                raise FlowError("NotFound", f"no node {n}")
        return Graph(dict(self.nodes), frozenset(self.edges), dict(self.routers), layers(self.nodes, self.edges), max_steps, entry or next(iter(self.nodes)))


def layers(nodes: Mapping[str, object], edges: set[tuple[str, str]] | frozenset) -> list[list[str]]:
    """Topological layers, each sorted; a cycle is an error."""
    waiting = dict.fromkeys(nodes, 0)
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        waiting[b] += 1
        after[a].append(b)
    out: list[list[str]] = []
    ready = sorted(n for n, d in waiting.items() if not d)
    while ready:
        out.append(ready)
        for n in ready:
            for b in after[n]:
                waiting[b] -= 1
        ready = sorted({b for n in ready for b in after[n] if not waiting[b]})
    if sum(map(len, out)) < len(waiting):
        raise FlowError("Conflict", "the graph has a cycle")
    return out


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, Node]
    edges: frozenset[tuple[str, str]]
    routers: dict[str, Callable[[State], str]]
    layers: list[list[str]]
    max_steps: int
    entry: str

    def run(self, state: State | None = None, *, on_layer: Callable[[list[str], State], None] | None = None, materialize: bool = False) -> State:
        """All outputs by key. Nodes whose output is in ``state`` are not run again. ``materialize`` writes each output to the shared
        checkpoint folder, the nodes of a layer at the same time; otherwise frames stay lazy and one plan may span nodes."""
        done = dict(state or {})
        return MappingProxyType(self._routed(done, on_layer, materialize) if self.routers else self._layered(done, on_layer, materialize))

    def _make(self, n: str, state: State, materialize: bool) -> DataFrame:
        df = self.nodes[n](MappingProxyType(dict(state)))
        return cut(df) if materialize else df

    def _layered(self, done: dict, on_layer, materialize: bool) -> dict:
        for layer in self.layers:
            todo = [n for n in layer if key(n) not in done]
            with ThreadPoolExecutor(max(1, len(todo))) as pool:
                made = {n: pool.submit(self._make, n, done, materialize) for n in todo}
            failed = None
            for n in todo:  # results in order of the names; the first failure counts
                try:
                    done[key(n)] = made[n].result()
                except Exception as e:  # noqa: BLE001
                    failed = failed or (n, e)
            if failed:
                raise ExecutionError(failed[0], failed[1], done, isinstance(failed[1], Suspend)) from failed[1]
            if on_layer:
                on_layer(layer, MappingProxyType(dict(done)))
        return done

    def _routed(self, done: dict, on_layer, materialize: bool) -> dict:
        at, visited = self.entry, set()
        for _ in range(self.max_steps):
            if at not in self.nodes:
                raise ExecutionError(at, FlowError("NotFound", f"no node {at}"), done)
            if key(at) not in done or at in visited:
                try:
                    done[key(at)] = self._make(at, done, materialize)
                except Exception as e:  # noqa: BLE001
                    raise ExecutionError(at, e, done, isinstance(e, Suspend)) from e
            visited.add(at)
            if on_layer:
                on_layer([at], MappingProxyType(dict(done)))
            if at not in self.routers:
                return done
            at = self.routers[at](MappingProxyType(dict(done)))
            if at in END:
                return done
        raise ExecutionError(at, FlowError("Timeout", f"more than {self.max_steps} steps"), done)

    def as_node(self, name: str, last: str | None = None) -> Node:
        """This graph as a node of another: its output is that of its last node."""
        final = last or self.layers[-1][-1]
        inner: dict[str, State] = {}

        def node(state: State) -> DataFrame:
            try:
                result = self.run({**{k: v for k, v in state.items()}, **inner.pop(name, {})})
            except ExecutionError as e:
                inner[name] = {k: v for k, v in e.state.items() if k not in state}
                raise
            return output(result, final)

        return node

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Nodes with layer, and edges."""
        depth = {n: i for i, layer in enumerate(self.layers) for n in layer}
        return spark.createDataFrame([(n, depth[n]) for n in sorted(self.nodes)], "id string, layer int"), spark.createDataFrame(sorted(self.edges), "from_id string, to_id string")

    def mermaid(self) -> str:
        return mermaid(list(self.nodes), list(self.edges))


def mermaid(nodes: list[str], edges: list[tuple[str, str]]) -> str:
    """The drawing of a graph: header, nodes and edges in order."""
    ident = lambda n: "id_" + n.translate(str.maketrans({".": "_", "-": "_", " ": "_", "(": None, ")": None}))
    if not nodes:
        return ""
    lines = ["flowchart LR"] + [f'    {ident(n)}["{n.replace(chr(34), "#quot;")}"]' for n in sorted(nodes)]
    lines += [f"    {ident(a)} --> {ident(b)}" for a, b in sorted(edges)]
    return "\n".join(lines) + "\n"


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line) of the drawing of a graph that is a table: header, nodes (id) and edges (from_id, to_id), each in order; no
    nodes - no lines."""
    node = F.concat(F.lit("    "), mermaid_id(F.col("id")), F.lit('["'), mermaid_label(F.col("id")), F.lit('"]'))
    edge = F.concat(F.lit("    "), mermaid_id(F.col("from_id")), F.lit(" --> "), mermaid_id(F.col("to_id")))
    head = nodes.limit(1).select(F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("flowchart LR").alias("line"))
    lines = head.unionByName(nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), node.alias("line")))
    lines = lines.unionByName(edges.select(F.lit(2).alias("part"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), edge.alias("line")))
    return ordinal(lines, order("part", "a", "b", "line")).select((F.col("_i") + 1).alias("line_no"), "line")


def save(state: State, folder: str) -> None:
    """Outputs as Parquet, one folder a key. Writing again replaces."""
    for k, df in state.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, k))


def load(spark: SparkSession, folder: str, keys: list[str]) -> dict[str, DataFrame]:
    """The outputs among ``keys`` that have been saved."""
    out = {}
    for k in keys:
        try:
            out[k] = spark.read.parquet(os.path.join(folder, k))
        except AnalysisException as e:  # a file that is there but cannot be read is an error
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def layer_table(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, layer) of graphs that are tables: a node's layer is its longest path from a source.

    Frontier joins, one a layer: the nodes that no open node leads to are taken and the counts of edges into the others lowered.
    If nodes are left when none can be taken, they are on or behind a cycle, which is an error; a graph of more layers than
    ``max_depth`` is another.
    """
    known = nodes.select("id").distinct()
    links = cut(edges.select("from_id", "to_id").distinct().join(known, F.col("to_id") == F.col("id"), "left_semi").join(known, F.col("from_id") == F.col("id"), "left_semi"))
    into = links.groupBy(F.col("to_id").alias("__to")).agg(F.count(F.lit(1)).alias("d"))
    open_ = known.join(into, F.col("id") == F.col("__to"), "left").select("id", F.coalesce("d", F.lit(0).cast("bigint")).alias("d"))
    done: list[DataFrame] = []
    while True:
        step = cut(open_)
        at = step.where("d = 0").select("id", F.lit(len(done)).alias("layer"))
        if at.isEmpty():
            if not step.isEmpty():
                raise FlowError("Conflict", "the graph has a cycle")
            return functools.reduce(DataFrame.unionByName, done) if done else at
        if max_depth is not None and len(done) >= max_depth:
            raise FlowError("Timeout", f"the graph has more than {max_depth} layers")
        done.append(at)
        fewer = links.join(at.select(F.col("id").alias("__at")), F.col("from_id") == F.col("__at"), "left_semi").groupBy(F.col("to_id").alias("__to")).agg(F.count(F.lit(1)).alias("k"))
        open_ = step.where("d > 0").join(fewer, F.col("id") == F.col("__to"), "left").select("id", (F.col("d") - F.coalesce("k", F.lit(0))).alias("d"))
