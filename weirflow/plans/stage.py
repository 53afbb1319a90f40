"""Stages: named frame operators with schemas and configuration, composed to pipelines and simplified before they run."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import FlowError


def check_schema(df: DataFrame, want: StructType | None, who: str) -> DataFrame:
    """The frame has the columns a stage declares (others may be there too)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in want.fields if want else ():
        if f.name not in have:
            raise FlowError("Validation", f"{who}: no column {f.name}")
        if have[f.name] != f.dataType:
            raise FlowError("Validation", f"{who}: column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df


@dataclass(frozen=True)
class Stage:
    """A named operator. ``kind`` and ``args`` tell the rewrites of ``simplify`` what it does; a stage without kind is opaque."""

    name: str
    fn: Callable[[DataFrame], DataFrame]
    in_schema: StructType | None = None
    out_schema: StructType | None = None
    kind: str = ""
    args: tuple = ()
    description: str = ""

    def __call__(self, df: DataFrame) -> DataFrame:
        return check_schema(self.fn(check_schema(df, self.in_schema, self.name)), self.out_schema, self.name)


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]

    @property
    def name(self) -> str:
        return self.stages[0].name if len(self.stages) == 1 else f"compose({' -> '.join(s.name for s in self.stages)})"

    def __call__(self, df: DataFrame) -> DataFrame:
        return functools.reduce(lambda d, s: s(d), simplify(self.stages), df)

    def explain(self) -> list[str]:
        return [s.name for s in simplify(self.stages)]


def compose(*stages: Stage) -> Pipeline:
    if not stages:
        raise FlowError("Validation", "nothing to compose")
    return Pipeline(tuple(stages))


def map_stage(name: str, **exprs: Column) -> Stage:
    from ..operators.stream import map_

    return Stage(name, map_(**exprs), kind="map")


def filter_stage(name: str, condition: Column) -> Stage:
    from ..operators.stream import filter_

    return Stage(name, filter_(condition), kind="filter", args=(condition,))


def take_stage(name: str, n: int, o: Any) -> Stage:
    from ..operators.stream import take

    return Stage(name, take(n, o), kind="take", args=(n, o))


def distinct_stage(name: str, o: Any, *by: str) -> Stage:
    from pyspark.sql import functions as F

    from ..operators.stream import distinct_by

    return Stage(name, distinct_by(o, *[F.col(b) for b in by]), kind="distinct", args=(o, by))


def simplify(stages: Sequence[Stage]) -> list[Stage]:
    """Adjacent filters become one, of adjacent takes of one order the smaller stays, a distinct after the same distinct goes.
    (Maps and projections are collapsed by the optimizer.)"""
    out: list[Stage] = []
    for s in stages:
        last = out[-1] if out else None
        if last and s.kind == last.kind == "filter":
            out[-1] = filter_stage(f"{last.name}&{s.name}", last.args[0] & s.args[0])
        elif last and s.kind == last.kind == "take" and s.args[1] == last.args[1]:
            out[-1] = min(last, s, key=lambda x: x.args[0])
        elif last and s.kind == last.kind == "distinct" and s.args == last.args:
            continue
        else:
            out.append(s)
    return out


def configured(config: type, values: Mapping[str, Any]) -> Any:
    """A configuration dataclass from loose values: texts are coerced by the field's type, unknown keys are an error."""
    fields = {f.name: f for f in dataclasses.fields(config)}
    unknown = set(values) - set(fields)
    if unknown:
        raise FlowError("Validation", f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for k, v in values.items():
        kind = fields[k].type if isinstance(fields[k].type, str) else fields[k].type.__name__
        try:
            if isinstance(v, str) and kind == "bool":
                if v.strip() not in ("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False"):
                    raise ValueError(v)
                v = v.strip() in ("1", "t", "T", "TRUE", "true", "True")
            elif isinstance(v, str) and kind in ("int", "float"):
                v = {"int": int, "float": float}[kind](v.strip())
            elif isinstance(v, str) and kind.startswith("list"):
                v = [p.strip() for p in v.split(",") if p.strip()]
        except ValueError as e:
            raise FlowError("Validation", f"{k}: {e}") from e
        out[k] = v
    return config(**out)


@dataclass
class Meta:
    """What is known of a named source or stage."""

    name: str
    description: str = ""
    node: str = ""
    tags: tuple[str, ...] = ()
    scope: str = ""
    requires_auth: bool = False


@dataclass
class Registry:
    """Named sources, stages and operator builders, with aliases and explicit overrides. A library is taken on as a whole or not at all."""

    sources: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    operators: dict[str, tuple[Callable[..., Stage], type | None]] = field(default_factory=dict)
    metas: dict[str, Meta] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def add(self, *, sources: Mapping[str, Callable] | None = None, operators: Mapping[str, tuple[Callable, type | None]] | None = None, metas: Sequence[Meta] = (), aliases: Mapping[str, str] | None = None, override: Sequence[str] = ()) -> None:
        sources, operators, aliases = dict(sources or {}), dict(operators or {}), dict(aliases or {})
        new = [*sources, *operators, *aliases]
        taken = {*self.sources, *self.operators, *self.aliases}
        clash = [n for n in new if n in taken and n not in override] + [n for n in new if new.count(n) > 1]
        if clash:
            raise FlowError("Conflict", f"already registered: {', '.join(sorted(set(clash)))}")
        missing = [n for n in override if n not in taken]
        if missing:
            raise FlowError("NotFound", f"nothing to override: {', '.join(missing)}")
        known = {*taken, *sources, *operators}
        lost = [t for t in aliases.values() if t not in known]
        if lost:
            raise FlowError("NotFound", f"aliases of unknown names: {', '.join(lost)}")
        self.sources |= sources
        self.operators |= operators
        self.aliases |= aliases
        self.metas |= {m.name: m for m in metas}

    def resolve(self, name: str) -> str:
        return self.aliases.get(name, name)

    def source(self, name: str) -> Callable[..., DataFrame]:
        try:
            return self.sources[self.resolve(name)]
        except KeyError:
            raise FlowError("NotFound", f"no source {name}") from None

    def operator(self, name: str, **params: Any) -> Stage:
        try:
            build, config = self.operators[self.resolve(name)]
        except KeyError:
            raise FlowError("NotFound", f"no operator {name}") from None
        return build(configured(config, params)) if config else build(**params)

    def pipeline(self, spark: SparkSession, source: str, steps: Sequence[tuple[str, Mapping[str, Any]]], **params: Any) -> DataFrame:
        """A source and operators by name, configured from loose values."""
        df = self.source(source)(spark, **params)
        return compose(*[self.operator(n, **p) for n, p in steps])(df) if steps else df

    def names(self) -> list[str]:
        return sorted({*self.sources, *self.operators, *self.aliases})

    def table(self, spark: SparkSession) -> DataFrame:
        """The metadata as a table."""
        rows = [(m.name, m.description, m.node, list(m.tags), m.scope, m.requires_auth) for _, m in sorted(self.metas.items())]
        return spark.createDataFrame(rows, "name string, description string, node string, tags array<string>, scope string, requires_auth boolean")


class Proxy:
    """A stage behind a name: rebinding it affects plans built afterwards only."""

    def __init__(self, stage: Callable[[DataFrame], DataFrame]):
        self._stage = stage

    def swap(self, stage: Callable[[DataFrame], DataFrame]) -> None:
        self._stage = stage

    def __call__(self, df: DataFrame) -> DataFrame:
        return self._stage(df)


def once(source: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """A source built once: the first result, or the first error, is given again."""
    kept: list = []

    def get() -> DataFrame:
        if not kept:
            try:
                kept.append((source().persist(), None))
            except Exception as e:  # noqa: BLE001
                kept.append((None, e))
        df, e = kept[0]
        if e is not None:
            raise e
        return df

    return get
