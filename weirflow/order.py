"""Order of a stream. A DataFrame has none, so every order-sensitive operator names its order, with a unique tiebreaker."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .session import col, cut


@dataclass(frozen=True)
class Order:
    """``by``: order columns, the last of them unique; ``keys``: each key is a stream of its own (none: one stream)."""

    by: tuple[str, ...]
    keys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.by:
            raise ValueError("an order needs at least one column")

    def window(self, descending: bool = False) -> WindowSpec:
        cols = [col(c).desc() if descending else col(c) for c in self.by]
        return Window.partitionBy(*[col(k) for k in self.keys]).orderBy(*cols)

    def struct(self, *extra: Column) -> Column:
        """The order columns first, so that sorting an array of such structs restores the order."""
        return F.struct(*[col(c).alias(f"_o{i}") for i, c in enumerate(self.by)], *extra)


def order(*by: str, keys: Sequence[str] = ()) -> Order:
    return Order(tuple(by), tuple(keys))


#: Rows of a key from which on it is numbered over many tasks.
HOT_ROWS = 1_000_000


def ordinal(df: DataFrame, o: Order, name: str = "_i", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``df`` with each row's place (from 0) in its stream. A frame that already has it, from an earlier operator of the same
    order, is returned as it is: each ordinal costs a sort.

    Streams by key take one window, in which a key is sorted by one task. Keys of more than ``hot_rows`` rows are found first (an
    aggregate over the keys alone) and numbered over many tasks; ``None``: none is looked for. The one stream of an order without
    keys always is.
    """
    if name in df.columns:
        return df
    if not o.keys:
        return _spread(df, o, name)
    place = F.row_number().over(o.window()) - 1
    if hot_rows is None:
        return df.withColumn(name, place.cast("bigint"))
    hot = cut(df.groupBy(*[col(k).alias(f"__h{i}") for i, k in enumerate(o.keys)]).agg(F.count(F.lit(1)).alias("__n")).where(f"__n > {hot_rows}").drop("__n"))
    if hot.isEmpty():
        return df.withColumn(name, place.cast("bigint"))
    # at most rows / hot_rows keys are hot, so their table is small whatever the data
    same = functools.reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(o.keys)])
    cold = df.join(F.broadcast(hot), same, "left_anti").withColumn(name, place.cast("bigint"))
    return cold.unionByName(_spread(df.join(F.broadcast(hot), same, "left_semi"), o, name))


def _spread(df: DataFrame, o: Order, name: str) -> DataFrame:
    """Ordinals by range partitions: rows are sorted by (keys, order) over many tasks, each key's rows are counted per partition and
    shifted by the counts of the partitions before. There are as many counts as keys and partitions together; they are joined, not collected."""
    keys = [col(k) for k in o.keys]
    by = [*keys, *[col(c) for c in o.by]]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("__m"), F.lit(33))
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    runs = placed.groupBy(part.alias("__p"), *named).agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(up), F.lit(0))).drop("__n")
    on = part == F.col("__p")
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"__k{i}"))
    return placed.join(F.broadcast(runs), on).withColumn(name, F.col("__m") - F.col("__first") + F.col("__before")).select(*df.columns, name)
