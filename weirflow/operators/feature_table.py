"""Per-entity feature table: one row per entity with count, recency and total of every event type.

Plan: each record is counted once (group by a 128-bit record fingerprint, so a hot entity spreads over all tasks), then
partial aggregation by (entity, type) to a compact long table, then a pivot with an explicit type list. Only the type list
and one timestamp reach the driver. After the long table, an entity has at most one row per type, so no entity is hot.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clean_id, fingerprint, micros
from ..session import col, cut


def distinct_records(df: DataFrame, keep: dict[str, Column], ids: Sequence[str], texts: Sequence[str], others: Sequence[str]) -> DataFrame:
    """``keep``'s columns once per record. Records are equal if all ``ids``, ``texts`` and ``others`` are; everything in
    ``keep`` must follow from these."""
    a, b = fingerprint([col(c) for c in ids], [col(c) for c in texts], [col(c) for c in others])
    rows = df.select(*[v.alias(k) for k, v in keep.items()], a.alias("__fp_a"), b.alias("__fp_b"))
    # grouping by all columns keeps to hash aggregation; dropDuplicates on the two would sort, for the strings among the rest
    return rows.distinct().drop("__fp_a", "__fp_b")


def long_features(records: DataFrame, entity: str, event_type: str, time_us: str, measure: str) -> DataFrame:
    """(entity, event_type, n, last_us, total) from one row per record; a missing measure counts as 0."""
    return records.groupBy(col(entity).alias("entity"), col(event_type).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.max(col(time_us)).alias("last_us"), F.sum(F.coalesce(col(measure).cast("bigint"), F.lit(0).cast("bigint"))).alias("total")
    )


def column_stems(types: Sequence[str]) -> list[str]:
    """A distinct plain column stem for each type: runs of other characters become ``_``; a clash gets a number."""
    seen: dict[str, int] = {}
    out = []
    for t in types:
        stem = re.sub(r"[^a-z0-9]+", "_", t.lower())
        seen[stem] = seen.get(stem, 0) + 1
        while seen[stem] > 1 and f"{stem}_{seen[stem]}" in seen:
            seen[stem] += 1
        name = stem if seen[stem] == 1 else f"{stem}_{seen[stem]}"
        seen.setdefault(name, 1)
        out.append(name)
    return out


def pivot_features(long: DataFrame, types: Sequence[str] | None = None, as_of_us: int | None = None, max_types: int = 4000) -> DataFrame:
    """One row per entity: ``n_records``, ``last_us``, ``total`` over all types (untyped records included), and for each type t
    ``n__t``, ``last_us__t``, ``age_us__t`` (``as_of_us`` less the last time; default the latest time of all) and ``total__t``.

    A type an entity never had gives 0, null, null, 0. Without ``types``, the list is every type found; more than
    ``max_types`` raise an error that asks for an explicit list (nothing is dropped silently). Records without entity are left out.
    """
    if types is None:
        found = long.where("event_type is not null").select("event_type").distinct().limit(max_types + 1).collect()
        if len(found) > max_types:
            raise ValueError(f"more than {max_types} event types: pass an explicit list of the wanted types")
        types = sorted(r["event_type"] for r in found)
    if as_of_us is None:
        as_of_us = long.agg(F.max("last_us")).first()[0]
    types = list(types)
    stems = column_stems(types)
    named = long.where("entity is not null")
    total = named.groupBy("entity").agg(F.sum("n").alias("n_records"), F.max("last_us").alias("last_us"), F.sum("total").alias("total"))
    if not types:
        return total
    wide = named.groupBy("entity").pivot("event_type", types).agg(F.max("n").alias("n"), F.max("last_us").alias("l"), F.max("total").alias("t"))
    # a thousand columns as texts: one call to the JVM instead of ten thousand
    q = lambda name: "`" + name.replace("`", "``") + "`"
    as_of = "cast(null as bigint)" if as_of_us is None else f"cast({as_of_us} as bigint)"
    cols = ["entity"]
    for t, s in zip(types, stems):
        last = q(f"{t}_l")
        cols += [f"coalesce({q(f'{t}_n')}, 0L) as n__{s}", f"{last} as last_us__{s}", f"{as_of} - {last} as age_us__{s}", f"coalesce({q(f'{t}_t')}, 0L) as total__{s}"]
    return total.join(wide.selectExpr(*cols), "entity")


def feature_table(
    df: DataFrame, entity: str, event_type: str, time: str, measure: str, *, ids: Sequence[str], texts: Sequence[str] = (), others: Sequence[str] = (),
    types: Sequence[str] | None = None, as_of_us: int | None = None, max_types: int = 4000,
) -> DataFrame:
    """Feature table of ``df``. Entity and type are read as ids (letter case and surrounding blanks do not matter).

    Defined cases: null or blank entity - left out; null or blank type - counted in the totals only; null time - counted, gives
    no last time; null measure - 0; repeated records (equal in ``ids``, ``texts``, ``others``) count once; empty table - no rows;
    further columns of ``df``, whatever their names, are ignored.
    """
    keep = {"e": clean_id(col(entity)), "k": clean_id(col(event_type)), "t": micros(col(time)), "m": col(measure)}
    long = cut(long_features(distinct_records(df, keep, ids, texts, others), "e", "k", "t", "m"))
    return pivot_features(long, types, as_of_us, max_types)
