"""Canonical values: ids and names, Go duration text, record fingerprints. All are JVM-side Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding blanks.
BLANKS = " \t\n\r\f\v "

#: Nanoseconds of each Go duration unit (fixed values).
GO_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_NUMBER = r"(\d+(?:\.\d*)?|\.\d+)"
_UNIT = "(ns|us|µs|μs|ms|s|m|h)"


def clean_text(c: Column) -> Column:
    """Without surrounding blanks; a blank string is no value."""
    return F.nullif(F.trim(c, F.lit(BLANKS)), F.lit(""))


def clean_id(c: Column) -> Column:
    """An id or name: other letter case or surrounding blanks make no other id; a blank one is no value."""
    return F.lower(clean_text(c))


def micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone, taken as UTC whatever the session's zone (a timestamp with
    zone counts by its wall clock in the session's zone)."""
    since = c.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    return part("DAY").cast("bigint") * 86_400_000_000 + part("HOUR").cast("bigint") * 3_600_000_000 + part("MINUTE").cast("bigint") * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def go_duration_ns(c: Column) -> Column:
    """Nanoseconds of a Go duration text (``1.5ms``, ``2m3s``, ``-0.5h``, ``0``). Null for null, blank, text that is
    no Go duration and values beyond 64 bits; surrounding blanks do not matter. Fractions below 1 ns are cut off per part."""
    text = F.trim(c, F.lit(BLANKS))
    body = F.regexp_replace(text, r"^[+-]", "")
    part = F.lit(_NUMBER + _UNIT)
    number, unit = F.regexp_extract_all(body, part, F.lit(1)), F.regexp_extract_all(body, part, F.lit(2))
    scale = F.create_map(*[F.lit(x) for k, v in GO_UNITS.items() for x in (k, v)])

    def nanos(x: Column) -> Column:
        """Whole units and the fraction apart, so that neither is rounded; more than 19 digits before the point fit no 64 bits."""
        unit_ = F.element_at(scale, x["u"])
        whole = F.concat(F.lit("0"), F.substring_index(x["n"], ".", 1)).try_cast("decimal(20,0)") * unit_.cast("decimal(14,0)")
        digits = F.when(F.contains(x["n"], F.lit(".")), F.substring(F.substring_index(x["n"], ".", -1), 1, 17)).otherwise(F.lit(""))
        return whole + F.floor(F.concat(F.lit("0."), digits, F.lit("0")).cast("decimal(18,17)") * unit_.cast("decimal(14,0)"))

    value = F.aggregate(
        F.arrays_zip(number.alias("n"), unit.alias("u")),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, x: (acc + nanos(x)).cast("decimal(38,0)"),
        lambda acc: F.when(text.startswith("-"), -acc).otherwise(acc),
    ).try_cast("bigint")
    return F.when(body == "0", F.lit(0).cast("bigint")).when(text.rlike(rf"^[+-]?(?:{_NUMBER}{_UNIT})+\z"), value)


def fingerprint(ids: Sequence[Column] = (), texts: Sequence[Column] = (), others: Sequence[Column] = ()) -> list[Column]:
    """Two 64-bit hashes that together identify a record. ``ids`` are compared as ids, ``texts`` without surrounding blanks,
    ``others`` as they are. Each null is marked, as Spark's hash functions skip nulls."""
    canon = [F.coalesce(clean_id(c), F.lit("\x00")) for c in ids] + [F.coalesce(clean_text(c), F.lit("\x00")) for c in texts]
    canon += [F.coalesce(c.cast("string"), F.lit("\x00")) for c in others]
    return [F.xxhash64(F.lit(17), *canon), F.xxhash64(F.lit(-71), *canon)]
