"""Strict casts of text and of wider numbers: what does not fit is no value, never truncated. JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BLANKS, go_duration_ns

#: Texts that count as booleans (fixed values).
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")
#: Widths of integer targets: Spark type and bounds.
INTEGERS = {
    "int8": ("tinyint", -(2**7), 2**7 - 1), "int16": ("smallint", -(2**15), 2**15 - 1), "int32": ("int", -(2**31), 2**31 - 1), "int64": ("bigint", -(2**63), 2**63 - 1),
    "uint8": ("smallint", 0, 2**8 - 1), "uint16": ("int", 0, 2**16 - 1), "uint32": ("bigint", 0, 2**32 - 1), "uint64": ("decimal(20,0)", 0, 2**64 - 1),
}
INTEGERS |= {"int": INTEGERS["int64"], "uint": INTEGERS["uint64"]}


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def to_bool(c: Column) -> Column:
    t = _trim(c)
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def to_integer(c: Column, target: str) -> Column:
    """Decimal digits with an optional sign (none but for signed targets), within the target's width."""
    kind, low, high = INTEGERS[target]
    t = _trim(c)
    digits = F.when(t.rlike(r"^[+-]?[0-9]{1,37}\z" if low < 0 else r"^[0-9]{1,37}\z"), t.try_cast("decimal(38,0)"))
    return F.when(digits.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), digits).try_cast(kind)


def to_float(c: Column, bits: int = 64) -> Column:
    """Decimal and exponent notation; a number beyond the width is no value, infinities written out are kept."""
    t = _trim(c)
    named = F.lower(F.regexp_replace(t, r"^\+", "")).isin("inf", "infinity", "-inf", "-infinity", "nan")
    number = F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
    top = 3.4028235677973366e38 if bits == 32 else 1.7976931348623157e308
    special = F.when(F.lower(t).startswith("-"), F.lit(float("-inf"))).when(F.lower(t) == "nan", F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    value = F.when(named, special).when(F.abs(number) <= top, number)
    return value.cast("float") if bits == 32 else value


def to_list(c: Column, target: str = "string") -> Column:
    """Comma-separated text: trimmed parts, empty ones dropped; one part that does not fit makes the whole list no value."""
    parts = F.filter(F.transform(F.split(c, ","), _trim), lambda p: p != "")
    if target == "string":
        return parts
    cast = F.transform(parts, lambda p: coerce(p, target))
    return F.when(~F.exists(cast, lambda x: x.isNull()), cast)


def coerce(c: Column, target: str) -> Column:
    """``c`` (text) as ``target``: string, bytes, bool, (u)int{8,16,32,64}, float32, float64, duration, time, or list:<target>."""
    if target == "string":
        return c
    if target == "bytes":
        return F.encode(c, "UTF-8")
    if target == "bool":
        return to_bool(c)
    if target in INTEGERS:
        return to_integer(c, target)
    if target in ("float32", "float64"):
        return to_float(c, int(target[-2:]))
    if target == "duration":
        return go_duration_ns(c)
    if target == "time":
        return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z"), c.try_cast("timestamp"))
    if target.startswith("list:"):
        return to_list(c, target[5:])
    raise ValueError(f"no such target: {target}")


def narrow(c: Column, target: str) -> Column:
    """A number as an integer type: whole and within the width, or no value (a plain cast would cut off)."""
    kind, low, high = INTEGERS[target]
    x = c.cast("double")
    whole = x == F.floor(x)
    return F.when(whole & (c >= F.lit(str(low)).cast("decimal(38,0)").cast("double")) & (c < F.lit(float(high) + (1 if high < 2**53 else 0))), c).try_cast(kind)


def text_of(m: Column) -> Column:
    """The text of a string map: its first value among the customary keys (fixed values)."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("content", "text", "output", "result", "message")])


def truthy(text: Column) -> Column:
    """Null, the empty text, ``false``, ``no`` and ``0`` (as written) are false; everything else is true."""
    return ~F.coalesce(text, F.lit("")).isin("", "false", "no", "0")


def truthy_map(m: Column) -> Column:
    """A map is true if any of its values is."""
    return F.coalesce(F.exists(F.map_values(m), truthy), F.lit(False))


def coerce_fields(m: Column, fields: dict[str, str]) -> Column:
    """A struct from a map of texts: known keys are coerced to their targets, unknown ones ignored, missing ones null; one value that
    does not fit makes the whole struct no value."""
    texts = {k: F.try_element_at(m, F.lit(k)) for k in fields}
    made = {k: coerce(texts[k], t) for k, t in fields.items()}
    bad = F.lit(False)
    for k in fields:
        bad = bad | (texts[k].isNotNull() & made[k].isNull())
    return F.when(~bad, F.struct(*[v.alias(k) for k, v in made.items()]))
