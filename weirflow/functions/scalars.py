"""Pure functions of columns: backoffs, digests, keys, labels, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX = 2**63 - 1
MIN = -(2**63)


def _long(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _saturated(x: Column) -> Column:
    """A decimal as a 64-bit number, the nearest one if it does not fit."""
    return F.when(x > F.lit(str(MAX)).cast("decimal(38,0)"), F.lit(MAX)).when(x < F.lit(str(MIN)).cast("decimal(38,0)"), F.lit(MIN)).otherwise(x.try_cast("bigint"))


def exponential_backoff(base: int | Column, top: int | Column, attempt: Column) -> Column:
    """base * 2^(attempt - 1), at most ``top``; attempts up to 1 give base; negative bounds count as 0, base is capped at top."""
    top = F.greatest(_long(top), F.lit(0))
    base = F.least(F.greatest(_long(base), F.lit(0)), top)
    doublings = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(63)).cast("int")
    grown = _wide(base) * F.element_at(F.array(*[F.lit(str(2**k)).cast("decimal(20,0)") for k in range(64)]), doublings + 1)
    return F.when(grown >= _wide(top), top).otherwise(_saturated(grown))


def jittered_backoff(base: int | Column, top: int | Column, attempt: Column, u: Column) -> Column:
    """The exponential backoff spread by +-30 % with u in [0, 1), kept within [base, top]."""
    spread = exponential_backoff(base, top, attempt) * (1 + 0.3 * (2 * u - 1))
    return F.least(F.greatest(F.floor(spread).cast("bigint"), F.least(F.greatest(_long(base), F.lit(0)), F.greatest(_long(top), F.lit(0)))), F.greatest(_long(top), F.lit(0)))


def linear_backoff(step: int | Column, attempt: Column) -> Column:
    return _saturated(_wide(_long(step)) * attempt.cast("decimal(20,0)"))


def adaptive_timeout(initial: int | Column, failures: Column) -> Column:
    """initial * (1 + failures / 10) in whole numbers; at most the largest 64-bit number; no failures: initial; initial <= 0: 0."""
    start, n = _long(initial), F.greatest(failures.cast("bigint"), F.lit(0))
    whole = _wide(start) * (1 + F.floor(n / 10)).cast("decimal(19,0)")
    part = F.floor(start / 10).cast("bigint") * (n % 10) + F.floor((start % 10) * (n % 10) / 10).cast("bigint")
    return F.when(start <= 0, F.lit(0).cast("bigint")).otherwise(_saturated(whole + _wide(part)))


def digest(c: Column) -> Column:
    """SHA-256 in hex, of text or bytes."""
    return F.sha2(c, 256)


def payload_hash(c: Column, is_text: bool = True) -> Column:
    """Digest of a payload: text and bytes raw, numbers as decimal text, structs as JSON; null has a digest of its own."""
    return F.sha2(F.coalesce(c if is_text else F.to_json(c), F.lit("\x00nil\x00")), 256)


def length_prefixed(*parts: Column) -> Column:
    """Bytes of the parts, each behind its length in 8 bytes: no two lists of parts give the same bytes."""
    return F.concat(*[F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "UTF-8")) for p in parts])


def scoped_key(prefix: str, *parts: Column) -> Column:
    """A storage key: a prefix and the digest of the length-prefixed parts."""
    return F.concat(F.lit(prefix), F.sha2(length_prefixed(*parts), 256))


def scope_hash(single: Sequence[Column], lists: Sequence[Column]) -> Column:
    """Digest of single values and of lists whose order and repetitions do not matter."""
    flat = [F.coalesce(F.array_join(F.transform(F.array_sort(F.array_distinct(x)), lambda v: F.concat(F.lpad(F.hex(F.octet_length(v)), 16, "0"), v)), ""), F.lit("")) for x in lists]
    return F.sha2(length_prefixed(*single, *flat), 256)


def valid_key(c: Column) -> Column:
    """1 to 255 printable ASCII bytes without blanks."""
    return F.coalesce(c.rlike(r"\A[\x21-\x7e]{1,255}\z"), F.lit(False))


def fnv1a64(c: Column) -> Column:
    """FNV-1a hash (64 bits, unsigned, as decimal(20,0)) of a text's bytes."""
    two64 = F.lit(str(2**64)).cast("decimal(38,0)")
    pairs = F.hex(F.encode(c, "UTF-8"))
    places = F.when(F.length(pairs) > 0, F.sequence(F.lit(1), F.length(pairs), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substr(pairs, i, F.lit(2)), 16, 10).cast("int")
        low = (h % 256).cast("int")
        mixed = h - low.cast("decimal(38,0)") + low.bitwiseXOR(byte).cast("decimal(38,0)")
        return ((mixed.cast("decimal(20,0)") * F.lit(1099511628211).cast("decimal(13,0)")) % two64).cast("decimal(38,0)")

    return F.aggregate(places, F.lit("14695981039346656037").cast("decimal(38,0)"), step).cast("decimal(20,0)")


def hash_slot(c: Column, n: int) -> Column:
    return (fnv1a64(c) % n).cast("int")


def power_of_two_ceiling(c: Column, most: int = 1 << 62) -> Column:
    """The least power of two that is at least c, null beyond ``most``; c <= 1 gives 1."""
    bits = F.when(c <= 1, F.lit(0)).otherwise(F.length(F.bin(c - 1)))
    return F.when(c <= most, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.when(c <= most, bits).otherwise(F.lit(0))))


def label_escaped(c: Column) -> Column:
    """Label of the Prometheus text format."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def mermaid_id(c: Column) -> Column:
    """Node id of a Mermaid graph: dots, hyphens and blanks become ``_``, round brackets go."""
    return F.concat(F.lit("id_"), F.translate(c, ".- ()", "___"))


def mermaid_label(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("#quot;"))


def output_key(c: Column, inner: bool = False) -> Column:
    return F.concat(F.lit("tasks."), c, F.lit(".output.inner_state" if inner else ".output"))


def journal_namespace(execution_id: Column, generation: Column) -> Column:
    """Id of an execution's journal; successors have one of their own."""
    return F.when(generation > 0, F.concat(execution_id, F.lit("\x00generation:"), generation.cast("string"))).otherwise(execution_id)


def redacted(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("[redacted]"))


def has_permission(have: Column, wanted: str) -> Column:
    return F.coalesce(F.arrays_overlap(have, F.array(F.lit(wanted), F.lit("*"))), F.lit(False))


#: The role that has every feature (a fixed value).
SYSTEM_ADMIN = "system_admin"


def has_features(have: Column, wanted: Sequence[str], every: bool = True, role: Column | None = None, roles: Column | None = None) -> Column:
    """All (or any) of the features; ``all`` and ``*`` stand for every one, and so does the role ``system_admin``."""
    each = [F.array_contains(have, w) for w in wanted]
    joined = each[0]
    for e in each[1:]:
        joined = (joined & e) if every else (joined | e)
    out = F.coalesce(F.arrays_overlap(have, F.array(F.lit("all"), F.lit("*"))) | joined, F.lit(False))
    if role is not None:
        out = out | F.coalesce(role == SYSTEM_ADMIN, F.lit(False))
    if roles is not None:
        out = out | F.coalesce(F.array_contains(roles, SYSTEM_ADMIN), F.lit(False))
    return out


#: Share of the limits from which work of a priority is rejected (fixed values).
SHED_AT = {"low": 0.7, "normal": 0.85, "critical": 1.0}


def shed(cpu: Column, goroutines: Column, priority: Column, max_cpu: float, max_goroutines: int) -> Column:
    """Whether load shedding rejects: a limit of 0 is none; the limit on goroutines is cut to a whole number."""
    out = None
    for name, share in SHED_AT.items():
        over = F.lit(False)
        if max_cpu > 0:
            over = over | (cpu > max_cpu * share)
        if max_goroutines > 0:
            over = over | (goroutines > int(max_goroutines * share))
        out = F.when(priority == name, over) if out is None else out.when(priority == name, over)
    return F.coalesce(out, F.lit(False))


def matches_node(node: Column, scope: Column, active: str, default: str = "", untagged_everywhere: bool = False) -> Column:
    """Whether an action runs on the active node: no active node - all do; system scope - always; its own node; no node - where allowed."""
    if not active:
        return F.lit(True)
    untagged = F.coalesce(node, F.lit("")) == ""
    here = untagged & F.lit(untagged_everywhere or (default != "" and default == active))
    return F.coalesce(scope == "system", F.lit(False)) | F.coalesce(node == active, F.lit(False)) | here


def hedge(primary: Column, secondary: Column, delay: int, failed: Column | None = None) -> Column:
    """Time to a result if a second attempt starts after ``delay`` (0: none) or at the first one's failure."""
    if delay <= 0:
        return primary
    second = F.lit(delay) + secondary
    if failed is not None:
        return F.when(failed, F.least(primary, F.lit(delay)) + secondary).otherwise(F.least(primary, second))
    return F.least(primary, second)
