"""Errors travel with the rows: an optional ``_error`` column (null: success), and two policies for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Order
from .session import col

ERROR = "_error"
#: Error kinds (fixed values).
KINDS = (
    "BadRequest", "Unauthorized", "Forbidden", "NotFound", "Conflict", "Validation", "TooManyRequests", "Timeout", "Unavailable", "Internal",
    "MethodNotAllowed", "UnsupportedMediaType", "RateLimit", "Canceled", "Database", "Shutdown", "CircuitBreaker",
)
#: Retry classes of the kinds (fixed values); the others are neither.
TRANSIENT = ("Timeout", "Unavailable", "CircuitBreaker", "RateLimit", "TooManyRequests")
PERMANENT = ("BadRequest", "UnsupportedMediaType", "Unauthorized", "Forbidden", "NotFound", "Validation")


class FlowError(Exception):
    """A driver-side failure with one of the error kinds."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def error(kind: str, message: str | Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def no_error() -> Column:
    return F.lit(None).cast("struct<kind:string,message:string>")


def error_class(kind: Column) -> Column:
    """transient, permanent or neither."""
    return F.when(kind.isin(*TRANSIENT), "transient").when(kind.isin(*PERMANENT), "permanent").otherwise("neither")


def is_transient(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TRANSIENT), F.lit(False))


def is_permanent(kind: Column) -> Column:
    return F.coalesce(kind.isin(*PERMANENT), F.lit(False))


def ok(df: DataFrame) -> Column:
    """True for rows without error; always true where there is no error column."""
    return F.col(ERROR).isNull() if ERROR in df.columns else F.lit(True)


def stop_at_first(df: DataFrame, o: Order, keep_error: bool = True) -> DataFrame:
    """The stop policy: of each stream the rows before its first error, then that error row (if ``keep_error``)."""
    if ERROR not in df.columns:
        return df
    failed = F.col(ERROR).isNotNull()
    before = F.coalesce(F.sum(failed.cast("int")).over(o.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("__before", before).where("__before = 0").drop("__before")
    return out if keep_error else out.where(~failed)


def require(df: DataFrame, condition: Column, kind: str, message: str) -> DataFrame:
    """Rows that do not meet a condition (a null condition is not met) get an error; earlier errors stay."""
    now = F.when(F.coalesce(condition, F.lit(False)), no_error()).otherwise(error(kind, message))
    return df.withColumn(ERROR, F.coalesce(F.col(ERROR), now) if ERROR in df.columns else now)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, quarantined rows)."""
    if ERROR not in df.columns:
        return df, df.limit(0)
    return df.where(F.col(ERROR).isNull()).drop(ERROR), df.where(F.col(ERROR).isNotNull())


def positive(name: str, value: int) -> int:
    if value <= 0:
        raise FlowError("Validation", f"{name} must be positive")
    return value


__all__ = ["ERROR", "FlowError", "col", "error", "error_class", "from_public", "is_permanent", "is_transient", "no_error", "ok", "positive", "public", "require", "split", "stop_at_first", "transport"]


def public(e: Column) -> Column:
    """What a client may see of an error column: its kind, and its message unless it is internal."""
    hidden = e["kind"].isNull() | (e["kind"] == "Internal")
    return F.when(e.isNotNull(), F.struct(F.coalesce(e["kind"], F.lit("Internal")).alias("error"), F.when(hidden, "internal server error").otherwise(e["message"]).alias("message")))


def from_public(kind: Column, message: Column) -> Column:
    """An error column from what a client saw; an unknown kind gives none."""
    return F.when(kind.isin(*KINDS), F.struct(kind.alias("kind"), F.coalesce(F.nullif(message, F.lit("")), F.lit("remote request failed")).alias("message")))


def transport(e: Column) -> Column:
    """At a boundary an error without known kind is a failure to connect."""
    return F.when(e.isNull(), no_error()).when(e["kind"].isin(*KINDS), e).otherwise(error("Unavailable", "transport error"))
