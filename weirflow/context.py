"""Who a row is from: one struct column of request, trace, user, tenant and grants, and predicates over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import has_features, has_permission, scope_hash

#: Fields of the context column (fixed values).
TEXTS = ("request_id", "idempotency_key", "trace_id", "span_id", "endpoint", "user_id", "tenant_id", "role", "client_ip")
LISTS = ("roles", "permissions", "features")
SCHEMA = "struct<" + ", ".join([f"{t}:string" for t in TEXTS] + [f"{x}:array<string>" for x in LISTS]) + ">"


def context(values: Mapping[str, Column]) -> Column:
    """The context from columns by field name; what is missing is null."""
    unknown = set(values) - {*TEXTS, *LISTS}
    if unknown:
        raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
    texts = [values.get(t, F.lit(None)).cast("string").alias(t) for t in TEXTS]
    return F.struct(*texts, *[values.get(x, F.lit(None)).cast("array<string>").alias(x) for x in LISTS])


def authenticated(c: Column) -> Column:
    return F.coalesce(c["user_id"] != "", F.lit(False))


def of_tenant(c: Column) -> Column:
    return F.coalesce(c["tenant_id"] != "", F.lit(False))


def has_role(c: Column, *roles: str) -> Column:
    """Any of the roles, as the role or among the roles."""
    return F.coalesce(c["role"].isin(*roles), F.lit(False)) | F.coalesce(F.arrays_overlap(c["roles"], F.array(*map(F.lit, roles))), F.lit(False))


def may(c: Column, permission: str) -> Column:
    return has_permission(c["permissions"], permission)


def features(c: Column, wanted: Sequence[str], every: bool = True) -> Column:
    return has_features(c["features"], wanted, every, c["role"], c["roles"])


def scope(c: Column) -> Column:
    """Digest of what a result may depend on: tenant, user and grants."""
    return scope_hash([F.coalesce(c["tenant_id"], F.lit("")), F.coalesce(c["user_id"], F.lit(""))], [c[x] for x in LISTS])


def session_values(spark: SparkSession, values: Mapping[str, str]) -> None:
    """Values of the whole session, as local properties of its jobs."""
    for k, v in values.items():
        spark.sparkContext.setLocalProperty(f"weirflow.{k}", v)


def with_session_values(df: DataFrame, *names: str) -> DataFrame:
    """The session's values as columns."""
    sc = df.sparkSession.sparkContext
    return df.withColumns({n: F.lit(sc.getLocalProperty(f"weirflow.{n}")) for n in names})
