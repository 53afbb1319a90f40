"""Query p9: documents that are template residue instead of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import table

from .residue import residue


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"))


def p9_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each step of the operator finds."""
    return residue(table(spark, sf_dir, "documents")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p9_found": p9_found, "p9_reasons": p9_reasons, "p9_reason_counts": p9_reason_counts}
SQL: dict[str, str] = {}
