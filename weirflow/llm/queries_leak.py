"""Query p8: documents that hold passages of eval_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.session import table

from .leak import leaked


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
