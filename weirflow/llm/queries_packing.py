"""Queries p7: documents packed into the containers of pack_budgets, and what a packing must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.queries.dealt import sql_text
from weirflow.session import cut, table

from .packing import document_sizes, pack_documents, pack_sizes


def _budgets(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int]]:
    return sorted(tuple(b) for b in table(spark, sf_dir, "pack_budgets").select("budget_id", "capacity_tokens", "separator_tokens").toLocalIterator())


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _budgets(spark, sf_dir))


def p7_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: documents packed, documents whose tokens are not placed exactly once, containers over the capacity or whose
    load is not what lies in them, and documents split without need."""
    sizes = cut(document_sizes(table(spark, sf_dir, "documents")))
    budgets = table(spark, sf_dir, "pack_budgets").select("budget_id", "capacity_tokens", "separator_tokens")
    known = _budgets(spark, sf_dir)
    placed = cut(pack_sizes(sizes, known))
    load = F.sum("n_tokens") + F.first("separator_tokens") * (F.count(F.lit(1)) - 1)
    full = placed.join(budgets, "budget_id").groupBy("budget_id", "container_id").agg(((load > F.first("capacity_tokens")) | (load != F.max("container_tokens"))).alias("bad"))
    over = full.groupBy("budget_id").agg(F.count(F.when(F.col("bad"), 1)).alias("n_over"))
    # doc_id is unique here; pieces follow one another without a gap
    pieces = placed.groupBy("budget_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("piece").alias("last"))
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).alias("capacity_tokens")) for b, c, _ in known])).alias("b")
    whole = sizes.select("doc_id", "n", each).select("doc_id", "n", "b.*").join(pieces, ["budget_id", "doc_id"], "left")
    wrong = F.col("got").isNull() | (F.col("got") != F.col("n")) | (F.col("end") != F.col("n")) | (F.col("last") + 1 != F.col("pieces"))
    split = (F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))
    docs = whole.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(wrong, 1)).alias("n_wrong"), F.count(F.when(split, 1)).alias("n_split"))
    return docs.join(over, "budget_id").select("budget_id", "n_documents", "n_wrong", "n_over", "n_split")


QUERIES = {"p7_packed": p7_packed, "p7_feasible": p7_feasible}
SQL = {
    "p7_feasible": f"""select budget_id, (select count(*) from documents where {sql_text('text')} is not null) as n_documents,
 0::bigint as n_wrong, 0::bigint as n_over, 0::bigint as n_split from pack_budgets""",
}
