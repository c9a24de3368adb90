"""Queries for leaked test items and for abusive language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .abuse import CASE, with_abuse_score
from .leakage import leaked


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items they contain and how many of an item's words they follow."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that contain it, leaked or not."""
    counts = p9_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    return items.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_abuse_score(docs, "text").select("doc_id", "source", "abuse_score", "abusive_clauses")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter(F.col("abuse_score") >= CASE).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and rate per source; documents without a source are one group."""
    return p10_scores(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count(F.when(F.col("abuse_score") >= CASE, 1)).alias("n_cases")
    ).withColumn("rate", F.round(F.col("n_cases") / F.col("n_documents"), 6))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
ORACLES: dict[str, str] = {}
