"""Queries for similar vectors, the varied subset and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .packing import pack, with_token_counts
from .similar import most_similar
from .varied import choose_varied
from .vectors import usable_vectors

BUDGETS = (20, 100, 500)
CAPACITY = 2_048


def segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_vectors(table(spark, sf_dir, "signatures"), "segment_id", "app_encoder", "app_mean", "indexed_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments of which at least one is among the five most similar of the other."""
    near = most_similar(segment_vectors(spark, sf_dir), 5)
    return near.select(F.least("id", "neighbour").alias("segment_a"), F.greatest("id", "neighbour").alias("segment_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar segments of every segment."""
    near = most_similar(segment_vectors(spark, sf_dir), 5)
    return near.select(F.col("id").alias("segment_id"), F.col("neighbour").alias("neighbour_id"), "similarity")


def p7_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks in order with their gains for every budget; a smaller budget's picks begin a larger one's."""
    picks = choose_varied(segment_vectors(spark, sf_dir), max(BUDGETS))
    budgets = F.explode(F.array(*[F.lit(b) for b in BUDGETS])).alias("budget")
    return picks.select(budgets, "rank", F.col("id").alias("segment_id"), "gain", "coverage").filter("rank <= budget")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a text longer than a container, with its container."""
    docs = table(spark, sf_dir, "documents")
    counted = with_token_counts(docs.select("doc_id", "text"), "text").select("doc_id", "n_tokens")
    placed = pack(counted, "doc_id", "n_tokens", CAPACITY, docs.count())
    return placed.select("container_id", F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("length").alias("n_tokens"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces and unused room of the whole packing."""
    return p8_containers(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn(
        "unused", CAPACITY - F.col("n_tokens"))


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p7_select": p7_select, "p8_containers": p8_containers, "p8_fill": p8_fill}
_P2 = """
WITH latest AS (SELECT segment_id, arg_max(app_encoder, indexed_at) AS app_encoder, CAST(arg_max(app_mean, indexed_at) AS DOUBLE[]) AS v
  FROM signatures WHERE app_mean IS NOT NULL AND list_max(list_transform(app_mean, lambda x: abs(x))) > 0 GROUP BY segment_id),
normed AS (SELECT segment_id, app_encoder, v, len(v) AS d, sqrt(list_dot_product(v, v)) AS n FROM latest),
sims AS (SELECT a.segment_id, b.segment_id AS neighbour_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS similarity
  FROM normed a JOIN normed b ON a.app_encoder = b.app_encoder AND a.d = b.d AND a.segment_id <> b.segment_id),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY similarity DESC, neighbour_id) <= 5)
"""
ORACLES = {
    "p2_found": _P2 + "SELECT DISTINCT least(segment_id, neighbour_id) AS segment_a, greatest(segment_id, neighbour_id) AS segment_b FROM top",
    "p2_neighbours": _P2 + "SELECT segment_id, neighbour_id, similarity FROM top",
}
