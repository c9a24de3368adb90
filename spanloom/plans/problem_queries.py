"""Queries of the general problems on the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals, to_millis
from ..runtime import table

#: A longer hole means the camera was off.
CAMERA_OFF_MS = 3_600_000


def caption_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "caption_segments").filter(F.col("error").isNull())
    return t.select(F.lit("caption_segments").alias("source_table"), "video_id", to_millis(F.col("t0")).alias("s_ms"), to_millis(F.col("t1")).alias("e_ms"))


def cadence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "cadence_segments")
    return t.select(F.lit("cadence_segments").alias("source_table"), "video_id", to_millis(F.col("t0")).alias("s_ms"), to_millis(F.col("t1")).alias("e_ms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of every video in both segment tables."""
    spans = caption_spans(spark, sf_dir).unionByName(cadence_spans(spark, sf_dir))
    total = table(spark, sf_dir, "caption_segments").count() + table(spark, sf_dir, "cadence_segments").count()
    return merge_intervals(spans, ["source_table", "video_id"], total, CAMERA_OFF_MS)


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered time, uncovered time and number of periods per video and table."""
    r = p4_found(spark, sf_dir)
    ms = F.col("end_ms") - F.col("start_ms")
    return r.groupBy("source_table", "video_id").agg(
        F.count(F.when(F.col("kind") == "period", 1)).alias("n_periods"),
        F.count(F.when(F.col("kind") == "gap", 1)).alias("n_gaps"),
        F.sum(F.when(F.col("kind") == "period", ms).otherwise(0)).alias("covered_ms"),
        F.sum(F.when(F.col("kind") == "gap", ms).otherwise(0)).alias("gap_ms"),
    )


_P4 = """
WITH spans AS (
  SELECT DISTINCT 'caption_segments' AS source_table, video_id, CAST(round(t0 * 1000) AS BIGINT) AS s, CAST(round(t1 * 1000) AS BIGINT) AS e
  FROM caption_segments WHERE error IS NULL AND t0 IS NOT NULL AND t1 IS NOT NULL
  UNION
  SELECT 'cadence_segments', video_id, CAST(round(t0 * 1000) AS BIGINT), CAST(round(t1 * 1000) AS BIGINT)
  FROM cadence_segments WHERE t0 IS NOT NULL AND t1 IS NOT NULL
), flagged AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source_table, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM spans WHERE e > s
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY source_table, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged
), periods AS (
  SELECT source_table, video_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY source_table, video_id, island
), gaps AS (
  SELECT source_table, video_id, lag(e) OVER (PARTITION BY source_table, video_id ORDER BY s) AS s, s AS e FROM periods
), found AS (
  SELECT source_table, video_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
  UNION ALL
  SELECT source_table, video_id, 'gap', s, e FROM gaps WHERE s IS NOT NULL AND e - s <= 3600000
)
"""

QUERIES = {"p4_found": p4_found, "p4_coverage": p4_coverage}
ORACLES = {
    "p4_found": _P4 + "SELECT source_table, video_id, kind, start_ms, end_ms FROM found",
    "p4_coverage": _P4 + """
SELECT source_table, video_id, CAST(count(*) FILTER (WHERE kind = 'period') AS BIGINT) AS n_periods,
  CAST(count(*) FILTER (WHERE kind = 'gap') AS BIGINT) AS n_gaps,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE kind = 'period'), 0) AS BIGINT) AS covered_ms,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) AS gap_ms
FROM found GROUP BY source_table, video_id""",
}
