"""Queries for spans shared between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .shared_spans import shared_spans

LEAST = 12


def hash_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment with its hash stream; of repeated segments the latest one that has hashes."""
    t = table(spark, sf_dir, "signatures").filter(F.col("phash").isNotNull() & F.col("segment_id").isNotNull())
    body = F.struct("video_id", "phash", "phash_ts")
    return t.groupBy("segment_id").agg(F.max_by(body, "indexed_at").alias("b")).select("segment_id", "b.*")


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    streams = hash_streams(spark, sf_dir)
    return streams, shared_spans(streams, "segment_id", "video_id", "phash", LEAST)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments of different recordings that share at least 12 consecutive hashes."""
    _, spans = _spans(spark, sf_dir)
    return spans.filter(F.col("b").isNotNull()).select(F.col("a").alias("segment_a"), F.col("b").alias("segment_b")).distinct()


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sharing segment: hashes, seconds and fraction also found in another recording.

    A hash lasts until the next one; the last one as long as the stream's mean step.
    """
    streams, spans = _spans(spark, sf_dir)
    places = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("end") - 1))))
    covered = spans.filter(F.col("b").isNull()).groupBy(F.col("a").alias("segment_id")).agg(places.alias("at"))
    ts, n = F.col("phash_ts"), F.size("phash")
    step = F.when(n > 1, (F.element_at(ts, -1) - F.element_at(ts, 1)) / (n - 1)).otherwise(0.0)
    lasts = F.transform("at", lambda i: F.when(i + 1 < n, F.get(ts, i + 1) - F.get(ts, i)).otherwise(step))
    seconds = F.aggregate(F.array_sort(lasts), F.lit(0.0), lambda s, x: s + x)
    return covered.join(streams, "segment_id").select("segment_id", F.size("at").alias("shared_hashes"), F.round(seconds, 6).alias("shared_seconds"), F.round(F.size("at") / n, 6).alias("shared_fraction"))


_STREAMS = """
WITH latest AS (SELECT segment_id, arg_max(video_id, indexed_at) AS video_id, arg_max(phash, indexed_at) AS h, arg_max(phash_ts, indexed_at) AS ts
  FROM signatures WHERE phash IS NOT NULL GROUP BY segment_id),
grams AS (SELECT segment_id, video_id, i, array_to_string(h[i:i + 11], ',') AS g FROM (SELECT *, unnest(range(1, len(h) - 10)) AS i FROM latest WHERE len(h) >= 12))
"""
QUERIES = {"p5_found": p5_found, "p5_shared": p5_shared}
ORACLES = {
    "p5_found": _STREAMS + "SELECT DISTINCT a.segment_id AS segment_a, b.segment_id AS segment_b FROM grams a JOIN grams b ON a.g = b.g AND a.video_id <> b.video_id AND a.segment_id < b.segment_id",
    "p5_shared": _STREAMS + """, hit AS (SELECT DISTINCT a.segment_id, a.i FROM grams a JOIN grams b ON a.g = b.g AND a.video_id <> b.video_id),
at AS (SELECT DISTINCT segment_id, unnest(range(i, i + 12)) AS p FROM hit)
SELECT p.segment_id, CAST(count(*) AS INTEGER) AS shared_hashes,
  round(sum(CASE WHEN p < len(l.ts) THEN l.ts[p + 1] - l.ts[p] ELSE (l.ts[len(l.ts)] - l.ts[1]) / (len(l.ts) - 1) END), 6) AS shared_seconds,
  round(count(*) / len(any_value(l.h)), 6) AS shared_fraction
FROM at p JOIN latest l USING (segment_id) GROUP BY p.segment_id""".replace("at AS (", "spots AS (").replace("FROM at p", "FROM spots p"),
}
