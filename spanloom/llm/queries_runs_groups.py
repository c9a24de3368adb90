"""Queries for percentiles, linked groups and runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import row_identity
from ..operators.intervals import to_millis
from ..runtime import table
from . import quantiles as Q
from .components import connected_groups
from .runs import collapse_runs, fit_namers, keyed

#: The nine readings of verdicts.raw.
METRICS = ("env_cos", "env_chamfer", "env_bhat_sim", "task_cos", "task_dtw_sim", "rhythm_cos", "period_agree", "env_raw", "task_raw")


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts of every metric per stratum and scored day; an exact repeat of a verdict counts once."""
    v = table(spark, sf_dir, "verdicts")
    readings = [F.when(F.abs(F.col(f"raw.{m}")) <= 1, Q.bucket_key(F.col(f"raw.{m}"))).alias(m) for m in METRICS]
    once = v.select(*row_identity(v), "stratum", F.to_date("scored_at").alias("day"), *readings).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bucket")) for m in METRICS])).alias("p")
    return Q.sketch(once.select("stratum", "day", pairs).select("stratum", "day", "p.*"), ["stratum", "day", "metric"])


def p1_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile grids per stratum, day and metric, and of all days together from the daily sketches.

    ``scope`` tells the two apart; ``relative_error`` is the stated bound.
    """
    daily = daily_sketches(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit("day").alias("scope"), F.col("day").alias("d")), F.struct(F.lit("all").alias("scope"), F.lit(None).cast("date").alias("d"))))
    merged = Q.merge(daily.withColumn("to", both).select("stratum", "metric", "bucket", "n", "to.scope", F.col("to.d").alias("day")), ["scope", "stratum", "day", "metric"])
    out = Q.percentiles(merged, ["scope", "stratum", "day", "metric"])
    return out.select("scope", "stratum", F.col("day").cast("string").alias("day"), "metric", F.col("n_values").alias("n_pairs"),
                      F.transform("quantiles", lambda q: F.round(q, 9) + F.lit(0.0)).alias("quantiles"), F.lit(Q.ALPHA).alias("relative_error"))


def _p1_sql() -> str:
    lg, off, g = math.log(Q.gamma()), Q.offset(), Q.gamma()
    key = lambda m: f"CASE WHEN abs(raw.{m}) <= 1 AND NOT isnan(raw.{m}) THEN CASE WHEN raw.{m} = 0 THEN 0 ELSE CAST(sign(raw.{m}) AS BIGINT) * (CAST(ceil(ln(abs(raw.{m})) / {lg!r}) AS BIGINT) + {off}) END END"
    union = " UNION ALL ".join(f"SELECT stratum, day, '{m}' AS metric, {key(m)} AS bucket FROM once" for m in METRICS)
    return f"""
WITH once AS (SELECT stratum, CAST(CAST(scored_at AS DATE) AS VARCHAR) AS day, raw FROM (SELECT DISTINCT * FROM verdicts)),
keyed AS ({union}),
scoped AS (SELECT 'day' AS scope, stratum, day, metric, bucket FROM keyed WHERE bucket IS NOT NULL
         UNION ALL SELECT 'all', stratum, NULL, metric, bucket FROM keyed WHERE bucket IS NOT NULL),
counts AS (SELECT scope, stratum, day, metric, bucket, count(*) AS n FROM scoped GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY scope, stratum, day, metric ORDER BY bucket) AS c,
             sum(n) OVER (PARTITION BY scope, stratum, day, metric) AS total,
             CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * exp((abs(bucket) - {off}) * {lg!r}) * {2 / (g + 1)!r} END AS v FROM counts),
grid AS (SELECT unnest(range(201)) AS j),
spots AS (SELECT scope, stratum, day, metric, total, j, CAST(floor(j * (total - 1) / 200.0) AS BIGINT) AS lo,
         CAST(ceil(j * (total - 1) / 200.0) AS BIGINT) AS hi, ((j * (total - 1)) % 200) / 200.0 AS f
       FROM (SELECT DISTINCT scope, stratum, day, metric, total FROM ranked), grid),
points AS (SELECT a.scope, a.stratum, a.day, a.metric, a.total, a.j,
    sum(CASE WHEN a.lo BETWEEN r.c - r.n AND r.c - 1 THEN (1 - a.f) * r.v ELSE 0 END
      + CASE WHEN a.hi BETWEEN r.c - r.n AND r.c - 1 THEN a.f * r.v ELSE 0 END) AS q
  FROM spots a JOIN ranked r ON a.scope = r.scope AND a.metric = r.metric AND a.stratum IS NOT DISTINCT FROM r.stratum AND a.day IS NOT DISTINCT FROM r.day
  GROUP BY ALL)
SELECT scope, stratum, day, metric, CAST(total AS BIGINT) AS n_pairs, list(round(q, 9) + 0.0 ORDER BY j) AS quantiles, CAST({Q.ALPHA} AS DOUBLE) AS relative_error
FROM points GROUP BY scope, stratum, day, metric, total"""


def clean_id(raw: Column) -> Column:
    """Trimmed (blanks of any kind), lower-cased, without a trailing /seg_N; empty becomes null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(raw), r"^[\s\u00A0]+|[\s\u00A0]+$", ""), r"/seg_\d+$", "")
    plain = F.regexp_replace(plain, r"[\s\u00A0]+$", "")
    return F.when(plain != "", plain)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per linked recording with the smallest recording of its group."""
    t = table(spark, sf_dir, "task_pairs")
    passing = t.filter(~F.isnan("task_sim") & (F.col("task_sim") >= F.col("task_threshold")))
    return connected_groups(passing.select(clean_id(F.col("video_a")).alias("a"), clean_id(F.col("video_b")).alias("b")), "a", "b", "video_id", "group_id")


_CLEAN = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '/seg_[0-9]+$', ''), '[\s\x{{A0}}]+$', ''), '')"
_P3 = f"""
WITH RECURSIVE ends AS (
  SELECT {_CLEAN.format('video_a')} AS a, {_CLEAN.format('video_b')} AS b FROM task_pairs
  WHERE task_sim IS NOT NULL AND NOT isnan(task_sim) AND task_sim >= task_threshold
), links AS (
  SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b
), reach(v, u) AS (
  SELECT a, b FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.u
)
SELECT v AS video_id, least(min(u), v) AS group_id FROM reach GROUP BY v"""


def named_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Usable caption segments, without and with the canonical key of verb and object."""
    t = table(spark, sf_dir, "caption_segments")
    usable = (
        t.filter(F.col("error").isNull())
        .select("video_id", "segment_id", to_millis(F.col("t0")).alias("s_ms"), to_millis(F.col("t1")).alias("e_ms"), "verb", "object_name", "captioned_at")
        .filter(F.col("s_ms").isNotNull() & (F.col("e_ms") > F.col("s_ms")))
    )
    namers = fit_namers(usable, ["verb", "object_name"])
    return usable, keyed(usable, ["verb", "object_name"], namers)


def p6_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of equally named consecutive segments as one event with its count and duration."""
    raw, keyed = named_events(spark, sf_dir)
    total = table(spark, sf_dir, "caption_segments").count()
    return collapse_runs(keyed, "video_id", "segment_id", "key", "captioned_at", total=total, raw=raw)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more segments."""
    runs = p6_events(spark, sf_dir).filter("n_events >= 2")
    return runs.select("video_id", F.col("first_event").alias("first_segment_id"), F.col("last_event").alias("last_segment_id"))


QUERIES = {"p1_quantiles": p1_quantiles, "p3_found": p3_found, "p6_found": p6_found, "p6_events": p6_events}
ORACLES = {"p1_quantiles": _p1_sql(), "p3_found": _P3}
