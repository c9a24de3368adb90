"""Queries on windows, runs and series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import r6
from ..operators import windows as W
from ..operators.ranks import running_total
from ..runtime import table
from .views import SEG, latest_segments

HANN5 = [float(x) for x in np.hanning(7)[1:-1] / np.hanning(7)[1:-1].sum()]


def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "recordings").select("video_id", "duration_s")
    return W.hop_windows(r, "duration_s", 30.0, 20.0, 10.0).select("video_id", r6(F.col("w0")).alias("t0"), r6(F.col("w1")).alias("t1"), "whole")


def grid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "recordings").select("video_id", "duration_s").filter("duration_s > 5")
    return W.grid_chunks(r, F.lit(5.0), F.col("duration_s"), 25.0).select("video_id", "chunk_no", r6(F.col("c0")).alias("t0"), r6(F.col("c1")).alias("t1"))


def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "phash").filter("phash IS NOT NULL")
    return W.frame_windows(s, "phash", 16, 8).select("segment_id", "start", "window")


def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of segment numbers of a video, allowing for one missing number."""
    t = table(spark, sf_dir, "caption_segments")
    return W.longest_run(t.filter("error IS NULL"), ["video_id"], "segment_id", 2, t.count())


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("bigint").alias("hour"))


def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of consecutive hours in which an event type occurred, three hours or longer."""
    r = W.islands(_hours(spark, sf_dir).select("event_type", "hour"), ["event_type"], "hour", 1)
    return r.filter("n >= 3").select("event_type", "first", "last", "n")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of every event type, hours without events included as missing: one row an hour."""
    h = _hours(spark, sf_dir).groupBy("event_type", "hour").agg(F.sum("value").alias("x"))
    ends = h.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = ends.select("event_type", F.explode(F.sequence("a", "b")).alias("hour"))
    return grid.join(h, ["event_type", "hour"], "left")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("hour", F.coalesce("x", F.lit(0.0)).alias("x")))).alias("s"))
    return s.select("event_type", F.col("s.x").alias("x"))


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fill_gaps(_series(spark, sf_dir), ["event_type"], "hour", "x", 3).select("event_type", "hour", r6(F.col("filled")).alias("filled"))


def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours after which the hourly sum rises through its mean."""
    s = _series(spark, sf_dir).withColumn("x", F.coalesce("x", F.lit(0.0)))
    m = F.broadcast(s.groupBy(F.col("event_type").alias("et")).agg(F.avg("x").alias("m")))  # one row a type
    d = s.join(m, s.event_type == m.et).withColumn("d", F.round(F.col("x") - F.col("m"), 6))
    w = Window.partitionBy("event_type").orderBy("hour")
    return d.withColumn("next", F.lead("d").over(w)).filter("d <= 0 AND next > 0").select("event_type", "hour")


def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = W.running_median(F.col("x"), 5)
    return _arrays(spark, sf_dir).select("event_type", F.posexplode(F.transform(m, lambda v: F.round(v, 6) + F.lit(0.0))).alias("pos", "median"))


def hann_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = W.weighted_window(F.col("x"), HANN5)
    return _arrays(spark, sf_dir).select("event_type", F.posexplode(F.transform(m, lambda v: F.round(v, 6) + F.lit(0.0))).alias("pos", "smooth"))


def suppress_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "phash_ts").filter("phash_ts IS NOT NULL")
    return s.select("segment_id", W.suppress_close(F.col("phash_ts"), 1.75).alias("kept"))


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash times of a segment as boundaries of its cycles, with a period of half a second."""
    s = latest_segments(spark, sf_dir, "phash_ts").filter("phash_ts IS NOT NULL")
    return s.select("segment_id", W.boundary_runs(F.col("phash_ts"), F.lit(0.5)).alias("runs"))


def boundary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boundaries(spark, sf_dir).select("segment_id", F.explode("runs").alias("r")).select("segment_id", F.element_at("r", 1).alias("first"), F.element_at("r", -1).alias("last"), F.size("r").alias("n"))


def cycle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cycle_segments(_boundaries(spark, sf_dir), "runs", 6).select("segment_id", "t0", "t1", r6(F.col("period_s")).alias("period_s"))


def target_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.target_segments(_boundaries(spark, sf_dir), "segment_id", "runs", 10.0)
    return r.select("segment_id", "t0", "t1", "n_cycles", r6(F.col("period_s")).alias("period_s"))


def complement_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a recording without cadence, three seconds or longer."""
    c = table(spark, sf_dir, "cadence_segments").filter("kind = 'cadenced'")
    return W.uncovered(c, table(spark, sf_dir, "recordings"), "video_id", "duration_s", "t0", "t1", 3.0)


def weighted_median_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median period of every video, each segment weighing its strength times its length."""
    c = table(spark, sf_dir, "cadence_segments").filter("kind = 'cadenced' AND period_s > 0 AND strength > 0 AND t1 > t0").select("video_id", "seg_no", "period_s", "strength", "t0", "t1").distinct()
    w = c.groupBy("video_id", "period_s").agg(F.sum(F.round(F.col("strength") * (F.col("t1") - F.col("t0")), 6).cast("decimal(18,6)")).alias("w"))
    r = running_total(w, "period_s", "w", ["video_id"])
    return r.filter("upto * 2 >= whole").groupBy("video_id").agg(F.min("period_s").alias("period_s"))


_HOURS = "hours AS (SELECT event_type, user_id, value, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events)"
_SERIES = f"""{_HOURS}, h AS (SELECT event_type, hour, sum(value) AS x FROM hours GROUP BY ALL),
grid AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY event_type), series AS (SELECT event_type, hour, x FROM grid LEFT JOIN h USING (event_type, hour)),
arrs AS (SELECT event_type, list(coalesce(x, 0.0) ORDER BY hour) AS x FROM series GROUP BY event_type)"""
_RUNS = f"""{SEG}, b AS (SELECT segment_id, unnest(list_sort(phash_ts)) AS t, unnest(range(1, len(phash_ts) + 1)) AS i FROM seg WHERE phash_ts IS NOT NULL),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0.5 * 1.8 THEN 1 ELSE 0 END AS f FROM b WINDOW w AS (PARTITION BY segment_id ORDER BY i)), g AS (SELECT *, sum(f) OVER (PARTITION BY segment_id ORDER BY i) AS run FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY segment_id, run ORDER BY i) AS rn, count(*) OVER (PARTITION BY segment_id, run) AS c FROM g)"""
_W5 = "[" + ", ".join(repr(x) for x in HANN5) + "]"

QUERIES = {
    f.__name__: f for f in (hop_windows, grid_chunks, frame_windows, longest_run, valid_runs, gap_fill, zero_crossings, running_median, hann_smooth, suppress_close, boundary_runs, cycle_segments,
                            target_segments, complement_intervals, weighted_median_period)
}
ORACLES = {
    "hop_windows": """WITH d AS (SELECT video_id, duration_s AS d FROM recordings WHERE duration_s > 0 AND NOT isnan(duration_s)),
      w AS (SELECT video_id, d, unnest(CASE WHEN d <= 30 THEN [0.0] ELSE [i * 20.0 for i in range(0, CAST(greatest(ceil((d - 1e-6) / 20) , 1) AS BIGINT))] END)::DOUBLE AS t0 FROM d)
      SELECT video_id, round(t0, 6) + 0.0 AS t0, round(CASE WHEN d <= 30 THEN d ELSE least(t0 + 30, d) END, 6) + 0.0 AS t1, d <= 30 AS whole FROM w WHERE d <= 30 OR least(t0 + 30, d) - t0 >= 10 OR t0 = 0""",
    "grid_chunks": """SELECT video_id, CAST(i AS INTEGER) AS chunk_no, round(5.0 + i * 25.0, 6)::DOUBLE AS t0, round(5.0 + (i + 1) * 25.0, 6)::DOUBLE AS t1
      FROM (SELECT video_id, unnest(range(0, CAST(floor((duration_s - 5) / 25) AS BIGINT))) AS i FROM recordings WHERE duration_s > 5)""",
    "frame_windows": f"""WITH {SEG}, p AS (SELECT segment_id, CASE WHEN len(phash) < 16 THEN phash || [phash[len(phash)] for i in range(0, 16 - len(phash))] ELSE phash END AS p FROM seg WHERE len(phash) > 0)
      SELECT segment_id, CAST(s AS INTEGER) AS start, p[s + 1:s + 16] AS "window" FROM (SELECT segment_id, p, unnest(range(0, len(p) - 15, 8)) AS s FROM p)""",
    "longest_run": """WITH d AS (SELECT DISTINCT video_id, segment_id AS p FROM caption_segments WHERE error IS NULL), f AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY video_id ORDER BY p) <= 2 THEN 0 ELSE 1 END AS f FROM d),
      g AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY p) AS g FROM f), c AS (SELECT video_id, g, count(*) AS c FROM g GROUP BY ALL) SELECT video_id, max(c) AS longest FROM c GROUP BY video_id""",
    "valid_runs": f"""WITH {_HOURS}, d AS (SELECT DISTINCT event_type, hour FROM hours), f AS (SELECT *, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS g FROM d)
      SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS n FROM f GROUP BY event_type, g HAVING count(*) >= 3""",
    "gap_fill": f"""WITH {_SERIES}, k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS p0, last_value(x IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN x IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS p1, first_value(x IGNORE NULLS) OVER a AS v1,
        count(x) OVER (PARTITION BY event_type) AS n FROM series WINDOW b AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT event_type, hour, round(CASE WHEN n < 16 THEN NULL WHEN x IS NOT NULL THEN x WHEN p1 - p0 - 1 <= 3 THEN v0 + (v1 - v0) * (hour - p0) / (p1 - p0) END, 6) + 0.0 AS filled FROM k""",
    "zero_crossings": f"""WITH {_SERIES}, d AS (SELECT event_type, hour, round(coalesce(x, 0.0) - avg(coalesce(x, 0.0)) OVER (PARTITION BY event_type), 6) AS d FROM series),
      n AS (SELECT *, lead(d) OVER (PARTITION BY event_type ORDER BY hour) AS nx FROM d) SELECT event_type, hour FROM n WHERE d <= 0 AND nx > 0""",
    "running_median": f"""WITH {_SERIES}, p AS (SELECT event_type, x, [x[1], x[1]] || x || [x[len(x)], x[len(x)]] AS p FROM arrs)
      SELECT event_type, CAST(i - 1 AS INTEGER) AS pos, round(list_sort(p[i:i + 4])[3], 6) + 0.0 AS median FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p)""",
    "hann_smooth": f"""WITH {_SERIES}, p AS (SELECT event_type, x, [0.0, 0.0]::DOUBLE[] || x || [0.0, 0.0]::DOUBLE[] AS p FROM arrs)
      SELECT event_type, CAST(i - 1 AS INTEGER) AS pos, round(list_dot_product(p[i:i + 4], {_W5}::DOUBLE[]), 6) + 0.0 AS smooth FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p)""",
    "suppress_close": f"""WITH RECURSIVE {SEG}, k(segment_id, ts, t) AS (SELECT segment_id, phash_ts, list_min(phash_ts) FROM seg WHERE phash_ts IS NOT NULL
        UNION ALL SELECT segment_id, ts, list_min([x for x in ts if x - t >= 1.75]) FROM k WHERE len([x for x in ts if x - t >= 1.75]) > 0)
      SELECT segment_id, list(t ORDER BY t) AS kept FROM k GROUP BY segment_id""",
    "boundary_runs": f"WITH {_RUNS} SELECT segment_id, min(t) AS first, max(t) AS last, CAST(count(*) AS INTEGER) AS n FROM n WHERE c >= 2 GROUP BY segment_id, run",
    "cycle_segments": f"""WITH {_RUNS}, e AS (SELECT *, lead(t, 6) OVER (PARTITION BY segment_id, run ORDER BY i) AS t1 FROM n)
      SELECT segment_id, t AS t0, t1, round((t1 - t) / 6, 6) + 0.0 AS period_s FROM e WHERE (rn - 1) % 6 = 0 AND t1 IS NOT NULL""",
    "complement_intervals": """WITH r AS (SELECT video_id, max(CAST(round(duration_s * 1000) AS BIGINT)) AS d FROM recordings WHERE duration_s > 0 GROUP BY 1),
      s AS (SELECT c.video_id, greatest(CAST(round(t0 * 1000) AS BIGINT), 0) AS s, least(CAST(round(t1 * 1000) AS BIGINT), d) AS e FROM cadence_segments c JOIN r ON c.video_id = r.video_id WHERE kind = 'cadenced' AND t0 IS NOT NULL AND t1 IS NOT NULL
        UNION ALL SELECT video_id, -1, 0 FROM r UNION ALL SELECT video_id, d, d + 1 FROM r),
      o AS (SELECT video_id, s, e, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s WHERE e > s)
      SELECT DISTINCT video_id, m AS start_ms, s AS end_ms FROM o WHERE s - m >= 3000""",
    "weighted_median_period": """WITH c AS (SELECT DISTINCT video_id, seg_no, period_s, strength, t0, t1 FROM cadence_segments WHERE kind = 'cadenced' AND period_s > 0 AND strength > 0 AND t1 > t0),
      w AS (SELECT video_id, period_s, sum(CAST(round(strength * (t1 - t0), 6) AS DECIMAL(18, 6))) AS w FROM c GROUP BY ALL), k AS (SELECT *, sum(w) OVER (PARTITION BY video_id ORDER BY period_s) AS u, sum(w) OVER (PARTITION BY video_id) AS a FROM w)
      SELECT video_id, min(period_s) AS period_s FROM k WHERE u * 2 >= a GROUP BY video_id""",
}
# a run's boundaries as a list; each step walks to the boundary nearest to ten seconds on
ORACLES["target_segments"] = f"""WITH RECURSIVE {_RUNS}, l AS (SELECT segment_id, run, list(t ORDER BY i) AS ts FROM n WHERE c >= 2 GROUP BY segment_id, run),
  walk AS (SELECT segment_id, ts, NULL::BIGINT AS h, 1::BIGINT AS e FROM l UNION ALL
    SELECT segment_id, ts, e, CASE WHEN o - 1 > e AND 10 - (ts[o - 1] - ts[e]) < abs(ts[o] - ts[e] - 10) THEN o - 1 ELSE o END
    FROM (SELECT *, coalesce(list_min([j for j in range(e + 1, len(ts) + 1) if ts[j] - ts[e] >= 10]), len(ts)) AS o FROM walk WHERE e < len(ts)))
  SELECT segment_id, ts[h] AS t0, ts[e] AS t1, CAST(e - h AS INTEGER) AS n_cycles, round((ts[e] - ts[h]) / (e - h), 6) + 0.0 AS period_s FROM walk WHERE h IS NOT NULL"""
