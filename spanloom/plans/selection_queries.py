"""Queries that search, gate, select, report, and measure cadence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.vec import r6
from ..operators import cadence as CAD
from ..operators import kernels as K
from ..operators import report as R
from ..operators import selection as SEL
from ..operators.features import attach_pair
from ..operators.pairs import blocked_pairs, directed
from ..runtime import table
from ..streaming.ingest import new_only
from .views import VERD, distinct_verdicts, latest_segments
from .window_queries import _SERIES, _arrays, _hours

EVERY = 50  # the stated query set: every row whose id is divisible by this


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e, e.filter(F.col("vec_id") % EVERY == 0)


def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    r = SEL.search(e, q, "vec_id", "embedding", 10)
    return r.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), r6(F.col("similarity")).alias("similarity"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept a vector unless the corpus holds one at least 0.55 similar."""
    e, q = _vectors(spark, sf_dir)
    r = SEL.gate(SEL.search(e, q, "vec_id", "embedding", 1), q, "vec_id", 0.55)
    return r.select("vec_id", "accept", "nearest", r6(F.col("similarity")).alias("similarity"), r6(F.col("distance")).alias("distance"))


def marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each queried vector would add to the first twenty vectors."""
    e, q = _vectors(spark, sf_dir)
    r = SEL.marginal_gains(e, e.filter("vec_id < 20"), q, "vec_id", "embedding")
    return r.select(F.col("id").alias("vec_id"), r6(F.col("gain")).alias("gain"))


def facility_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight vectors of all that represent the whole table best."""
    e, _ = _vectors(spark, sf_dir)
    r = SEL.facility_location(e, e, "vec_id", "embedding", 8)
    return r.select("rank", F.col("id").alias("vec_id"), r6(F.col("gain")).alias("gain"), r6(F.col("coverage")).alias("coverage"), r6(F.col("fraction")).alias("fraction"))


def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered share after every pick of the stored runs."""
    s = table(spark, sf_dir, "selections").select("run_no", "total", F.posexplode(F.arrays_zip("pick_order", "gains")).alias("pos", "p"))
    w = Window.partitionBy("run_no").orderBy("pos")
    cover = F.sum("p.gains").over(w)
    return s.select("run_no", (F.col("pos") + 1).alias("rank"), F.col("p.pick_order").alias("segment_id"), r6(F.when(F.col("total") > 0, cover / F.col("total")).otherwise(0.0)).alias("fraction"))


def selection_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "selections")
    return s.select("run_no", SEL.knee(F.col("gains"), F.col("total"), 0.01).alias("knee"))


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of every compared pair, the best score of repeated ones."""
    v = distinct_verdicts(spark, sf_dir, "a", "b", "label", "env_score", "task_score").filter("env_score IS NOT NULL AND NOT isnan(env_score)")
    v = v.groupBy("a", "b").agg(F.max("env_score").alias("env"), F.max(F.when(~F.isnan("task_score"), F.col("task_score"))).alias("task"), F.min("label").alias("label"))
    d = directed(v, [("a", "b")]).groupBy("a", "b").agg(F.max("env").alias("env"), F.max("task").alias("task"), F.min("label").alias("label"))
    rec = lambda c: F.substring_index(c, ":", 1)
    return d.withColumn("ra", rec("a")).withColumn("rb", rec("b")).withColumn("same", F.col("ra") == F.col("rb"))


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "selections").filter("run_no = 1").select(F.posexplode(F.arrays_zip("pick_order", "gains")).alias("pos", "p"))
    return s.select(F.col("p.pick_order").alias("a"), (F.col("pos") + 1).alias("rank"), F.col("p.gains").alias("gain"))


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.segment_rows(_directed(spark, sf_dir), _picks(spark, sf_dir))
    return r.select("a", "nearest", "nearest_env", "nearest_task", "nearest_label", "max_same", "max_cross", r6(F.col("mean_same") + 1e-9).alias("mean_same"), r6(F.col("mean_cross") + 1e-9).alias("mean_cross"), "rank", r6(F.col("gain")).alias("gain"))


def recording_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.recording_pairs(_directed(spark, sf_dir))
    return r.select("ra", "rb", "segments_a", "segments_b", *[r6(F.col(c)).alias(c) for c in ("covered_a", "covered_b", "mean_best_a", "mean_best_b", "mean_env", "max_env")], "verdict")


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _directed(spark, sf_dir)
    picks = _picks(spark, sf_dir)
    r = R.session_summary(d, d.select("a", "ra").distinct(), picks.select("a", "rank"), F.lit(10))
    return r.select("ra", "segments", "picked", *[r6(F.col(c) + 1e-9).alias(c) for c in ("env_within", "env_cross", "task_within", "task_cross")])


def index_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signatures").agg(F.countDistinct("segment_id").alias("segments"), F.countDistinct("video_id").alias("recordings"))
    v = distinct_verdicts(spark, sf_dir, "env_score").filter("env_score IS NOT NULL AND NOT isnan(env_score)").agg(F.avg("env_score").alias("m"), F.max("env_score").alias("x"), F.count("*").alias("n_pairs"))
    n = table(spark, sf_dir, "null_models").agg(F.max("n_pairs").alias("null_pairs"))
    return s.join(F.broadcast(v)).join(F.broadcast(n)).select("segments", "recordings", r6(F.col("m")).alias("mean_env"), F.col("x").alias("max_env"), "n_pairs", "null_pairs")


def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warped similarity of the frame sequences of compared pairs."""
    s = latest_segments(spark, sf_dir, "app_encoder", "app_frames").filter(F.size("app_frames") > 0)
    met = attach_pair(table(spark, sf_dir, "verdicts").select("a", "b").distinct(), s, "segment_id").filter("app_encoder_a = app_encoder_b")
    r = K.pair_dtw(met, "app_frames_a", "app_frames_b")
    return r.select("a", "b", r6(1 - F.col("dtw_cost")).alias("similarity"))


def autocorr_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant period, in samples, of every event type's hourly sums."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = [(t, *K.dominant_period(x, 1.0, 2.0, 48.0)) for t, x in zip(b["event_type"], b["x"])]
            yield pd.DataFrame(rows, columns=["event_type", "period", "strength"])

    r = _arrays(spark, sf_dir).mapInPandas(run, "event_type string, period double, strength double")
    return r.select("event_type", "period", r6(F.col("strength")).alias("strength"))


def rhythm_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = [(t, i, float(v)) for t, x in zip(b["event_type"], b["x"]) for i, v in enumerate(K.rhythm_spectrum(x, 1.0))]
            yield pd.DataFrame(rows, columns=["event_type", "band", "share"])

    r = _arrays(spark, sf_dir).mapInPandas(run, "event_type string, band int, share double")
    return r.select("event_type", "band", r6(F.col("share")).alias("share"))


def rhythm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of the rhythms of every two event types."""
    r = rhythm_spectrum(spark, sf_dir).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("band", "share"))).alias("s")).select("event_type", F.col("s.share").alias("v"))
    met = attach_pair(blocked_pairs(r, "event_type", None).select("a", "b"), r, "event_type")
    return met.select("a", "b", r6(V.hellinger_cosine(F.col("v_a"), F.col("v_b"))).alias("rhythm_cos"))


def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that no signature has been made of yet."""
    return new_only(table(spark, sf_dir, "recordings").select("video_id", "site"), table(spark, sf_dir, "signatures"), "video_id")


def cadence_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadence of paths made of three hourly readings of every event type."""
    h = _hours(spark, sf_dir).groupBy("event_type", "hour").agg(F.sum("value").alias("x"), F.count("*").cast("double").alias("y"), F.avg("value").alias("z"))
    low = F.broadcast(h.agg(F.min("hour").alias("h0")))
    tracks = h.join(low).select("event_type", F.lit(1).alias("hand"), (F.col("hour") - F.col("h0")).cast("int").alias("frame"), "x", "y", "z")
    return CAD.analyse(tracks, "event_type", 10.0).select("event_type", "hand", r6(F.col("period_s")).alias("period_s"), r6(F.col("cadenced")).alias("cadenced"), r6(F.col("trackable")).alias("trackable"), F.size("boundaries").alias("n_boundaries"))


_Q = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS n FROM embeddings)"
_DIR = f"""{VERD}, v0 AS (SELECT a, b, max(env_score) AS env, max(CASE WHEN NOT isnan(task_score) THEN task_score END) AS task, min(label) AS label FROM verd WHERE env_score IS NOT NULL AND NOT isnan(env_score) GROUP BY a, b),
dir AS (SELECT a, b, max(env) AS env, max(task) AS task, min(label) AS label, split_part(a, ':', 1) AS ra, split_part(b, ':', 1) AS rb FROM (SELECT * FROM v0 UNION ALL SELECT b, a, env, task, label FROM v0) GROUP BY a, b),
picks AS (SELECT unnest(pick_order) AS a, unnest(range(1, len(pick_order) + 1)) AS rank, unnest(gains) AS gain FROM selections WHERE run_no = 1)"""
_ACF = """x AS (SELECT event_type, v - avg(v) OVER (PARTITION BY event_type) AS x, i FROM (SELECT event_type, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM arrs)),
lags AS (SELECT p.event_type, q.i - p.i AS k, sum(p.x * q.x) AS s FROM x p JOIN x q ON p.event_type = q.event_type AND q.i - p.i BETWEEN 0 AND 48 GROUP BY ALL),
ac AS (SELECT event_type, k, s / first_value(s) OVER (PARTITION BY event_type ORDER BY k) AS r FROM lags),
pk AS (SELECT *, lag(r) OVER (PARTITION BY event_type ORDER BY k) AS l, lead(r) OVER (PARTITION BY event_type ORDER BY k) AS n FROM ac)"""
_FL = lambda n: " ".join(  # noqa: E731 - one round of the greedy choice after another
    f""", c{i} AS (SELECT c, sum(greatest(s - b, 0)) AS g FROM s{i} GROUP BY c), p{i} AS (SELECT c, g FROM c{i} ORDER BY round(g, 9) DESC, c LIMIT 1),
    s{i + 1} AS (SELECT s.c, s.r, s.s, greatest(s.b, m.s) AS b FROM s{i} s JOIN (SELECT r, s FROM s{i} WHERE c = (SELECT c FROM p{i})) m USING (r))""" for i in range(1, n + 1))

QUERIES = {
    f.__name__: f for f in (knn_search, gate, marginal_gain, facility_location, coverage_curve, selection_knee, segment_rows, recording_pairs, session_summary, index_kpis, dtw_pairs,
                            autocorr_period, rhythm_spectrum, rhythm_pairs, unprocessed, cadence_analysis)
}
ORACLES = {
    "knn_search": f"""WITH {_Q}, s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.v, c.v) / (q.n * c.n), 12) AS s FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) + 0.0 AS similarity FROM r WHERE rank <= 10""",
    "gate": f"""WITH {_Q}, s AS (SELECT q.vec_id AS q, c.vec_id AS c, round(list_dot_product(q.v, c.v) / (q.n * c.n), 12) AS s FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
      SELECT q AS vec_id, s < 0.55 AS accept, c AS nearest, round(s, 6) + 0.0 AS similarity, round(1 - s, 6) + 0.0 AS distance FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) = 1""",
    "marginal_gain": f"""WITH {_Q}, b AS (SELECT x.vec_id, max(greatest(list_dot_product(x.v, c.v) / (x.n * c.n), 0)) AS b FROM v x JOIN v c ON c.vec_id < 20 GROUP BY 1)
      SELECT q.vec_id, round(sum(greatest(greatest(list_dot_product(x.v, q.v) / (x.n * q.n), 0) - b, 0)), 6) + 0.0 AS gain FROM v q JOIN v x ON q.vec_id % {EVERY} = 0 JOIN b ON b.vec_id = x.vec_id GROUP BY q.vec_id""",
    "facility_location": f"""WITH {_Q}, s1 AS (SELECT q.vec_id AS c, x.vec_id AS r, greatest(list_dot_product(x.v, q.v) / (x.n * q.n), 0) AS s, 0.0 AS b FROM v q CROSS JOIN v x){_FL(8)},
      t AS (SELECT sum(m) AS t FROM (SELECT r, max(s) AS m FROM s1 GROUP BY r)), u AS ({' UNION ALL '.join(f'SELECT {i} AS rank, c, g FROM p{i}' for i in range(1, 9))}), w AS (SELECT rank, c, g, sum(g) OVER (ORDER BY rank) AS cov FROM u)
      SELECT CAST(rank AS INTEGER) AS rank, c AS vec_id, round(g, 6) + 0.0 AS gain, round(cov, 6) + 0.0 AS coverage, round(cov / t, 6) + 0.0 AS fraction FROM w, t WHERE g > 0 OR true""",
    "coverage_curve": """WITH p AS (SELECT run_no, total, unnest(pick_order) AS segment_id, unnest(gains) AS g, unnest(range(1, len(gains) + 1)) AS rank FROM selections)
      SELECT run_no, CAST(rank AS INTEGER) AS rank, segment_id, round(CASE WHEN total > 0 THEN sum(g) OVER (PARTITION BY run_no ORDER BY rank) / total ELSE 0 END, 6) + 0.0 AS fraction FROM p""",
    "selection_knee": """SELECT run_no, CAST(coalesce(list_position([g / total < 0.01 AND total > 0 for g in gains], true) - 1, len(gains)) AS INTEGER) AS knee FROM selections""",
    "segment_rows": f"""WITH {_DIR}, n AS (SELECT * FROM dir QUALIFY row_number() OVER (PARTITION BY a ORDER BY env DESC, b) = 1),
      g AS (SELECT a, max(env) FILTER (WHERE ra = rb) AS max_same, max(env) FILTER (WHERE ra <> rb) AS max_cross, avg(env) FILTER (WHERE ra = rb) AS mean_same, avg(env) FILTER (WHERE ra <> rb) AS mean_cross FROM dir GROUP BY a)
      SELECT g.a, n.b AS nearest, n.env AS nearest_env, n.task AS nearest_task, n.label AS nearest_label, max_same, max_cross, round(mean_same + 1e-9, 6) + 0.0 AS mean_same, round(mean_cross + 1e-9, 6) + 0.0 AS mean_cross, CAST(rank AS INTEGER) AS rank, round(coalesce(gain, 0.0), 6) + 0.0 AS gain
      FROM g JOIN n USING (a) LEFT JOIN picks p ON g.a = p.a""",
    "recording_pairs": f"""WITH {_DIR}, b AS (SELECT ra, rb, a, max(env) AS best, sum(env) AS s, count(*) AS n FROM dir WHERE ra <> rb GROUP BY ALL),
      o AS (SELECT ra, rb, count(*) AS c, avg(CASE WHEN best >= 60 THEN 1.0 ELSE 0.0 END) AS cov, avg(best) AS mb, max(best) AS mx, sum(s) / sum(n) AS me FROM b GROUP BY ALL)
      SELECT x.ra, x.rb, x.c AS segments_a, y.c AS segments_b, round(x.cov, 6) + 0.0 AS covered_a, round(y.cov, 6) + 0.0 AS covered_b, round(x.mb, 6) + 0.0 AS mean_best_a, round(y.mb, 6) + 0.0 AS mean_best_b, round(x.me, 6) + 0.0 AS mean_env, round(x.mx, 6) + 0.0 AS max_env,
        CASE WHEN x.cov >= 0.8 AND y.cov >= 0.8 THEN 'DUPLICATE_COVERAGE' WHEN x.cov >= 0.8 THEN 'A_CONTAINED_IN_B' WHEN y.cov >= 0.8 THEN 'B_CONTAINED_IN_A' WHEN greatest(x.cov, y.cov) >= 0.3 THEN 'PARTIAL_OVERLAP' ELSE 'DISTINCT' END AS verdict
      FROM o x JOIN o y ON x.ra = y.rb AND x.rb = y.ra WHERE x.ra < x.rb""",
    "session_summary": f"""WITH {_DIR}, m AS (SELECT ra, count(*) AS segments, CAST(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS picked FROM (SELECT DISTINCT a, ra FROM dir) d LEFT JOIN picks p ON d.a = p.a GROUP BY ra),
      g AS (SELECT ra, avg(env) FILTER (WHERE ra = rb) AS ew, avg(env) FILTER (WHERE ra <> rb) AS ec, avg(task) FILTER (WHERE ra = rb) AS tw, avg(task) FILTER (WHERE ra <> rb) AS tc FROM dir GROUP BY ra)
      SELECT ra, segments, picked, round(ew + 1e-9, 6) + 0.0 AS env_within, round(ec + 1e-9, 6) + 0.0 AS env_cross, round(tw + 1e-9, 6) + 0.0 AS task_within, round(tc + 1e-9, 6) + 0.0 AS task_cross FROM m LEFT JOIN g USING (ra)""",
    "index_kpis": f"""WITH {VERD} SELECT (SELECT count(DISTINCT segment_id) FROM signatures) AS segments, (SELECT count(DISTINCT video_id) FROM signatures) AS recordings, round(avg(env_score), 6) + 0.0 AS mean_env, max(env_score) AS max_env, count(*) AS n_pairs,
      (SELECT max(n_pairs) FROM null_models) AS null_pairs FROM verd WHERE env_score IS NOT NULL AND NOT isnan(env_score)""",
}
ORACLES["autocorr_period"] = f"""WITH {_SERIES}, {_ACF}, best AS (SELECT event_type, k, r FROM pk WHERE k > 2 AND k < 47 AND r > l AND r >= n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY r DESC, k) = 1)
  SELECT a.event_type, CASE WHEN r >= 0.05 THEN k::DOUBLE ELSE 0.0 END AS period, CASE WHEN r >= 0.05 THEN round(r, 6) + 0.0 ELSE 0.0 END AS strength FROM arrs a LEFT JOIN best b USING (event_type)"""

_EDGES = [float(x) for x in np.geomspace(0.05, 0.5, 25)]
ORACLES["rhythm_spectrum"] = f"""WITH {_SERIES}, x AS (SELECT event_type, len(x) AS n, list_avg(x) AS m, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM arrs),
  w AS (SELECT event_type, n, i, (v - m) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM x), k AS (SELECT event_type, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT event_type, n FROM w)),
  p AS (SELECT event_type, k / n::DOUBLE AS f, power(sum(y * cos(2 * pi() * ((k * i) % n) / n)), 2) + power(sum(y * sin(2 * pi() * ((k * i) % n) / n)), 2) AS p FROM k JOIN w USING (event_type, n) GROUP BY ALL),
  b AS (SELECT event_type, len([e for e in {_EDGES} if e <= f]) - 1 AS band, p FROM p WHERE f >= {_EDGES[0]!r} AND f < {_EDGES[-1]!r}),
  s AS (SELECT event_type, band, sum(p) AS p FROM b GROUP BY ALL), g AS (SELECT event_type, unnest(range(0, 24)) AS band FROM arrs)
  SELECT event_type, CAST(band AS INTEGER) AS band, round(coalesce(p, 0) / sum(coalesce(p, 0)) OVER (PARTITION BY event_type), 6) + 0.0 AS share FROM g LEFT JOIN s USING (event_type, band)"""
ORACLES["rhythm_pairs"] = f"""WITH r AS ({ORACLES['rhythm_spectrum']}) SELECT p.event_type AS a, q.event_type AS b,
  round(sum(sqrt(p.share) * sqrt(q.share)) / ((sqrt(sum(p.share)) + 1e-8) * (sqrt(sum(q.share)) + 1e-8)), 6) + 0.0 AS rhythm_cos FROM r p JOIN r q ON p.band = q.band AND p.event_type < q.event_type GROUP BY ALL"""
ORACLES["unprocessed"] = "SELECT video_id, site FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM signatures s WHERE s.video_id = r.video_id)"
