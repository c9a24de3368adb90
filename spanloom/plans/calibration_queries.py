"""Queries that calibrate, evaluate and tally scores of the verdicts and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.vec import r6, r6_scaled
from ..operators import calibrate as C
from ..operators import decide as D
from ..operators import pairscore as PS
from ..operators.features import TASK_WEIGHTS, fuse
from ..operators.kernels import pair_env_scores
from ..operators.ranks import exact_grid
from ..runtime import table
from .views import NULLS, SEG, VERD, distinct_verdicts, latest_segments, with_null_model

METRICS = ("env_cos", "env_chamfer", "env_bhat_sim", "task_cos", "task_dtw_sim", "rhythm_cos", "period_agree", "env_raw", "task_raw")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"raw.{m}").alias("value")) for m in METRICS])).alias("p")
    return distinct_verdicts(spark, sf_dir, "raw").select(pairs).select("p.*")


def null_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.null_grid(_readings(spark, sf_dir), ["metric"], "value")
    return g.select("metric", "n_pairs", F.transform("quantiles", lambda q: F.round(q + F.lit(1e-9), 6) + F.lit(0.0)).alias("quantiles"), *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("mean_value", "std_value")])


def _with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment readings beside the stored null model of their encoder."""
    reading = F.when(~F.isnan("raw.env_raw"), F.col("raw.env_raw"))  # NaN is no reading
    v = distinct_verdicts(spark, sf_dir, "a", "b", reading.alias("env_raw"))
    return with_null_model(spark, sf_dir, v, "env_raw", "quantiles", "mean_value", "std_value")


def null_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every reading in the null model of its encoder; null without a model of both sides."""
    p = F.when(F.col("quantiles").isNotNull(), V.grid_percentile(F.col("env_raw"), F.col("quantiles")))
    return _with_null(spark, sf_dir).select("a", "b", "env_raw", F.round(p, 6).alias("percentile"))


def null_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.when(F.col("mean_value").isNotNull(), V.z_score(F.col("env_raw"), F.col("mean_value"), F.col("std_value")))
    return _with_null(spark, sf_dir).select("a", "b", r6(z).alias("z"))


def _similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "a", "b", F.col("raw.env_raw").alias("env_raw"), F.col("raw.task_raw").alias("task_raw"))
    v = with_null_model(spark, sf_dir, v, "env_raw", "quantiles").withColumnRenamed("quantiles", "env_grid")
    v = with_null_model(spark, sf_dir, v, "task_raw", "quantiles").withColumnRenamed("quantiles", "task_grid")
    return PS.similarity(v, F.col("env_grid"), F.col("task_grid"))


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every compared pair in its place, its task and both, against the null models of its encoder."""
    return _similarities(spark, sf_dir).select("a", "b", *[r6_scaled(F.col(c)).alias(c) for c in ("env", "task", "fused")])


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most similar pairs by place, the best score of a repeated pair counting."""
    best = _similarities(spark, sf_dir).groupBy("a", "b").agg(F.round(F.max("env"), 6).alias("env")).filter("env IS NOT NULL")
    return best.orderBy(F.desc("env"), "a", "b").limit(100)


def one_sided_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pairs of one session lie among pairs of different industries."""
    v = distinct_verdicts(spark, sf_dir, "a", "b", "stratum", "raw.env_raw")
    null = v.filter("stratum = 'diff_industry'").select(F.col("env_raw").alias("null_raw"))
    asked = v.filter("stratum LIKE 'same_session%'").select("a", "b", "env_raw")
    r = C.one_sided_percentile(asked, null, "env_raw", "null_raw")
    return r.select("a", "b", F.round("percentile", 6).alias("percentile"), D.one_sided_verdict(F.col("percentile")).alias("verdict"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_pairs")
    return t.select("video_a", "video_b", "run_at", "task_sim", "same_job_family").distinct()


def auc_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.auc(_labelled(spark, sf_dir), "task_sim", "same_job_family")
    return r.select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rank_auc(_labelled(spark, sf_dir), "task_sim", "same_job_family", ["run_at", "video_a", "video_b"]).select(F.round("auc", 9).alias("auc"))


def f1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.f1_sweep(_labelled(spark, sf_dir), "task_sim", "same_job_family")
    return r.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def best_f1_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_cut(_labelled(spark, sf_dir), "task_sim", "same_job_family").select("threshold", F.round("f1", 6).alias("f1"))


def axis_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.separation(_labelled(spark, sf_dir), "task_sim", "same_job_family")
    return r.select(r6(F.col("mp")).alias("mean_pos"), r6(F.col("mn")).alias("mean_neg"), r6(F.col("separation")).alias("separation"))


def fit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the environment components that tell pairs of one session from other pairs."""
    parts = ["env_cos", "env_chamfer", "env_bhat_sim"]
    v = distinct_verdicts(spark, sf_dir, "stratum", *[F.col(f"raw.{p}").alias(p) for p in parts])
    clean = v.filter("stratum IS NOT NULL AND stratum <> '?'").select(F.col("stratum").startswith("same_session").alias("same"), *[F.when(F.abs(F.col(p)) <= 1, F.col(p)).alias(p) for p in parts])
    w = C.fit_weights(clean, parts, "same")
    return spark.createDataFrame([(k, float(x)) for k, x in w.items()], "component string, weight double")


def stratum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "stratum", "env_score")
    g = exact_grid(v, ["stratum"], "env_score", 11)
    return g.select("stratum", "n", F.round(F.element_at("quantiles", 6) + 1e-9, 6).alias("median"), F.round(F.element_at("quantiles", 10) + 1e-9, 6).alias("p90"))


def within_group_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "stratum", "env_score", "task_score").filter("env_score IS NOT NULL AND task_score IS NOT NULL AND NOT isnan(env_score) AND NOT isnan(task_score)")
    n = F.count("*")
    return v.groupBy("stratum").agg(n.alias("n"), F.when(n > 8, r6(F.corr("env_score", "task_score"))).alias("r"))


def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment scores of the two halves of every segment with at least four frames."""
    s = latest_segments(spark, sf_dir, "app_frames")
    h = C.split_half(s, "segment_id", "app_frames", 4)
    r = pair_env_scores(h.select(F.col("segment_id").alias("a"), F.col("segment_id").alias("b"), F.col("first").alias("app_frames_a"), F.col("second").alias("app_frames_b")))
    return r.select(F.col("a").alias("segment_id"), *[r6(F.col(c)).alias(c) for c in ("env_cos", "env_chamfer", "env_bhat_sim")], r6(fuse()).alias("env_raw"))


def fused_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "a", "b", "raw")
    ok = {k: F.when(~F.isnan(F.col(f"raw.{k}")), F.col(f"raw.{k}")) for k in TASK_WEIGHTS}
    return v.select("a", "b", r6(fuse(ok, TASK_WEIGHTS)).alias("task_raw"))


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.frequency(distinct_verdicts(spark, sf_dir, "label", "stratum"), "label", "stratum")
    return r.select("label", "stratum", "n", F.round("share", 6).alias("share"))


def distinct_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "signatures").agg(F.countDistinct("video_id").alias("recordings"), F.countDistinct("segment_id").alias("segments"))


def window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window pairs rolled up to pairs of recordings."""
    v = distinct_verdicts(spark, sf_dir, "a", "b", "label", "env_score", "task_score", "dup")
    rec = lambda c: F.substring_index(c, ":", 1)
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    best = F.max_by("dup", F.struct(F.coalesce("dup.overlap_seconds", F.lit(-1.0)), "a", "b"))
    g = v.groupBy(rec("a").alias("video_a"), rec("b").alias("video_b")).agg(
        F.count("*").alias("n_pairs"), F.avg(ok("env_score")).alias("env"), F.avg(ok("task_score")).alias("task"), F.stddev_pop(ok("env_score")).alias("env_std"),
        F.coalesce(F.bool_or(F.col("label") == "DUPLICATE_SOURCE"), F.lit(False)).alias("duplicate"), best.alias("dup"))
    label = F.when(F.col("duplicate"), "DUPLICATE_SOURCE").otherwise(D.percentile_verdict(F.col("env"), F.col("task")))
    return g.select("video_a", "video_b", "n_pairs", r6(F.col("env")).alias("env"), r6(F.col("task")).alias("task"), r6(F.col("env_std")).alias("env_std"), label.alias("label"), F.col("dup.overlap_seconds").alias("overlap_seconds"))


_GRID = "[" + ", ".join(repr(i / 200) for i in range(201)) + "]"
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, raw.{m} AS value FROM verd" for m in METRICS)
_LAB = "lab AS (SELECT * FROM (SELECT DISTINCT video_a, video_b, run_at, task_sim, same_job_family FROM task_pairs) WHERE task_sim IS NOT NULL AND NOT isnan(task_sim) AND same_job_family IS NOT NULL)"
_PLACE = lambda x, q: f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {q} IS NULL THEN ({x} + 1) / 2 WHEN {x} < {q}[1] THEN 0.0 WHEN {x} >= {q}[201] THEN 1.0 ELSE (len([g for g in {q} if g <= {x}]) - 1 + ({x} - {q}[len([g for g in {q} if g <= {x}])]) / ({q}[len([g for g in {q} if g <= {x}]) + 1] - {q}[len([g for g in {q} if g <= {x}])])) / 200 END"
_SIM = f"""sims AS (SELECT v.a, v.b, {_PLACE('v.raw.env_raw', 'v.q')} AS env, {_PLACE('v.raw.task_raw', 'n.quantiles')} AS task FROM nulls v LEFT JOIN seg x ON v.a = x.segment_id LEFT JOIN seg y ON v.b = y.segment_id
  LEFT JOIN null_models n ON n.metric = 'task_raw' AND n.encoder = x.app_encoder AND x.app_encoder = y.app_encoder)"""
_POS = "CAST(same_job_family AS INTEGER)"
_SWEEP = f"""{_LAB}, cnt AS (SELECT task_sim AS t, sum({_POS}) AS p, sum(1 - {_POS}) AS n FROM lab GROUP BY 1),
acc AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp FROM cnt WINDOW w AS (ORDER BY t DESC)),
sweep AS (SELECT t AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(pp - tp AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall,
  CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + pp) ELSE 0 END AS f FROM acc)"""
_HALF = lambda x: f"(SELECT segment_id, {x} AS fr FROM seg WHERE len(app_frames) >= 4)"

QUERIES = {
    f.__name__: f for f in (similarity_pairs, top_pairs, null_quantiles, null_percentile, null_zscore, one_sided_percentile, auc_tied, rank_auc, f1_sweep, best_f1_cut, axis_separation, fit_weights, stratum_summary,
                            within_group_corr, split_half, fused_task, label_shares, distinct_recordings, window_rollup)
}
ORACLES = {
    "null_quantiles": f"""WITH {VERD}, r AS ({_LONG}) SELECT metric, count(*) AS n_pairs, [round(x + 1e-9, 6) + 0.0 for x in quantile_cont(value, {_GRID})] AS quantiles,
      round(avg(value), 9) + 0.0 AS mean_value, round(stddev_pop(value), 9) + 0.0 AS std_value FROM r WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric""",
    "null_percentile": f"""WITH {VERD}, {SEG}, {NULLS}, y AS (SELECT a, b, CASE WHEN NOT isnan(raw.env_raw) THEN raw.env_raw END AS v, q FROM nulls), x AS (SELECT *, CASE WHEN v IS NOT NULL AND q IS NOT NULL THEN len([g for g in q if g <= v]) END AS k FROM y)
      SELECT a, b, v AS env_raw, CASE WHEN k = 0 THEN 0.0 WHEN k >= len(q) THEN 100.0 WHEN k IS NOT NULL THEN round((k - 1 + (v - q[k]) / (q[k + 1] - q[k])) / 200 * 100, 6) END AS percentile FROM x""",
    "null_zscore": f"WITH {VERD}, {SEG}, {NULLS} SELECT a, b, CASE WHEN std_value > 0 AND NOT isnan(raw.env_raw) THEN round((raw.env_raw - mean_value) / std_value, 6) + 0.0 END AS z FROM nulls",
    "similarity_pairs": f"WITH {VERD}, {SEG}, {NULLS}, {_SIM} SELECT a, b, round(env, 6) + 0.0 AS env, round(task, 6) + 0.0 AS task, round((env + task) / 2, 6) + 0.0 AS fused FROM sims",
    "top_pairs": f"WITH {VERD}, {SEG}, {NULLS}, {_SIM} SELECT a, b, round(max(env), 6) AS env FROM sims GROUP BY a, b HAVING max(env) IS NOT NULL ORDER BY 3 DESC, a, b LIMIT 100",
    "one_sided_percentile": f"""WITH {VERD}, v AS (SELECT a, b, stratum, raw.env_raw AS x FROM verd), n AS (SELECT x, count(*) AS c FROM v WHERE stratum = 'diff_industry' AND x IS NOT NULL AND NOT isnan(x) GROUP BY x),
      cum AS (SELECT x, sum(c) OVER (ORDER BY x) AS upto, sum(c) OVER () AS total FROM n), p AS (SELECT a, b, CASE WHEN s.x IS NOT NULL AND NOT isnan(s.x) THEN 100.0 * coalesce((SELECT max(upto) FROM cum WHERE cum.x < s.x), 0) / (SELECT max(total) FROM cum) END AS pc
        FROM v s WHERE stratum LIKE 'same_session%')
      SELECT a, b, round(pc, 6) AS percentile, CASE WHEN pc >= 99.5 THEN 'SAME_ENV' WHEN pc <= 90 THEN 'DIFFERENT_ENV' ELSE 'UNRESOLVED' END AS verdict FROM p""",
    "auc_tied": f"""WITH {_LAB}, c AS (SELECT task_sim, sum({_POS}) AS p, sum(1 - {_POS}) AS n FROM lab GROUP BY 1), w AS (SELECT *, sum(n) OVER (ORDER BY task_sim) - n AS below FROM c)
      SELECT round(sum(p * (below + 0.5 * n)) / (sum(p)::DOUBLE * sum(n)), 9) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM w""",
    "rank_auc": f"""WITH {_LAB}, r AS (SELECT {_POS} AS y, row_number() OVER (ORDER BY task_sim, run_at NULLS FIRST, video_a NULLS FIRST, video_b NULLS FIRST) AS rn FROM lab)
      SELECT round((sum(rn * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))), 9) AS auc FROM r""",
    "f1_sweep": f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, precision, recall, round(f, 6) AS f1 FROM sweep",
    "best_f1_cut": f"WITH {_SWEEP} SELECT threshold, round(f, 6) AS f1 FROM sweep ORDER BY f DESC, threshold LIMIT 1",
    "axis_separation": f"""WITH {_LAB} SELECT round(avg(task_sim) FILTER (WHERE same_job_family), 6) + 0.0 AS mean_pos, round(avg(task_sim) FILTER (WHERE NOT same_job_family), 6) + 0.0 AS mean_neg,
      round((avg(task_sim) FILTER (WHERE same_job_family) - avg(task_sim) FILTER (WHERE NOT same_job_family)) / sqrt((var_pop(task_sim) FILTER (WHERE same_job_family) + var_pop(task_sim) FILTER (WHERE NOT same_job_family)) / 2), 6) + 0.0 AS separation FROM lab""",
    "stratum_summary": f"""WITH {VERD} SELECT stratum, count(*) AS n, round(quantile_cont(env_score, 0.5) + 1e-9, 6) AS median, round(quantile_cont(env_score, 0.9) + 1e-9, 6) AS p90
      FROM verd WHERE env_score IS NOT NULL AND NOT isnan(env_score) GROUP BY stratum""",
    "within_group_corr": f"""WITH {VERD} SELECT stratum, count(*) AS n, CASE WHEN count(*) > 8 THEN round(corr(env_score, task_score), 6) + 0.0 END AS r FROM verd
      WHERE env_score IS NOT NULL AND task_score IS NOT NULL AND NOT isnan(env_score) AND NOT isnan(task_score) GROUP BY stratum""",
    "fused_task": f"""WITH {VERD}, x AS (SELECT a, b, {', '.join(f"CASE WHEN isnan(raw.{k}) THEN 0 ELSE coalesce(raw.{k}, 0) END AS {k}" for k in TASK_WEIGHTS)} FROM verd)
      SELECT a, b, round({' + '.join(f'{w} * {k}' for k, w in TASK_WEIGHTS.items())}, 6) + 0.0 AS task_raw FROM x""",
    "label_shares": f"WITH {VERD} SELECT label, stratum, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM verd GROUP BY label, stratum",
    "distinct_recordings": "SELECT count(DISTINCT video_id) AS recordings, count(DISTINCT segment_id) AS segments FROM signatures",
    "window_rollup": f"""WITH {VERD}, g AS (SELECT split_part(a, ':', 1) AS video_a, split_part(b, ':', 1) AS video_b, count(*) AS n_pairs, avg(CASE WHEN NOT isnan(env_score) THEN env_score END) AS env,
        avg(CASE WHEN NOT isnan(task_score) THEN task_score END) AS task, stddev_pop(CASE WHEN NOT isnan(env_score) THEN env_score END) AS s, coalesce(bool_or(label = 'DUPLICATE_SOURCE'), false) AS d, max(dup.overlap_seconds) AS o FROM verd GROUP BY 1, 2)
      SELECT video_a, video_b, n_pairs, round(env, 6) + 0.0 AS env, round(task, 6) + 0.0 AS task, round(s, 6) + 0.0 AS env_std,
        CASE WHEN d THEN 'DUPLICATE_SOURCE' WHEN env >= 60 THEN 'REDUNDANT' ELSE 'NOVEL' END AS label, o AS overlap_seconds FROM g""",
}
_U = lambda x: f"[[v::DOUBLE / (sqrt(list_dot_product(f::DOUBLE[], f::DOUBLE[])) + 1e-8) for v in f] for f in {x}]"
_M = lambda x: f"[list_avg([f[i]::DOUBLE for f in {x}]) for i in range(1, len({x}[1]) + 1)]"
_S = lambda x, m: f"[list_avg([(f[i]::DOUBLE - {m}[i]) * (f[i]::DOUBLE - {m}[i]) for f in {x}]) for i in range(1, len({m}) + 1)]"
ORACLES["split_half"] = f"""WITH {SEG}, h AS (SELECT segment_id, app_frames[1:len(app_frames) // 2] AS x, app_frames[len(app_frames) // 2 + 1:] AS y FROM seg WHERE len(app_frames) >= 4),
  p AS (SELECT *, {_U('x')} AS ux, {_U('y')} AS uy, {_M('x')} AS mx, {_M('y')} AS my FROM h), v AS (SELECT *, {_S('x', 'mx')} AS vx, {_S('y', 'my')} AS vy FROM p),
  s AS (SELECT segment_id, list_dot_product(mx, my) / ((sqrt(list_dot_product(mx, mx)) + 1e-8) * (sqrt(list_dot_product(my, my)) + 1e-8)) AS c,
    (list_avg([list_max([list_dot_product(i, j) for j in uy]) for i in ux]) + list_avg([list_max([list_dot_product(i, j) for i in ux]) for j in uy])) / 2 AS h,
    exp(-list_avg([(mx[i] - my[i]) * (mx[i] - my[i]) / (8 * (greatest(vx[i], 1e-6) + greatest(vy[i], 1e-6)) / 2) + 0.5 * ln((greatest(vx[i], 1e-6) + greatest(vy[i], 1e-6)) / 2 / sqrt(greatest(vx[i], 1e-6) * greatest(vy[i], 1e-6))) for i in range(1, len(mx) + 1)])) AS t FROM v)
  SELECT segment_id, round(c, 6) + 0.0 AS env_cos, round(h, 6) + 0.0 AS env_chamfer, round(t, 6) + 0.0 AS env_bhat_sim, round(0.5 * c + 0.35 * h + 0.15 * t, 6) + 0.0 AS env_raw FROM s"""
