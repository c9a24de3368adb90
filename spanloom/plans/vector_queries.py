"""Queries on vectors: pooling, whitening, pair scores, hash words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.vec import r6
from ..operators import features as FE
from ..operators import pairscore as PS
from ..runtime import table
from .views import SEG, latest_segments


def _appearing(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_segments(spark, sf_dir, *columns).filter(F.col("app_mean").isNotNull())


def vec_l2norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _appearing(spark, sf_dir, "app_mean")
    unit = V.l2_normalise(F.col("app_mean"))
    return s.select("segment_id", r6(V.norm(F.col("app_mean"))).alias("norm"), r6(F.element_at(unit, 1)).alias("first"), r6(V.norm(unit)).alias("unit_norm"))


def mean_var_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "app_frames").filter(F.size("app_frames") > 0)
    p = FE.pool_frames(s, "app_frames")
    # many means end on an exact half of the last place, which engines round differently
    rounded = lambda v: F.transform(v, lambda x: F.round(x + F.lit(1e-9), 6) + F.lit(0.0))
    return p.select("segment_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("var")).alias("var"))


def whitener_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "app_encoder", "app_frames").filter(F.col("app_frames").isNotNull())
    w = FE.fit_whitener(s, "app_encoder", "app_frames")
    return w.select("app_encoder", "dim", "n", r6(F.col("mu")).alias("mu"), r6(F.col("sd")).alias("sd"))


def whitener_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "app_encoder", "app_frames").filter(F.col("app_frames").isNotNull())
    w = FE.alternate_whitener(s, "app_encoder", "app_frames")
    return w.select("app_encoder", "dim", r6(F.col("mu")).alias("mu"), r6(F.col("sd")).alias("sd"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct pairs of segments that an earlier run compared."""
    return table(spark, sf_dir, "verdicts").select("a", "b").distinct()


def vec_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _appearing(spark, sf_dir, "app_encoder", "app_mean")
    met = FE.attach_pair(_pairs(spark, sf_dir), s, "segment_id").filter("app_encoder_a = app_encoder_b")
    return met.select("a", "b", r6(V.cosine(F.col("app_mean_a"), F.col("app_mean_b"))).alias("cosine"))


def whitened_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "app_encoder", "app_frames", "app_mean")
    w = FE.whitener_rows(FE.fit_whitener(s.filter(F.col("app_frames").isNotNull()), "app_encoder", "app_frames"), "app_encoder")
    z = s.filter(F.col("app_mean").isNotNull()).join(F.broadcast(w), "app_encoder").select("segment_id", "app_encoder", V.whiten(F.col("app_mean"), F.col("mu"), F.col("sd")).alias("z"))
    met = FE.attach_pair(_pairs(spark, sf_dir), z, "segment_id").filter("app_encoder_a = app_encoder_b")
    return met.select("a", "b", r6(V.cosine(F.col("z_a"), F.col("z_b"))).alias("cosine"))


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "app_encoder", "app_frames").filter(F.size("app_frames") > 0)
    return FE.pool_frames(s, "app_frames")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_segments(spark, sf_dir, "app_encoder", "app_frames")


def env_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = FE.env_scores(_pairs(spark, sf_dir), _framed(spark, sf_dir))
    return r.select("a", "b", *[r6(F.col(c)).alias(c) for c in ("env_cos", "env_chamfer", "env_bhat_sim", "env_raw")])


def chamfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = FE.env_scores(_pairs(spark, sf_dir), _framed(spark, sf_dir))
    return r.select("a", "b", r6(F.col("env_chamfer")).alias("chamfer"))


def bhattacharyya_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _pooled(spark, sf_dir).drop("app_frames")
    met = FE.attach_pair(_pairs(spark, sf_dir), s, "segment_id").filter("app_encoder_a = app_encoder_b")
    c = F.col
    return met.select("a", "b", r6(V.bhattacharyya_similarity(c("mean_a"), c("var_a"), c("mean_b"), c("var_b"))).alias("similarity"))


def period_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "period_s", "period_strength")
    met = FE.attach_pair(_pairs(spark, sf_dir), s, "segment_id")
    z = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return met.select("a", "b", r6(V.period_agreement(z("period_s_a"), z("period_s_b"), z("period_strength_a"), z("period_strength_b"))).alias("agreement"))


def episode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one recording scored against each other, with the whitener and the null model of all recordings."""
    s = latest_segments(spark, sf_dir, "video_id", "app_encoder", "app_frames").filter(F.size("app_frames") > 0)
    rec = s.select("segment_id", "video_id")
    compared = table(spark, sf_dir, "verdicts").select("a", "b").distinct()
    far = FE.attach_pair(compared, rec, "segment_id").filter("video_id_a <> video_id_b").select("a", "b")
    r = PS.episode_scores(s, far, "video_id")
    return r.select(F.col("episode").alias("video_id"), "a", "b", *[r6(F.col(c)).alias(c) for c in ("env_cos", "env_chamfer", "env_bhat_sim", "env_raw")], F.round("env_percentile", 4).alias("env_percentile"))


def hash_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.pack_bits(V.doubles(F.col("embedding"))).alias("word"))


def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_segments(spark, sf_dir, "phash").filter(F.col("phash").isNotNull())
    return s.select("segment_id", V.even_sample(F.col("phash"), 16).alias("sample"))


_MEAN = "[list_avg([f[i]::DOUBLE for f in app_frames]) for i in range(1, len(app_frames[1]) + 1)]"
_POOL = f"""pooled AS (SELECT segment_id, app_encoder, app_frames, mean,
    [list_avg([(f[i]::DOUBLE - mean[i]) * (f[i]::DOUBLE - mean[i]) for f in app_frames]) for i in range(1, len(mean) + 1)] AS var
  FROM (SELECT segment_id, app_encoder, app_frames, {_MEAN} AS mean FROM seg WHERE len(app_frames) > 0))"""
_PAIRS = "pairs AS (SELECT DISTINCT a, b FROM verdicts)"
_COS = lambda x, y: f"list_dot_product({x}, {y}) / ((sqrt(list_dot_product({x}, {x})) + 1e-8) * (sqrt(list_dot_product({y}, {y})) + 1e-8))"
_UNIT = "[[x::DOUBLE / (sqrt(list_dot_product(f::DOUBLE[], f::DOUBLE[])) + 1e-8) for x in f] for f in app_frames]"
_CHAMFER = "(list_avg([list_max([list_dot_product(x, y) for y in q.u]) for x in p.u]) + list_avg([list_max([list_dot_product(x, y) for x in p.u]) for y in q.u])) / 2"
_BHAT = """exp(-list_avg([(p.mean[i] - q.mean[i]) * (p.mean[i] - q.mean[i]) / (8 * (greatest(p.var[i], 1e-6) + greatest(q.var[i], 1e-6)) / 2)
    + 0.5 * ln((greatest(p.var[i], 1e-6) + greatest(q.var[i], 1e-6)) / 2 / sqrt(greatest(p.var[i], 1e-6) * greatest(q.var[i], 1e-6))) for i in range(1, len(p.mean) + 1)]))"""
_DIMS = """dims AS (SELECT app_encoder, unnest(range(0, len(f))) AS dim, unnest(f)::DOUBLE AS x FROM (SELECT app_encoder, unnest(app_frames) AS f FROM seg WHERE app_frames IS NOT NULL)),
stats AS (SELECT app_encoder, dim, count(x) AS n, avg(x) AS mu, var_pop(x) AS v FROM dims GROUP BY ALL)"""
_WHITE = _DIMS + """, shrunk AS (SELECT app_encoder, dim, n, mu, sqrt(n / (n + 40.0) * v + (1 - n / (n + 40.0)) * avg(v) OVER (PARTITION BY app_encoder)) AS sd FROM stats),
white AS (SELECT app_encoder, dim, n, mu, greatest(sd, 1e-3, median(sd) OVER (PARTITION BY app_encoder) / 100) AS sd FROM shrunk)"""

QUERIES = {
    "vec_l2norm": vec_l2norm, "mean_var_pool": mean_var_pool, "whitener_stats": whitener_stats, "whitener_alternate": whitener_alternate, "vec_cosine_pairs": vec_cosine_pairs,
    "whitened_cosine": whitened_cosine, "env_scores": env_scores, "chamfer_pairs": chamfer_pairs, "bhattacharyya_pairs": bhattacharyya_pairs, "period_agreement": period_agreement,
    "hash_pack": hash_pack, "episode_scores": episode_scores, "even_subsample": even_subsample,
}
ORACLES = {
    "vec_l2norm": f"""WITH {SEG} SELECT segment_id, round(n, 6) + 0.0 AS norm, round(v[1] / (n + 1e-8), 6) + 0.0 AS first, round(n / (n + 1e-8), 6) + 0.0 AS unit_norm
      FROM (SELECT segment_id, app_mean::DOUBLE[] AS v, sqrt(list_dot_product(app_mean::DOUBLE[], app_mean::DOUBLE[])) AS n FROM seg WHERE app_mean IS NOT NULL)""",
    "mean_var_pool": f"WITH {SEG}, {_POOL} SELECT segment_id, [round(x + 1e-9, 6) + 0.0 for x in mean] AS mean, [round(x + 1e-9, 6) + 0.0 for x in var] AS var FROM pooled",
    "whitener_stats": f"WITH {SEG}, {_WHITE} SELECT app_encoder, dim::INTEGER AS dim, n, round(mu, 6) + 0.0 AS mu, round(sd, 6) + 0.0 AS sd FROM white",
    "whitener_alternate": f"""WITH {SEG}, {_DIMS} SELECT app_encoder, dim::INTEGER AS dim, round(mu, 6) + 0.0 AS mu,
      round(greatest(n / (n + 40.0) * sqrt(v) + (1 - n / (n + 40.0)) * avg(sqrt(v)) OVER (PARTITION BY app_encoder), 1e-3), 6) + 0.0 AS sd FROM stats""",
    "vec_cosine_pairs": f"""WITH {SEG}, {_PAIRS}, v AS (SELECT segment_id, app_encoder, app_mean::DOUBLE[] AS v FROM seg WHERE app_mean IS NOT NULL)
      SELECT a, b, round({_COS('p.v', 'q.v')}, 6) + 0.0 AS cosine FROM pairs JOIN v p ON a = p.segment_id JOIN v q ON b = q.segment_id WHERE p.app_encoder = q.app_encoder""",
    "whitened_cosine": f"""WITH {SEG}, {_PAIRS}, {_WHITE}, w AS (SELECT app_encoder, list(mu ORDER BY dim) AS mu, list(sd ORDER BY dim) AS sd FROM white GROUP BY app_encoder),
      z0 AS (SELECT segment_id, s.app_encoder, [(app_mean[i]::DOUBLE - mu[i]) / sd[i] for i in range(1, len(mu) + 1)] AS z FROM seg s JOIN w ON s.app_encoder = w.app_encoder WHERE app_mean IS NOT NULL),
      v AS (SELECT segment_id, app_encoder, [x / (sqrt(list_dot_product(z, z)) + 1e-8) for x in z] AS v FROM z0)
      SELECT a, b, round({_COS('p.v', 'q.v')}, 6) + 0.0 AS cosine FROM pairs JOIN v p ON a = p.segment_id JOIN v q ON b = q.segment_id WHERE p.app_encoder = q.app_encoder""",
    "env_scores": f"""WITH {SEG}, {_PAIRS}, {_POOL}, v AS (SELECT *, {_UNIT} AS u FROM pooled),
      s AS (SELECT a, b, {_COS('p.mean', 'q.mean')} AS c, {_CHAMFER} AS h, {_BHAT} AS t FROM pairs JOIN v p ON a = p.segment_id JOIN v q ON b = q.segment_id WHERE p.app_encoder = q.app_encoder)
      SELECT a, b, round(c, 6) + 0.0 AS env_cos, round(h, 6) + 0.0 AS env_chamfer, round(t, 6) + 0.0 AS env_bhat_sim, round((0.5 * c + 0.35 * h + 0.15 * t) / 1.0, 6) + 0.0 AS env_raw FROM s""",
    "chamfer_pairs": f"""WITH {SEG}, {_PAIRS}, v AS (SELECT segment_id, app_encoder, {_UNIT} AS u FROM seg WHERE len(app_frames) > 0)
      SELECT a, b, round({_CHAMFER}, 6) + 0.0 AS chamfer FROM pairs JOIN v p ON a = p.segment_id JOIN v q ON b = q.segment_id WHERE p.app_encoder = q.app_encoder""",
    "bhattacharyya_pairs": f"""WITH {SEG}, {_PAIRS}, {_POOL} SELECT a, b, round({_BHAT}, 6) + 0.0 AS similarity
      FROM pairs JOIN pooled p ON a = p.segment_id JOIN pooled q ON b = q.segment_id WHERE p.app_encoder = q.app_encoder""",
    "period_agreement": f"""WITH {SEG}, {_PAIRS}, v AS (SELECT segment_id, coalesce(period_s, 0.0) AS p, coalesce(period_strength, 0.0) AS s FROM seg),
      m AS (SELECT a, b, x.p AS p, y.p AS q, x.s AS s, y.s AS t, greatest(x.p, y.p) / nullif(least(x.p, y.p), 0) AS r FROM pairs JOIN v x ON a = x.segment_id JOIN v y ON b = y.segment_id)
      SELECT a, b, CASE WHEN p > 0 AND q > 0 THEN round(exp(-power(least(abs(r - 1), abs(r - 2) / 2, abs(r - 3) / 3) / 0.15, 2)) * sqrt(greatest(s * t, 0.0)), 6) + 0.0 ELSE 0.0 END AS agreement FROM m""",
    "hash_pack": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_sort(embedding[2:64]::DOUBLE[])[32] AS m FROM embeddings)
      SELECT vec_id, CAST(list_sum([CASE WHEN e[i + 1] > m THEN CAST(1 AS HUGEINT) << i ELSE 0 END for i in range(1, 64)])
        - CASE WHEN e[64] > m THEN CAST(1 AS HUGEINT) << 64 ELSE 0 END AS BIGINT) AS word FROM v""",
    "even_subsample": f"""WITH {SEG} SELECT segment_id, CASE WHEN len(phash) <= 16 THEN phash ELSE [phash[CAST(round_even(i * (len(phash) - 1) / 15.0, 0) AS BIGINT) + 1] for i in range(0, 16)] END AS sample
      FROM seg WHERE phash IS NOT NULL""",
}
ORACLES["episode_scores"] = f"""WITH {SEG}, {_POOL}, {_WHITE}, w AS (SELECT app_encoder, list(mu ORDER BY dim) AS mu, list(sd ORDER BY dim) AS sd FROM white GROUP BY app_encoder),
  z AS (SELECT p.*, s.video_id, [[(f[i]::DOUBLE - mu[i]) / sd[i] for i in range(1, len(mu) + 1)] for f in p.app_frames] AS zf, [(mean[i] - mu[i]) / sd[i] for i in range(1, len(mu) + 1)] AS zm FROM pooled p JOIN w USING (app_encoder) JOIN seg s USING (segment_id)),
  y AS (SELECT * EXCLUDE (zf, zm), [[x / (sqrt(list_dot_product(f, f)) + 1e-8) for x in f] for f in zf] AS zf, [x / (sqrt(list_dot_product(zm, zm)) + 1e-8) for x in zm] AS zm FROM z),
  v AS (SELECT *, [[x / (sqrt(list_dot_product(f, f)) + 1e-8) for x in f] for f in zf] AS u FROM y),
  prs AS (SELECT p.segment_id AS a, q.segment_id AS b, true AS near FROM v p JOIN v q ON p.video_id = q.video_id AND p.segment_id < q.segment_id UNION ALL
    SELECT a, b, false FROM (SELECT DISTINCT a, b FROM verdicts) JOIN v p ON a = p.segment_id JOIN v q ON b = q.segment_id WHERE p.video_id <> q.video_id),
  s AS (SELECT a, b, near, p.video_id, {_COS('p.zm', 'q.zm')} AS c, {_CHAMFER} AS h, {_BHAT} AS t FROM prs JOIN v p ON a = p.segment_id JOIN v q ON b = q.segment_id WHERE p.app_encoder = q.app_encoder),
  r AS (SELECT *, 0.5 * h + 0.35 * c + 0.15 * t AS raw FROM s), g AS (SELECT quantile_cont(raw, [{', '.join(repr(i / 200) for i in range(201))}]) AS q FROM r WHERE NOT near),
  k AS (SELECT r.*, q, len([x for x in q if x <= raw]) AS k FROM r, g WHERE near)
  SELECT video_id, a, b, round(c, 6) + 0.0 AS env_cos, round(h, 6) + 0.0 AS env_chamfer, round(t, 6) + 0.0 AS env_bhat_sim, round(raw, 6) + 0.0 AS env_raw,
    CASE WHEN k = 0 THEN 0.0 WHEN k >= 201 THEN 100.0 ELSE round((k - 1 + (raw - q[k]) / (q[k + 1] - q[k])) / 200 * 100, 4) END AS env_percentile FROM k"""
