"""Queries that enumerate, join and judge pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.vec import r6
from ..operators import decide as D
from ..operators import pairs as P
from ..operators.features import attach_pair
from ..operators.overlap import source_overlap as overlap_of
from ..runtime import table
from .views import NULLS, SEG, VERD, distinct_verdicts, latest_segments, with_null_model

SAMPLE = 1_000


def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every two groups of embeddings, by their mean vectors (one group a label)."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    m = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("label", F.col("v.x").alias("v"))
    pairs = P.blocked_pairs(m, "label", None)
    met = pairs.join(m.select(F.col("label").alias("a"), F.col("v").alias("va")), "a").join(m.select(F.col("label").alias("b"), F.col("v").alias("vb")), "b")
    return met.select("a", "b", r6(V.cosine(F.col("va"), F.col("vb"))).alias("cosine"))


def _clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_pairs").filter("video_a IS NOT NULL AND video_b IS NOT NULL")
    return t.select(F.col("video_a").alias("a"), F.col("video_b").alias("b")).distinct()


def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of both sides of every pair of recordings."""
    w = table(spark, sf_dir, "signatures").select("video_id", "segment_id").distinct()
    return P.window_pairs(_clean_pairs(spark, sf_dir), w, "video_id", "segment_id")


def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distinct_verdicts(spark, sf_dir, "a", "b").distinct()
    rec = lambda c: F.substring_index(c, ":", 1)
    return P.sample_pairs(p, rec("a"), rec("b"), SAMPLE)


def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blocked_pairs(table(spark, sf_dir, "recordings"), "video_id", "session_key")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "recordings").select("video_id", F.struct("environment_l1", "site", "session_key", "ordinal").alias("m"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = _clean_pairs(spark, sf_dir), _meta(spark, sf_dir)
    both = p.join(m.select(F.col("video_id").alias("a"), F.col("m").alias("m_a")), "a", "left").join(m.select(F.col("video_id").alias("b"), F.col("m").alias("m_b")), "b", "left")
    return both.select("a", "b", P.stratum().alias("stratum"))


def stratified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir)


def certain_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the pairs of different industries, which cannot be the same place."""
    return P.sample_pairs(_strata(spark, sf_dir).filter("stratum = 'diff_industry'").select("a", "b"), F.col("a"), F.col("b"), SAMPLE, "negatives")


def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signatures").select("segment_id", "video_id").distinct()
    r = table(spark, sf_dir, "recordings").select("video_id", "site", "job_family")
    return s.join(r, "video_id", "left").select("segment_id", F.coalesce("site", F.lit("UNKNOWN")).alias("site"), F.coalesce("job_family", F.lit("UNKNOWN")).alias("job_family"))


def coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair, scored only where both sides have captions."""
    p = _clean_pairs(spark, sf_dir)
    n = table(spark, sf_dir, "caption_segments").filter("error IS NULL").groupBy("video_id").agg(F.countDistinct("segment_id").alias("n"))
    both = p.join(n.select(F.col("video_id").alias("a"), F.col("n").alias("n_a")), "a", "left").join(n.select(F.col("video_id").alias("b"), F.col("n").alias("n_b")), "b", "left")
    known = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    return both.select("a", "b", F.when(known, r6(F.least("n_a", "n_b") / F.greatest("n_a", "n_b"))).alias("size_ratio"))


def directed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "a", "b", "env_score", "label")
    d = P.directed(v, [("a", "b")])
    span = lambda c: F.split(F.substring_index(c, ":", -1), "-")[0].cast("double")
    same = F.substring_index("a", ":", 1) == F.substring_index("b", ":", 1)
    return d.select("a", "b", "env_score", "label", same.alias("same_recording"), F.when(same, F.abs(span("a") - span("b"))).alias("time_gap_s"))


def hamming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.pack_bits(V.doubles(F.col("embedding"))).alias("word"))
    return P.hamming_links(e, "vec_id", "word", 8)


def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distinct_verdicts(spark, sf_dir, "a", "b").distinct()
    s = latest_segments(spark, sf_dir, "phash", "phash_ts")
    r = overlap_of(attach_pair(p, s, "segment_id"))
    dup = D.is_duplicate(F.col("overlap_seconds"), F.col("fraction_of_a"), F.col("fraction_of_b"))
    return r.select("a", "b", *[r6(F.col(c)).alias(c) for c in ("overlap_seconds", "offset_seconds", "fraction_of_a", "fraction_of_b")], "matched_frames", dup.alias("duplicate"))


def duplicate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored overlap records that count as one source, and those too weak for that."""
    v = distinct_verdicts(spark, sf_dir, "a", "b", "dup").filter("dup IS NOT NULL AND dup.overlap_seconds > 0")
    dup = D.is_duplicate(F.col("dup.overlap_seconds"), F.col("dup.fraction_of_a"), F.col("dup.fraction_of_b"))
    return v.select("a", "b", dup.alias("duplicate"), D.notes((~dup, "weak overlap")).alias("notes"))


def verdict_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "a", "b", "env_score", "task_score")
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return v.select("a", "b", D.percentile_verdict(ok("env_score"), ok("task_score")).alias("by_place"), D.percentile_verdict(ok("env_score"), ok("task_score"), use_task=True).alias("by_both"))


def verdict_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full comparison: percentile (or a scaled raw score, with a note), duplicates first, notes.

    A calibrated pair without a null model of both sides' encoder has a null percentile.
    """
    v = distinct_verdicts(spark, sf_dir, "a", "b", "calibrated", "raw", "dup").withColumn("raw_ok", F.when(F.abs("raw.env_raw") <= 1, F.col("raw.env_raw")))
    v = with_null_model(spark, sf_dir, v, "env_raw", "quantiles").withColumn("cal", F.coalesce("calibrated", F.lit(False)))
    pct = F.when(F.col("cal"), F.when(F.col("quantiles").isNotNull(), V.grid_percentile(F.col("raw_ok"), F.col("quantiles")))).otherwise(D.uncalibrated(F.col("raw_ok")))
    v = v.withColumn("env", F.when(F.col("raw_ok").isNotNull(), F.round(pct, 6))).withColumn("duplicate", D.is_duplicate(F.col("dup.overlap_seconds"), F.col("dup.fraction_of_a"), F.col("dup.fraction_of_b")))
    label = F.when(F.col("duplicate"), "DUPLICATE_SOURCE").otherwise(D.percentile_verdict(F.col("env"), F.lit(None).cast("double")))
    notes = D.notes((~F.col("cal"), "uncalibrated"), (F.col("raw.task_cos").isNull(), "no task reading"), (~F.col("duplicate") & (F.col("dup.overlap_seconds") > 0), "weak overlap"))
    return v.select("a", "b", "env", label.alias("label"), F.array_join(notes, "; ").alias("notes"))


def keep_drop_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = distinct_verdicts(spark, sf_dir, "label")
    return v.groupBy(D.kept(F.col("label")).alias("keep"), "label").agg(F.count("*").alias("n"))


def verdict_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_pairs").select("video_a", "video_b", "run_at", "env_raw").distinct()
    return t.select("video_a", "video_b", "run_at", D.calibrated_verdict(F.col("env_raw")).alias("verdict"))


def verdict_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_pairs").select("video_a", "video_b", "run_at", "task_sim", "task_threshold", "verdict_calibrated").distinct()
    q = (F.col("verdict_calibrated"), F.col("task_sim"), F.col("task_threshold"))
    return t.select("video_a", "video_b", "run_at", D.quadrant(*q).alias("quadrant"), D.resolved_quadrant(*q).alias("resolved"))


def quadrant_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = verdict_quadrant(spark, sf_dir)
    c = q.groupBy("quadrant", "resolved").agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("total")))
    return c.join(total).select("quadrant", "resolved", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_CLEANED = "prs AS (SELECT DISTINCT video_a AS a, video_b AS b FROM task_pairs WHERE video_a IS NOT NULL AND video_b IS NOT NULL)"
_STRATA = f"""{_CLEANED}, strata AS (SELECT a, b, CASE WHEN p.environment_l1 IS NULL OR q.environment_l1 IS NULL THEN '?' WHEN p.environment_l1 <> q.environment_l1 THEN 'diff_industry'
  WHEN p.session_key = q.session_key AND abs(p.ordinal - q.ordinal) <= 1 THEN 'same_session_adjacent' WHEN p.session_key = q.session_key THEN 'same_session_distant'
  WHEN p.site = q.site THEN 'same_site_diff_session' ELSE 'same_industry_diff_site' END AS stratum FROM prs LEFT JOIN recordings p ON a = p.video_id LEFT JOIN recordings q ON b = q.video_id)"""
_DUP = "coalesce(dup.overlap_seconds >= 2 AND greatest(dup.fraction_of_a, dup.fraction_of_b) >= 0.5, false)"
_QUAD = lambda env: f"""CASE WHEN task_sim IS NULL OR isnan(task_sim) THEN 'NO_TASK_DATA' WHEN {env} IS NULL OR {env} = '' THEN '' WHEN {env} = 'BORDERLINE' THEN 'BORDERLINE_ENV'
  WHEN {env} = 'SAME_ENV' AND task_sim >= task_threshold THEN 'REDUNDANT' WHEN {env} = 'SAME_ENV' THEN 'SAME_PLACE_NEW_TASK' WHEN task_sim >= task_threshold THEN 'SAME_TASK_NEW_PLACE' ELSE 'DISTINCT' END"""  # noqa: E731
_QUADS = f"""quads AS (SELECT video_a, video_b, run_at, {_QUAD('verdict_calibrated')} AS quadrant, {_QUAD("(CASE WHEN verdict_calibrated = 'BORDERLINE' THEN 'DIFFERENT_ENV' ELSE verdict_calibrated END)")} AS resolved
  FROM (SELECT DISTINCT video_a, video_b, run_at, task_sim, task_threshold, verdict_calibrated FROM task_pairs))"""
_WORDS = """words AS (SELECT vec_id, CAST(list_sum([CASE WHEN e[i + 1] > m THEN CAST(1 AS HUGEINT) << i ELSE 0 END for i in range(1, 64)]) - CASE WHEN e[64] > m THEN CAST(1 AS HUGEINT) << 64 ELSE 0 END AS BIGINT) AS word
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_sort(embedding[2:64]::DOUBLE[])[32] AS m FROM embeddings))"""

QUERIES = {
    f.__name__: f for f in (unordered_pairs, window_pairs, pair_sample, blocked_pairs, stratified_pairs, certain_negatives, metadata_join, coverage_join, directed_pairs, hamming_links,
                            source_overlap, duplicate_source, verdict_percentile, verdict_compare, keep_drop_tally, verdict_three_way, verdict_quadrant, quadrant_tally)
}
ORACLES = {
    "unordered_pairs": """WITH d AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM d GROUP BY ALL),
      v AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label)
      SELECT p.label AS a, q.label AS b, round(list_dot_product(p.v, q.v) / ((sqrt(list_dot_product(p.v, p.v)) + 1e-8) * (sqrt(list_dot_product(q.v, q.v)) + 1e-8)), 6) + 0.0 AS cosine FROM v p JOIN v q ON p.label < q.label""",
    "window_pairs": f"WITH {_CLEANED}, w AS (SELECT DISTINCT video_id, segment_id FROM signatures) SELECT a, b, p.segment_id AS window_a, q.segment_id AS window_b FROM prs JOIN w p ON a = p.video_id JOIN w q ON b = q.video_id",
    "pair_sample": f"WITH p AS (SELECT DISTINCT a, b FROM verdicts) SELECT a, b FROM p WHERE split_part(a, ':', 1) <> split_part(b, ':', 1) ORDER BY md5('0|' || a || '|' || b), a, b LIMIT {SAMPLE}",
    "blocked_pairs": "WITH r AS (SELECT coalesce(session_key, 'UNKNOWN') AS block, video_id FROM recordings) SELECT p.block, p.video_id AS a, q.video_id AS b FROM r p JOIN r q ON p.block = q.block AND p.video_id < q.video_id",
    "stratified_pairs": f"WITH {_STRATA} SELECT a, b, stratum FROM strata",
    "certain_negatives": f"WITH {_STRATA} SELECT a, b FROM strata WHERE stratum = 'diff_industry' AND a <> b ORDER BY md5('negatives|' || a || '|' || b), a, b LIMIT {SAMPLE}",
    "metadata_join": """SELECT s.segment_id, coalesce(site, 'UNKNOWN') AS site, coalesce(job_family, 'UNKNOWN') AS job_family FROM (SELECT DISTINCT segment_id, video_id FROM signatures) s LEFT JOIN recordings USING (video_id)""",
    "coverage_join": f"""WITH {_CLEANED}, n AS (SELECT video_id, count(DISTINCT segment_id) AS n FROM caption_segments WHERE error IS NULL GROUP BY 1)
      SELECT a, b, CASE WHEN p.n IS NOT NULL AND q.n IS NOT NULL THEN round(least(p.n, q.n) / greatest(p.n, q.n), 6) + 0.0 END AS size_ratio FROM prs LEFT JOIN n p ON a = p.video_id LEFT JOIN n q ON b = q.video_id""",
    "directed_pairs": f"""WITH {VERD}, d AS (SELECT a, b, env_score, label FROM verd UNION ALL SELECT b, a, env_score, label FROM verd), s AS (SELECT *, split_part(a, ':', 1) = split_part(b, ':', 1) AS same FROM d)
      SELECT a, b, env_score, label, same AS same_recording, CASE WHEN same THEN abs(CAST(split_part(split_part(a, ':', 2), '-', 1) AS DOUBLE) - CAST(split_part(split_part(b, ':', 2), '-', 1) AS DOUBLE)) END AS time_gap_s FROM s""",
    "hamming_links": f"""WITH {_WORDS} SELECT p.vec_id, p.word, (SELECT count(*) FROM words w WHERE w.word = p.word) AS class_size, count(q.vec_id) AS n_links
      FROM words p LEFT JOIN words q ON p.vec_id <> q.vec_id AND bit_count(xor(p.word, q.word)) <= 8 GROUP BY p.vec_id, p.word""",
    "source_overlap": f"""WITH {SEG}, prs AS (SELECT DISTINCT a, b FROM verdicts), h AS (SELECT segment_id, unnest(range(0, len(phash))) AS pos, unnest(phash) AS h, unnest(phash_ts) AS t FROM seg WHERE phash IS NOT NULL),
      n AS (SELECT segment_id, len(phash) AS n, CASE WHEN len(phash) > 1 THEN list_median([phash_ts[i + 1] - phash_ts[i] for i in range(1, len(phash))]) ELSE 0.5 END AS step FROM seg WHERE phash IS NOT NULL),
      m AS (SELECT a, b, p.pos AS i, q.pos AS j, CAST(round_even((q.t - p.t) / 0.5, 0) AS BIGINT) AS bin FROM prs JOIN h p ON a = p.segment_id JOIN h q ON b = q.segment_id WHERE bit_count(xor(p.h, q.h)) <= 8),
      v AS (SELECT a, b, bin, count(*) AS votes FROM m GROUP BY a, b, bin QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY count(*) DESC, bin) = 1),
      w AS (SELECT m.* FROM m JOIN v USING (a, b, bin) WHERE votes >= 3),
      ra AS (SELECT a, b, max(c) AS run FROM (SELECT a, b, g, count(*) AS c FROM (SELECT *, sum(f) OVER (PARTITION BY a, b ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY a, b ORDER BY i) > 2 THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT a, b, i FROM w))) GROUP BY ALL) GROUP BY ALL),
      rb AS (SELECT a, b, max(c) AS run FROM (SELECT a, b, g, count(*) AS c FROM (SELECT *, sum(f) OVER (PARTITION BY a, b ORDER BY j) AS g FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY a, b ORDER BY j) > 2 THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT a, b, j FROM w))) GROUP BY ALL) GROUP BY ALL),
      r AS (SELECT a, b, ra.run * x.step AS o, bin * 0.5::DOUBLE AS s, votes, ra.run / x.n AS fa, rb.run / y.n AS fb FROM ra JOIN rb USING (a, b) JOIN v USING (a, b) JOIN n x ON a = x.segment_id JOIN n y ON b = y.segment_id WHERE least(ra.run, rb.run) >= 3)
      SELECT p.a, p.b, round(coalesce(o, 0), 6) + 0.0 AS overlap_seconds, round(coalesce(s, 0), 6) + 0.0 AS offset_seconds, round(coalesce(fa, 0), 6) + 0.0 AS fraction_of_a, round(coalesce(fb, 0), 6) + 0.0 AS fraction_of_b,
        CAST(coalesce(votes, 0) AS INTEGER) AS matched_frames, coalesce(o >= 2 AND greatest(fa, fb) >= 0.5, false) AS duplicate
      FROM prs p JOIN seg x ON p.a = x.segment_id JOIN seg y ON p.b = y.segment_id LEFT JOIN r ON p.a = r.a AND p.b = r.b""",
    "duplicate_source": f"WITH {VERD} SELECT a, b, {_DUP} AS duplicate, CASE WHEN {_DUP} THEN CAST([] AS VARCHAR[]) ELSE ['weak overlap'] END AS notes FROM verd WHERE dup IS NOT NULL AND dup.overlap_seconds > 0",
    "verdict_percentile": f"""WITH {VERD}, v AS (SELECT a, b, coalesce(env_score >= 60 AND NOT isnan(env_score), false) AS e, coalesce(task_score >= 95 AND NOT isnan(task_score), false) AS t FROM verd)
      SELECT a, b, CASE WHEN e THEN 'REDUNDANT' ELSE 'NOVEL' END AS by_place, CASE WHEN e AND t THEN 'REDUNDANT' WHEN e THEN 'SAME_PLACE_NEW_TASK' WHEN t THEN 'SAME_TASK_NEW_PLACE' ELSE 'NOVEL' END AS by_both FROM v""",
    "verdict_compare": f"""WITH {VERD}, {SEG}, {NULLS},
      v AS (SELECT a, b, dup, raw, coalesce(calibrated, false) AS cal, CASE WHEN abs(raw.env_raw) <= 1 AND NOT isnan(raw.env_raw) THEN raw.env_raw END AS x, q, {_DUP} AS d FROM nulls), k AS (SELECT *, len([g for g in q if g <= x]) AS k FROM v),
      e AS (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN NOT cal THEN round(100 * (x + 1) / 2, 6) WHEN q IS NULL THEN NULL WHEN k = 0 THEN 0.0 WHEN k >= len(q) THEN 100.0 ELSE round((k - 1 + (x - q[k]) / (q[k + 1] - q[k])) / 200 * 100, 6) END AS env FROM k)
      SELECT a, b, env, CASE WHEN d THEN 'DUPLICATE_SOURCE' WHEN env >= 60 THEN 'REDUNDANT' ELSE 'NOVEL' END AS label,
        concat_ws('; ', CASE WHEN NOT cal THEN 'uncalibrated' END, CASE WHEN raw.task_cos IS NULL THEN 'no task reading' END, CASE WHEN NOT d AND dup.overlap_seconds > 0 THEN 'weak overlap' END) AS notes FROM e""",
    "keep_drop_tally": f"""WITH {VERD} SELECT CASE WHEN label IN ('NOVEL', 'SAME_PLACE_NEW_TASK', 'SAME_TASK_NEW_PLACE') THEN true WHEN label IN ('REDUNDANT', 'DUPLICATE_SOURCE') THEN false END AS keep, label, count(*) AS n FROM verd GROUP BY ALL""",
    "verdict_three_way": """SELECT video_a, video_b, run_at, CASE WHEN env_raw IS NULL OR isnan(env_raw) THEN NULL WHEN env_raw >= 0.4920 THEN 'SAME_ENV' WHEN env_raw >= 0.4666 THEN 'BORDERLINE' ELSE 'DIFFERENT_ENV' END AS verdict
      FROM (SELECT DISTINCT video_a, video_b, run_at, env_raw FROM task_pairs)""",
    "verdict_quadrant": f"WITH {_QUADS} SELECT * FROM quads",
    "quadrant_tally": f"WITH {_QUADS} SELECT quadrant, resolved, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM quads GROUP BY ALL",
}
