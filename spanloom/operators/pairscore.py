"""Whole scores of pairs of segments: nine metrics, similarity of a kind, and scores within episodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from ..runtime import cut
from .calibrate import null_grid
from .features import ENV_WEIGHTS, TASK_WEIGHTS, attach_pair, fit_whitener, fuse, whitener_rows
from .kernels import pair_dtw, pair_env_scores
from .pairs import blocked_pairs

#: Weights of the environment metrics within an episode.
EPISODE_WEIGHTS = {"env_chamfer": 0.50, "env_cos": 0.35, "env_bhat_sim": 0.15}
MOTION = ("motion_pooled", "motion_seq", "rhythm", "period_s", "period_strength")


def env_scores(pairs: DataFrame, segments: DataFrame, whitener: DataFrame | None = None, key: str = "segment_id") -> DataFrame:
    """``a, b, env_cos, env_chamfer, env_bhat_sim`` of pairs of one encoder with frames on both sides.

    ``segments`` has ``key, app_encoder, app_frames``; ``whitener`` (``fit_whitener``) standardises mean and frames before
    cosine and chamfer, but not before the third metric, which measures the spread itself.
    """
    segs = segments.filter(F.size("app_frames") > 0).select(key, "app_encoder", "app_frames")
    met = attach_pair(pairs, segs, key).filter("app_encoder_a = app_encoder_b")
    if whitener is None:
        return pair_env_scores(met)
    stats = {r["app_encoder"]: (np.array(r["mu"]), np.array(r["sd"])) for r in whitener_rows(whitener, "app_encoder").collect()}  # one row an encoder
    return pair_env_scores(met, pairs.sparkSession.sparkContext.broadcast(stats))


def pair_scores(pairs: DataFrame, segments: DataFrame, whitener: DataFrame | None = None, env_weights: dict[str, float] | None = None,
                task_weights: dict[str, float] | None = None, key: str = "segment_id") -> DataFrame:
    """``a, b``, the seven metrics of both tiers, ``env_raw`` and ``task_raw`` of distinct pairs.

    ``segments`` has ``key, app_encoder, app_frames`` and the columns of ``MOTION``.  A pair with a side without
    ``motion_pooled`` has zeros in the motion tier.  Pairs of different encoders, or without frames, are left out.
    """
    env = env_scores(pairs, segments, whitener, key)
    moved = attach_pair(pairs, segments.filter(F.col("motion_pooled").isNotNull()).select(key, *MOTION), key)
    dtw = pair_dtw(moved, "motion_seq_a", "motion_seq_b")
    cols = {
        "task_cos": V.cosine(F.col("motion_pooled_a"), F.col("motion_pooled_b")),
        "rhythm_cos": V.hellinger_cosine(F.col("rhythm_a"), F.col("rhythm_b")),
        "period_agree": V.period_agreement(F.col("period_s_a"), F.col("period_s_b"), F.col("period_strength_a"), F.col("period_strength_b")),
    }
    task = moved.select("a", "b", *[c.alias(k) for k, c in cols.items()]).join(dtw.select("a", "b", (1 - F.col("dtw_cost")).alias("task_dtw_sim")), ["a", "b"])
    r = env.join(task, ["a", "b"], "left").fillna(0.0, [*TASK_WEIGHTS])
    return r.select("a", "b", *ENV_WEIGHTS, *TASK_WEIGHTS, fuse(weights=env_weights or ENV_WEIGHTS).alias("env_raw"), fuse(weights=task_weights or TASK_WEIGHTS).alias("task_raw"))


def similarity(scores: DataFrame, env_grid: Column | None = None, task_grid: Column | None = None) -> DataFrame:
    """Adds ``env, task, fused`` between 0 and 1: the place in a null model's grid, or half of score + 1 without one.

    Scores that are null or NaN give null; ``fused`` is the mean of both.
    """
    def scaled(x: Column, grid: Column | None) -> Column:
        plain = F.when(~F.isnan(x), (x + 1) / 2)
        return plain if grid is None else F.when(grid.isNull(), plain).otherwise(V.grid_place(x, grid))

    s = scores.withColumn("env", scaled(F.col("env_raw"), env_grid)).withColumn("task", scaled(F.col("task_raw"), task_grid))
    return s.withColumn("fused", (F.col("env") + F.col("task")) / 2)


def episode_scores(segments: DataFrame, null_pairs: DataFrame, episode: str, key: str = "segment_id") -> DataFrame:
    """``episode, a, b``, the environment metrics, ``env_raw`` and ``env_percentile`` of all pairs within an episode.

    Whitener and null model are those of all segments together: the whitener is fitted on all frames, the null model on the
    scores of ``null_pairs`` (``a, b``, of different episodes).  A segment without an episode is in that named UNKNOWN.
    """
    raw = fuse(weights=EPISODE_WEIGHTS)
    w = fit_whitener(segments.filter(F.size("app_frames") > 0), "app_encoder", "app_frames")
    within = blocked_pairs(segments, key, episode).withColumnRenamed("block", "episode")
    # both sets of pairs are scored in one pass
    asked = within.select("a", "b").unionByName(null_pairs.select("a", "b"))
    scored = cut(env_scores(asked, segments, w, key).withColumn("env_raw", raw).join(within, ["a", "b"], "left"))
    grid = F.broadcast(null_grid(scored.filter("episode IS NULL").select(F.lit("env_raw").alias("metric"), F.col("env_raw").alias("value")), ["metric"], "value").select("quantiles"))  # one row
    r = scored.filter("episode IS NOT NULL").join(grid, how="left")
    return r.select("episode", "a", "b", *EPISODE_WEIGHTS, "env_raw", V.grid_percentile(F.col("env_raw"), F.col("quantiles")).alias("env_percentile"))
