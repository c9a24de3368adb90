"""Roll-ups of directed pairs: per segment, per pair of recordings, per recording and for the whole index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decide import ENV_PERCENTILE, coverage_verdict


def segment_rows(directed: DataFrame, picks: DataFrame) -> DataFrame:
    """Per segment ``a``: nearest other, largest and mean score within and across recordings, rank and gain of its pick.

    ``directed`` has ``a, b, env, task, label, same`` (within one recording); ``picks`` has ``a, rank, gain``.
    """
    near = F.min_by(F.struct("b", "env", "task", "label"), F.struct(F.coalesce(-F.col("env"), F.lit(float("inf"))), F.col("b")))
    inside, across = F.when(F.col("same"), F.col("env")), F.when(~F.col("same"), F.col("env"))
    g = directed.groupBy("a").agg(near.alias("n"), F.max(inside).alias("max_same"), F.max(across).alias("max_cross"), F.avg(inside).alias("mean_same"), F.avg(across).alias("mean_cross"))
    r = g.join(picks, "a", "left")
    return r.select("a", F.col("n.b").alias("nearest"), F.col("n.env").alias("nearest_env"), F.col("n.task").alias("nearest_task"), F.col("n.label").alias("nearest_label"),
                    "max_same", "max_cross", "mean_same", "mean_cross", "rank", F.coalesce("gain", F.lit(0.0)).alias("gain"))


def recording_pairs(directed: DataFrame, threshold: float = ENV_PERCENTILE) -> DataFrame:
    """Per pair of recordings (``ra < rb``): coverage each way, mean best match each way, mean and largest score, verdict.

    ``directed`` has ``a, b, ra, rb, env`` with both directions of every pair.
    """
    best = directed.filter("ra <> rb").groupBy("ra", "rb", "a").agg(F.max("env").alias("best"), F.sum("env").alias("s"), F.count("env").alias("n"))
    one = best.groupBy("ra", "rb").agg(F.count("*").alias("segments"), F.avg(F.when(F.col("best") >= threshold, 1.0).otherwise(0.0)).alias("covered"), F.avg("best").alias("mean_best"),
                                       F.max("best").alias("top"), (F.sum("s") / F.sum("n")).alias("mean_env"))
    back = one.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"), F.col("segments").alias("segments_b"), F.col("covered").alias("covered_b"), F.col("mean_best").alias("mean_best_b"))
    r = one.filter("ra < rb").join(back, ["ra", "rb"])
    return r.select("ra", "rb", F.col("segments").alias("segments_a"), "segments_b", F.col("covered").alias("covered_a"), "covered_b", F.col("mean_best").alias("mean_best_a"), "mean_best_b",
                    "mean_env", F.col("top").alias("max_env"), coverage_verdict(F.col("covered"), F.col("covered_b")).alias("verdict"))


def session_summary(directed: DataFrame, members: DataFrame, picks: DataFrame, half: Column) -> DataFrame:
    """Per group ``ra``: members, mean scores within and across groups on both axes, and members picked in the first half."""
    g = directed.groupBy("ra").agg(*[F.avg(F.when(F.col("ra") == F.col("rb") if w else F.col("ra") != F.col("rb"), F.col(c))).alias(f"{c}_{'within' if w else 'cross'}") for c in ("env", "task") for w in (True, False)])
    m = members.join(picks, "a", "left").groupBy("ra").agg(F.count("*").alias("segments"), F.sum(F.when(F.col("rank") <= half, 1).otherwise(0)).alias("picked"))
    return m.join(g, "ra", "left")
