"""Pooling, whitening and pair scores of vector sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from .kernels import pair_env_scores

#: Frames after which a dimension's own variance outweighs the mean variance.
SHRINK = 40
ENV_WEIGHTS = {"env_cos": 0.50, "env_chamfer": 0.35, "env_bhat_sim": 0.15}
TASK_WEIGHTS = {"task_cos": 0.40, "task_dtw_sim": 0.30, "rhythm_cos": 0.20, "period_agree": 0.10}


def pool_frames(df: DataFrame, frames: str, mean: str = "mean", var: str = "var") -> DataFrame:
    """Adds the mean and the population variance of every dimension over a set of equally wide vectors."""
    f = F.transform(F.col(frames), V.doubles)
    n = F.size(f).cast("double")
    zero = F.transform(F.element_at(f, 1), lambda _: F.lit(0.0))
    sums = F.aggregate(f, zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    mu = F.transform(sums, lambda s: s / n)
    df = df.withColumn(mean, F.when(F.size(frames) > 0, mu))
    sq = F.aggregate(f, zero, lambda s, x: F.zip_with(s, F.zip_with(x, F.col(mean), lambda a, m: (a - m) * (a - m)), lambda a, b: a + b))
    return df.withColumn(var, F.when(F.size(frames) > 0, F.transform(sq, lambda s: s / n)))


def fit_whitener(df: DataFrame, group: str, frames: str) -> DataFrame:
    """Mean and shrunk standard deviation of every dimension over all frames of a group.

    The variance is drawn toward the mean variance of the group's dimensions, the more the fewer
    frames there are; a floor of a hundredth of the median deviation (and 0.001) keeps flat
    dimensions finite.  Returns ``group, dim, n, mu, sd``.
    """
    long = df.select(group, F.explode(frames).alias("f")).select(group, F.posexplode("f").alias("dim", "x"))
    stats = long.groupBy(group, "dim").agg(F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("mu"), F.var_pop(F.col("x").cast("double")).alias("var"))
    means = stats.groupBy(F.col(group).alias("__g")).agg(F.avg("var").alias("mv"))  # one row a group
    alpha = F.col("n") / (F.col("n") + SHRINK)
    shrunk = stats.join(F.broadcast(means), F.col(group).eqNullSafe(F.col("__g"))).select(group, "dim", "n", "mu", F.sqrt(alpha * F.col("var") + (1 - alpha) * F.col("mv")).alias("sd"))
    floors = shrunk.groupBy(F.col(group).alias("__g")).agg(F.expr("percentile(sd, 0.5)").alias("mid"))
    return shrunk.join(F.broadcast(floors), F.col(group).eqNullSafe(F.col("__g"))).select(
        group, "dim", "n", "mu", F.greatest("sd", F.lit(1e-3), F.col("mid") / 100).alias("sd"))


def alternate_whitener(df: DataFrame, group: str, frames: str) -> DataFrame:
    """Like ``fit_whitener``, but drawing deviations (not variances) to their mean, with the plain floor."""
    long = df.select(group, F.explode(frames).alias("f")).select(group, F.posexplode("f").alias("dim", "x"))
    stats = long.groupBy(group, "dim").agg(F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("mu"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    means = stats.groupBy(F.col(group).alias("__g")).agg(F.avg("s").alias("ms"))
    alpha = F.col("n") / (F.col("n") + SHRINK)
    return stats.join(F.broadcast(means), F.col(group).eqNullSafe(F.col("__g"))).select(
        group, "dim", "n", "mu", F.greatest(alpha * F.col("s") + (1 - alpha) * F.col("ms"), F.lit(1e-3)).alias("sd"))


def whitener_rows(stats: DataFrame, group: str) -> DataFrame:
    """One row per group with ordered arrays ``mu`` and ``sd``; as many rows as encoders, so it may be broadcast."""
    return stats.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd"))).alias("d")).select(group, F.col("d.mu").alias("mu"), F.col("d.sd").alias("sd"))


def fuse(scores: dict[str, F.Column] | None = None, weights: dict[str, float] | None = None) -> F.Column:
    """Weighted mean of components; a missing one counts as zero."""
    weights = weights or ENV_WEIGHTS
    scores = scores or {k: F.col(k) for k in weights}
    top = sum((F.coalesce(scores.get(k, F.lit(None).cast("double")), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    return top / sum(weights.values())


def attach_pair(pairs: DataFrame, side: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Both sides' columns beside every pair, with suffixes _a and _b; pairs without a side are left out."""
    left = side.select(*[F.col(c).alias(a if c == key else f"{c}_a") for c in side.columns])
    right = side.select(*[F.col(c).alias(b if c == key else f"{c}_b") for c in side.columns])
    return pairs.join(left, a).join(right, b)


def env_scores(pairs: DataFrame, segments: DataFrame, key: str = "segment_id") -> DataFrame:
    """Environment scores of given pairs; ``segments`` has ``key, app_encoder, app_frames``.

    Only pairs of the same encoder with frames on both sides are scored, in Arrow batches.
    """
    met = attach_pair(pairs, segments.filter(F.size("app_frames") > 0), key).filter("app_encoder_a = app_encoder_b")
    return pair_env_scores(met).withColumn("env_raw", fuse())
