"""Mergeable percentiles: counts in signed logarithmic buckets of fixed relative width."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import grid_parts

#: Relative error of an order statistic.
ALPHA = 0.005
#: Points of the percentile grid: 0, 0.5, 1, ... 100 percent.
POINTS = 201


def gamma(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def offset(alpha: float = ALPHA) -> int:
    """More than any bucket number of a double, so that keys of positive values are positive."""
    return math.ceil(746 / math.log(gamma(alpha))) + 1


def bucket_key(x: Column, alpha: float = ALPHA) -> Column:
    """Integer key of the bucket that holds ``x``, ordered like the values; null for null, NaN and infinities.

    Bucket ``i`` holds ``gamma^(i-1) < |x| <= gamma^i``; zero has its own bucket, so the relative
    error also holds for the smallest values.
    """
    number = F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma(alpha)))).cast("int") + F.lit(offset(alpha))
    fits = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(fits, F.when(x == 0, F.lit(0)).when(x > 0, number).otherwise(-number))


def bucket_value(key: Column, alpha: float = ALPHA) -> Column:
    """The value that stands for a bucket, at most ``alpha`` (relatively) from any value in it."""
    g = gamma(alpha)
    size = F.exp((F.abs(key) - F.lit(offset(alpha))) * F.lit(math.log(g))) * F.lit(2 / (g + 1))
    return F.when(key == 0, F.lit(0.0)).when(key > 0, size).otherwise(-size)


def sketch(keyed: DataFrame, groups: list[str], key: str = "bucket", count: str = "n") -> DataFrame:
    """Bucket counts ``groups, bucket, n`` of rows that already carry a bucket key; null keys do not count.

    Counts of equal buckets add up, whatever partition or day they come from (``merge``).
    """
    return keyed.filter(F.col(key).isNotNull()).groupBy(*groups, key).agg(F.count("*").alias(count))


def merge(sketches: DataFrame, groups: list[str], key: str = "bucket", count: str = "n") -> DataFrame:
    """Adds matching buckets; ``groups`` may be fewer than those the sketches were made by."""
    return sketches.groupBy(*groups, key).agg(F.sum(count).alias(count))


def percentiles(sketches: DataFrame, groups: list[str], alpha: float = ALPHA, points: int = POINTS,
                key: str = "bucket", count: str = "n") -> DataFrame:
    """``groups, n_values, quantiles`` with ``points`` percentiles from 0 to 100 percent per group.

    A percentile interpolates linearly between the two order statistics around it, like an exact
    percentile does.  Each order statistic is off by at most ``alpha`` times its size, so a result is
    off by at most ``alpha`` times the larger of the two.  A group has at most ``2 * offset + 1``
    buckets whatever its number of values.  Groups without values, and empty input, give no row.
    """
    g = points - 1
    w = Window.partitionBy(*groups).orderBy(key)
    ranked = (
        sketches.withColumn("__c", F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__m", F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1)
        .withColumn("__first", F.col("__c") - F.col(count)).withColumn("__last", F.col("__c") - 1)
    )
    one = "__m = 0"
    parts = grid_parts("__first", "__last", "__m", g)
    points_of = ranked.withColumn("__v", bucket_value(F.col(key), alpha)).select(
        *groups, (F.col("__m") + 1).alias("n_values"), "__v", F.explode(parts).alias("__p"))
    return (
        points_of.groupBy(*groups, "n_values", F.col("__p.j").alias("__j"))
        .agg(F.sum(F.col("__p.w") * F.col("__v")).alias("__q"))
        .groupBy(*groups, "n_values")
        .agg(F.array_sort(F.collect_list(F.struct("__j", "__q"))).alias("__qs"))
        .select(*groups, "n_values", F.col("__qs.__q").alias("quantiles"))
    )

