"""Windows, runs and segmentation of time lines and ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .intervals import SHARD_ROWS, huge_entities, merge_intervals, null_safe, shard_of, to_millis

EPS = 1e-6


def hop_windows(df: DataFrame, duration: str, seconds: float, hop: float = 0.0, drop_shorter: float = 0.0) -> DataFrame:
    """One row per window: ``w0, w1, whole`` beside the columns of ``df``.

    Windows start every ``hop`` seconds (0: one after the other) and are clipped at the end; a clipped
    one stays if it is at least ``drop_shorter`` long or the first.  Without a window length, or with
    one not below the duration, the whole record is one window.  Null and non-positive durations give none.
    """
    d = F.col(duration)
    step = hop if hop > 0 else seconds
    whole = F.lit(seconds <= 0) | (d <= seconds)
    last = F.greatest(F.ceil((d - EPS) / step) - 1, F.lit(0)) if step > 0 else F.lit(0)
    starts = F.when(whole, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: i * float(step)))
    r = df.filter(d.isNotNull() & ~F.isnan(d) & (d > 0)).withColumn("w0", F.explode(starts)).withColumn("whole", whole)
    r = r.withColumn("w1", F.when(F.col("whole"), d).otherwise(F.least(F.col("w0") + seconds, d)))
    span = F.col("w1") - F.col("w0")
    return r.filter(F.col("whole") | (span >= seconds - EPS) | (span >= drop_shorter) | (F.col("w0") == 0.0))


def grid_chunks(df: DataFrame, start: Column, end: Column, chunk: float) -> DataFrame:
    """Whole chunks of fixed length from a start offset; what is left at the end is not covered."""
    n = F.floor((end - start) / chunk).cast("int")
    r = df.withColumn("__n", n).filter("__n >= 1").withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return r.withColumn("c0", start + F.col("chunk_no") * chunk).withColumn("c1", start + (F.col("chunk_no") + 1) * chunk)


def frame_windows(df: DataFrame, values: str, size: int, stride: int) -> DataFrame:
    """``start, window``: windows of ``size`` elements every ``stride``; a short input is filled up with its
    last element, a window cut off at the end is dropped.  Null and empty inputs give none."""
    v, n = F.col(values), F.size(values)
    padded = F.when(n < size, F.concat(v, F.array_repeat(F.element_at(v, -1), F.lit(size) - n))).otherwise(v)
    r = df.filter(n > 0).withColumn("__p", padded).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("__p") - size, F.lit(stride))))
    return r.withColumn("window", F.slice("__p", F.col("start") + 1, F.lit(size))).drop("__p")


def islands(df: DataFrame, keys: list[str], position: str, gap: int, total: int | None = None, huge_min: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """Runs of distinct integer positions whose neighbours are at most ``gap`` apart: ``keys, first, last, n``.

    Null positions do not count and repeated ones count once.  A huge entity is cut into shards at
    quantiles of its positions, and runs that meet at a border are joined.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(position).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(position).cast("bigint").alias("p")).distinct()
    if total is None:
        total = df.count()
    huge = huge_entities(rows, own, total, "p", huge_min, shards)
    if huge is None:
        rows = rows.withColumn("shard", F.lit(-1))
    else:
        rows = rows.alias("a").join(F.broadcast(huge.alias("b")), null_safe("a", "b", own), "left").select(
            "a.*", F.when(F.col("cuts").isNull(), -1).otherwise(shard_of(F.col("p"), F.col("cuts"))).alias("shard"))
    w = Window.partitionBy(*own, "shard").orderBy("p")
    new = F.when(F.col("p") - F.lag("p").over(w) <= gap, 0).otherwise(1)
    local = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(*own, "shard", "run").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("n"))
    names = [F.col(o).alias(k) for k, o in zip(keys, own)]
    if huge is None:
        return local.select(*names, "first", "last", "n")
    v = Window.partitionBy(*own, "shard").orderBy("run")
    local = cut(local.withColumn("edge", (F.col("shard") >= 0) & ((F.col("run") == 1) | F.lead("run").over(v).isNull())))
    u = Window.partitionBy(*own).orderBy("first")
    chained = local.filter("edge").withColumn("new", F.when(F.col("first") - F.lag("last").over(u) <= gap, 0).otherwise(1)).withColumn("chain", F.sum("new").over(u))
    joined = chained.groupBy(*own, "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return local.filter("NOT edge").select(*names, "first", "last", "n").unionByName(joined.select(*names, "first", "last", "n"))


def longest_run(df: DataFrame, keys: list[str], position: str, gap: int, total: int | None = None) -> DataFrame:
    """Number of positions of every entity's longest run."""
    return islands(df, keys, position, gap, total).groupBy(*keys).agg(F.max("n").alias("longest"))


def uncovered(spans: DataFrame, records: DataFrame, key: str, duration: str, t0: str, t1: str, least_s: float = 3.0) -> DataFrame:
    """``key, start_ms, end_ms``: stretches of every record that no span covers, at least ``least_s`` long.

    Records without spans are uncovered as a whole; a null or non-positive duration gives nothing.
    """
    r = records.select(F.col(key).alias("k"), to_millis(F.col(duration)).alias("d")).filter("k IS NOT NULL AND d > 0").groupBy("k").agg(F.max("d").alias("d"))
    timed = spans.filter(F.col(t0).isNotNull() & F.col(t1).isNotNull())
    s = timed.select(F.col(key).alias("k"), F.greatest(to_millis(F.col(t0)), F.lit(0)).alias("s"), to_millis(F.col(t1)).alias("e")).join(r, "k").select("k", "s", F.least("e", "d").alias("e"))
    # a mark of no length at either end makes the outer holes gaps like the others
    ends = r.select("k", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e")), F.struct(F.col("d").alias("s"), (F.col("d") + 1).alias("e")))).alias("x")).select("k", "x.*")
    merged = merge_intervals(s.unionByName(ends).toDF("k", "s_ms", "e_ms"), ["k"], None, 2**61)
    return merged.filter((F.col("kind") == "gap") & (F.col("end_ms") - F.col("start_ms") >= int(least_s * 1000))).select(F.col("k").alias(key), "start_ms", "end_ms")


def suppress_close(times: Column, least: float) -> Column:
    """Sorted times of which each is at least ``least`` after the last one kept."""
    start = F.array().cast("array<double>")
    far = lambda kept, t: (F.size(kept) == 0) | (t - F.element_at(F.concat(F.array(F.lit(-1e300)), kept), -1) >= least)
    return F.aggregate(F.array_sort(times), start, lambda kept, t: F.when(far(kept, t), F.concat(kept, F.array(t))).otherwise(kept))


def running_median(values: Column, width: int) -> Column:
    """Centred median of odd width, the ends being repeated."""
    half = (width | 1) // 2
    padded = F.concat(F.array_repeat(F.element_at(values, 1), half), values, F.array_repeat(F.element_at(values, -1), half))
    at = F.sequence(F.lit(1), F.size(values))
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(padded), lambda p: F.transform(at, lambda i: F.element_at(F.array_sort(F.slice(p, i, F.lit(2 * half + 1))), half + 1))), 0))


def weighted_window(values: Column, weights: list[float]) -> Column:
    """Centred weighted sum of odd width; outside the series counts as zero."""
    half = len(weights) // 2
    padded = F.concat(F.array_repeat(F.lit(0.0), half), values, F.array_repeat(F.lit(0.0), half))
    at = F.sequence(F.lit(1), F.size(values))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    one = lambda p, i: F.aggregate(F.zip_with(F.slice(p, i, F.lit(len(weights))), ws, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(padded), lambda p: F.transform(at, lambda i: one(p, i))), 0))


def fill_gaps(df: DataFrame, keys: list[str], position: str, value: str, longest: int, least: int = 16) -> DataFrame:
    """Adds ``filled``: missing values interpolated between their neighbours, or equal to the only one at an end.

    Gaps of more than ``longest`` samples stay missing; a series with fewer than ``least`` values has none filled.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    ok = F.when(~F.isnan(F.col(value)), F.col(value))
    at = F.when(ok.isNotNull(), F.col(position))
    r = df.withColumn("__p0", F.last(at, True).over(back)).withColumn("__v0", F.last(ok, True).over(back)).withColumn("__p1", F.first(at, True).over(ahead)).withColumn("__v1", F.first(ok, True).over(ahead))
    r = r.withColumn("__n", F.count(ok).over(Window.partitionBy(*keys))).withColumn("__lo", F.min(position).over(Window.partitionBy(*keys))).withColumn("__hi", F.max(position).over(Window.partitionBy(*keys)))
    hole = F.coalesce(F.col("__p1"), F.col("__hi") + 1) - F.coalesce(F.col("__p0"), F.col("__lo") - 1) - 1
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col(position) - F.col("__p0")) / (F.col("__p1") - F.col("__p0"))
    filled = F.when(F.col("__n") < least, None).when(ok.isNotNull(), ok).when(hole <= longest, F.coalesce(line, "__v0", "__v1"))
    return r.withColumn("filled", filled).drop("__p0", "__v0", "__p1", "__v1", "__n", "__lo", "__hi")


def boundary_runs(times: Column, period: Column, tolerance: float = 1.8) -> Column:
    """Sorted times as runs without a pause of more than ``tolerance`` periods; runs of one are dropped."""
    limit = F.greatest(period, F.lit(EPS)) * tolerance
    start = F.array().cast("array<array<double>>")
    last = lambda runs: F.element_at(runs, -1)
    grow = lambda runs, t: F.when(F.size(runs) == 0, F.array(F.array(t))).when(
        t - F.element_at(last(runs), -1) > limit, F.concat(runs, F.array(F.array(t)))).otherwise(F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.concat(last(runs), F.array(t)))))
    return F.filter(F.aggregate(F.array_sort(times), start, grow), lambda r: F.size(r) >= 2)


def cycle_segments(df: DataFrame, runs: str, cycles: int) -> DataFrame:
    """``t0, t1, period_s``: segments of exactly ``cycles`` whole cycles from each run of boundaries."""
    r = df.withColumn("__r", F.explode(runs)).filter(F.size("__r") > cycles)
    r = r.withColumn("__i", F.explode(F.sequence(F.lit(1), F.size("__r") - cycles, F.lit(cycles))))
    r = r.withColumn("t0", F.element_at("__r", F.col("__i"))).withColumn("t1", F.element_at("__r", F.col("__i") + cycles))
    return r.withColumn("period_s", (F.col("t1") - F.col("t0")) / cycles).drop("__r", "__i")


def target_cuts(run: list[float], target: float) -> list[tuple[float, float, int]]:
    """Segments of one run of boundaries, each ending at the boundary nearest to ``target`` seconds on."""
    out, here = [], 0
    while here < len(run) - 1:
        over = next((j for j in range(here + 1, len(run)) if run[j] - run[here] >= target), len(run) - 1)
        end = over
        if over - 1 > here and target - (run[over - 1] - run[here]) < abs(run[over] - run[here] - target):
            end = over - 1
        out.append((run[here], run[end], end - here))
        here = end
    return out


def target_segments(df: DataFrame, key: str, runs: str, target: float) -> DataFrame:
    """``key, t0, t1, n_cycles, period_s`` with cuts on cycle boundaries near a target duration."""
    kind = dict(df.dtypes)[key]

    def walk(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = [(k, a, z, n, (z - a) / max(n, 1)) for k, rs in zip(b[key], b[runs]) for r in (rs if rs is not None else ()) for a, z, n in target_cuts(list(r), target)]
            yield pd.DataFrame(rows, columns=[key, "t0", "t1", "n_cycles", "period_s"])

    return df.select(key, runs).mapInPandas(walk, f"`{key}` {kind}, t0 double, t1 double, n_cycles int, period_s double")
