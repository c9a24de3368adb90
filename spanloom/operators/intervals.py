"""Coverage of entities by overlapping spans: continuous periods and the gaps between them.

Spans are merged at two levels.  An entity with few spans is one group.  A huge entity is cut
into time shards at quantiles of its starts; spans are clipped into the shards, every shard is
merged on its own, and only the coverage that touches a shard's border is stitched afterwards.
No task ever sees all spans of a huge entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Rows of an entity from which on it is huge, and of each of its time shards: the size of a task does not grow with the data.
SHARD_ROWS = 20_000
#: Borders between time shards, at most, that are broadcast (some 40 MB); only beyond so many do shards grow.
MOST_BORDERS = 4_000_000


def to_millis(seconds: Column) -> Column:
    """Seconds rounded to whole milliseconds; NaN and infinities become null."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e15))
    return F.when(ok, F.round(seconds * 1000.0).cast("bigint"))


def shard_rows(total: int, least: int = SHARD_ROWS) -> int:
    """Rows of a time shard: ``least`` up to tens of billions of rows in all."""
    return max(least, 2 * total // MOST_BORDERS)


def huge_entities(spans: DataFrame, keys: list[str], total: int, start: str = "s_ms",
                  huge_min: int = SHARD_ROWS, shards: int | None = None) -> DataFrame | None:
    """``keys, cuts``: inner shard borders of every huge entity, or None if there is none.

    An entity of more than ``shard_rows`` rows is huge and gets a power of two of shards of about half to all of
    that many rows (or ``shards``, if given).  All together have at most ``2 * total / shard_rows`` borders, and so many
    are never more than ``MOST_BORDERS``: the relation has a proven bound and may be broadcast.
    """
    rows = shard_rows(total, huge_min)
    hot = spans.groupBy(*keys).count().filter(F.col("count") > rows).collect()
    if not hot:
        return None
    spark = spans.sparkSession
    schema = spans.select(*keys).schema
    classes: dict[int, list[tuple]] = {}
    for r in hot:
        classes.setdefault(shards or 1 << ((r["count"] - 1) // rows).bit_length(), []).append(tuple(r)[: len(keys)])
    cuts = []
    for n, members in classes.items():  # a pass for each power of two
        few = spark.createDataFrame(members, schema)
        here = spans.alias("a").join(F.broadcast(few.alias("b")), null_safe("a", "b", keys)).select("a.*")
        at = F.percentile_approx(start, [i / n for i in range(1, n)], max(10_000, 20 * n))
        cuts += here.groupBy(*keys).agg(at.alias("cuts")).withColumn("cuts", F.array_sort(F.array_distinct("cuts"))).collect()
    return spark.createDataFrame([tuple(r) for r in cuts], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, cuts array<bigint>")


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    """Equality of all keys under two aliases; null equals null."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def shard_of(value: Column, cuts: Column) -> Column:
    """Number of borders at or below ``value``, found by halving; null without borders."""
    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(cuts, mid) <= value
        return F.when(s["lo"] < s["hi"], F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))).otherwise(s)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve, lambda s: s["lo"])
    return F.when(F.size(cuts) == 0, 0).otherwise(found)


def merge_intervals(spans: DataFrame, keys: list[str], total: int | None = None, max_gap_ms: int = 3_600_000,
                    huge_min: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """Continuous periods of every entity and the gaps between consecutive periods.

    ``spans`` has ``keys``, ``s_ms`` and ``e_ms`` (BIGINT); other columns are ignored.  Rows with
    a null time or ``e_ms <= s_ms`` cover nothing and are left out; a null key is a key like any
    other.  Spans that overlap or touch form one period, repeated spans change nothing.  A gap
    longer than ``max_gap_ms`` is not listed.  An empty input gives an empty result.

    Returns ``keys, kind ('period' or 'gap'), start_ms, end_ms``.
    """
    # private names keep clashing input columns apart
    own = [f"__k{i}" for i in range(len(keys))]
    spans = spans.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "s_ms", "e_ms")
    spans = spans.filter(F.col("s_ms").isNotNull() & (F.col("e_ms") > F.col("s_ms")))
    if total is None:
        total = spans.count()
    huge = huge_entities(spans, own, total, huge_min=huge_min, shards=shards)
    lowest, highest = -(2**62), 2**62
    plain = spans.select(*own, "s_ms", "e_ms", F.lit(-1).alias("shard"),
                         F.lit(lowest).alias("lo"), F.lit(highest).alias("hi"))
    if huge is None:
        pieces = plain
    else:
        small = F.broadcast(huge)
        marked = spans.alias("a").join(small.alias("b"), null_safe("a", "b", own), "left").select(*[F.col(f"a.{o}") for o in own], "s_ms", "e_ms", "cuts")
        rest = marked.filter(F.col("cuts").isNull()).select(
            *own, "s_ms", "e_ms", F.lit(-1).alias("shard"), F.lit(lowest).alias("lo"), F.lit(highest).alias("hi"))
        # equal starts are folded before the shuffle, so a crowd of them never meets in one shard
        hot = marked.filter(F.col("cuts").isNotNull()).select(*own, "s_ms", "e_ms", shard_of(F.col("s_ms"), F.col("cuts")).alias("from"), shard_of(F.col("e_ms") - 1, F.col("cuts")).alias("to"))
        hot = hot.groupBy(*own, "s_ms").agg(F.max("e_ms").alias("e_ms"), F.first("from").alias("from"), F.max("to").alias("to"))
        hot = hot.withColumn("shard", F.explode(F.sequence("from", "to")))
        ends = F.concat(F.array(F.lit(lowest)), F.col("cuts"), F.array(F.lit(highest)))
        borders = huge.select(*own, F.posexplode(F.transform(F.slice(ends, 2, F.size(ends) - 1), lambda e, i: F.struct(F.get(ends, i).alias("lo"), e.alias("hi")))).alias("shard", "b"))
        hot = hot.alias("a").join(F.broadcast(borders.alias("b")), null_safe("a", "b", [*own, "shard"])).select(*[F.col(f"a.{o}") for o in own], "s_ms", "e_ms", "a.shard", "b.b.lo", "b.b.hi")
        hot = hot.select(*own, F.greatest("s_ms", "lo").alias("s_ms"), F.least("e_ms", "hi").alias("e_ms"), "shard", "lo", "hi")
        pieces = rest.unionByName(hot)
    part = [*own, "shard"]
    w = Window.partitionBy(*part).orderBy("s_ms", "e_ms")
    reach = F.max("e_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        pieces.withColumn("__new", F.when(F.col("s_ms") <= reach, 0).otherwise(1))
        .withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*part, "__island")
        .agg(F.min("s_ms").alias("s"), F.max("e_ms").alias("e"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    )
    v = Window.partitionBy(*part).orderBy("s")
    local = islands.withColumn("before", F.lag("e").over(v)).withColumn("last", F.lead("s").over(v).isNull())

    def rows(period: Column, df: DataFrame) -> DataFrame:
        gap = F.when(F.col("before").isNotNull() & (F.col("s") - F.col("before") <= max_gap_ms) & (F.col("s") > F.col("before")),
                     F.struct(F.lit("gap").alias("kind"), F.col("before").alias("start_ms"), F.col("s").alias("end_ms")))
        per = F.when(period, F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")))
        return df.select(*own, F.explode(F.array_compact(F.array(per, gap))).alias("r")).select(*own, "r.*")

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], "kind", "start_ms", "end_ms")

    if huge is None:
        return named(rows(F.lit(True), local))
    local = cut(local)
    touches = (F.col("shard") >= 0) & ((F.col("s") == F.col("lo")) | (F.col("e") == F.col("hi")))
    inner = rows(~touches, local)
    # borders of the shards: at most two periods of each
    edge = local.filter((F.col("shard") >= 0) & (touches | F.col("before").isNull() | F.col("last")))
    u = Window.partitionBy(*own).orderBy("s", "e")
    chained = (
        edge.withColumn("prev", F.lag("e").over(u)).withColumn("prev_shard", F.lag("shard").over(u))
        .withColumn("__new", F.when(F.col("prev") == F.col("s"), 0).otherwise(1))
        .withColumn("__island", F.sum("__new").over(u.rowsBetween(Window.unboundedPreceding, 0)))
    )
    across = chained.filter((F.col("prev_shard") != F.col("shard")) & (F.col("s") > F.col("prev")) & (F.col("s") - F.col("prev") <= max_gap_ms)).select(
        *own, F.lit("gap").alias("kind"), F.col("prev").alias("start_ms"), F.col("s").alias("end_ms"))
    stitched = (
        chained.groupBy(*own, "__island")
        .agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.max(touches).alias("t"))
        .filter("t").select(*own, F.lit("period").alias("kind"), "start_ms", "end_ms")
    )
    return named(inner.unionByName(across).unionByName(stitched))
