"""Exact ranks, running totals and percentiles without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a group are cut into.
RANGES = 64


def _ranged(df: DataFrame, order: str, group: list[str], ranges: int) -> DataFrame:
    """Adds ``__part``: the range of ``order`` among approximate quantiles of its group.

    The quantiles are ``ranges`` numbers a group; equal values always share a range.
    """
    at = [i / ranges for i in range(1, ranges)]
    names = [f"__g{i}" for i in range(len(group))]
    cuts = df.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(F.percentile_approx(F.col(order), at, 1_000).alias("__cuts"))
    on = F.lit(True)
    for g, n in zip(group, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    return df.join(cuts, on).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts", *names)


def running_total(df: DataFrame, order: str, amount: str, group: list[str] | None = None, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds ``before`` (sum of ``amount`` at earlier values of ``order``), ``upto`` (and at equal ones) and ``whole``.

    Values of a group are cut into ranges; each is summed on its own and gets the totals of those before it.
    """
    group = group or []
    df = _ranged(df, order, group, ranges)
    sums = df.groupBy(*group, "__part").agg(F.sum(amount).alias("__s"))
    by = F.desc("__part") if descending else F.asc("__part")
    every = Window.partitionBy(*group)
    offs = sums.select(*[F.col(g).alias(f"__h{i}") for i, g in enumerate(group)], F.col("__part").alias("__q"),
                       F.coalesce(F.sum("__s").over(every.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"), F.sum("__s").over(every).alias("whole"))
    on = F.col("__part") == F.col("__q")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__h{i}"))
    df = df.join(offs, on).drop("__q", *[f"__h{i}" for i in range(len(group))])
    w = Window.partitionBy(*group, "__part").orderBy(F.desc(order) if descending else F.asc(order))
    df = df.withColumn("upto", F.sum(amount).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__off"))
    return df.withColumn("before", F.col("upto") - F.sum(amount).over(Window.partitionBy(*group, "__part", order))).drop("__part", "__off")


def numbered(df: DataFrame, order: str, ties: list[str], group: list[str] | None = None, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Adds the row number by ``order`` and then ``ties``, from 1, over all rows of a group."""
    group = group or []
    df = _ranged(df, order, group, ranges)
    sums = df.groupBy(*group, "__part").count()
    offs = sums.select(*[F.col(g).alias(f"__h{i}") for i, g in enumerate(group)], F.col("__part").alias("__q"),
                       F.coalesce(F.sum("count").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    on = F.col("__part") == F.col("__q")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__h{i}"))
    df = df.join(offs, on).drop("__q", *[f"__h{i}" for i in range(len(group))])
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group, "__part").orderBy(order, *ties)) + F.col("__off")).drop("__part", "__off")


def grid_parts(first: str, last: str, m: str, g: int) -> Column:
    """Grid points ``j`` of 0..g, with weight ``w``, to which a stretch of equal values contributes.

    ``first`` and ``last`` name the ranks (from 0) that the stretch holds among ``m + 1`` values.  Point
    j lies at rank ``j * m / g`` and interpolates between the ranks around it.
    """
    one = f"{m} = 0"
    lo_from, lo_to = f"if({one}, 0L, ({g} * {first} + {m} - 1) div {m})", f"if({one}, {g}L, least({g}L, ({g} * ({last} + 1) + {m} - 1) div {m} - 1))"
    hi_from, hi_to = f"if({one} or {first} <= 0, 0L, ({g} * ({first} - 1)) div {m} + 1)", f"if({one}, {g}L, least({g}L, ({g} * {last}) div {m}))"
    span = lambda a, b, c: f"transform(if(({a}) <= ({b}), sequence({a}, {b}), cast(array() as array<bigint>)), j -> named_struct('j', j, 'w', {c}))"
    frac = f"((j * {m}) % {g}) / double({g})"
    return F.expr(f"concat({span(lo_from, lo_to, f'1 - {frac}')}, {span(hi_from, hi_to, frac)})")


def exact_grid(df: DataFrame, group: list[str], value: str, points: int = 201) -> DataFrame:
    """``group, n, quantiles``: exact, linearly interpolated percentiles at ``points`` even steps.

    Values are counted once each and ranked by running totals, so a group may be of any size.  Null
    and NaN do not count; a group without values gives no row.
    """
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    counts = ok.groupBy(*group, F.col(value).alias("__x")).agg(F.count("*").alias("__n"))
    r = running_total(counts, "__x", "__n", group).withColumn("__m", F.col("whole") - 1).withColumn("__last", F.col("upto") - 1)
    parts = r.select(*group, F.col("whole").alias("n"), "__x", F.explode(grid_parts("before", "__last", "__m", points - 1)).alias("p"))
    q = parts.groupBy(*group, "n", F.col("p.j").alias("j")).agg(F.sum(F.col("p.w") * F.col("__x")).alias("q"))
    return q.groupBy(*group, "n").agg(F.array_sort(F.collect_list(F.struct("j", "q"))).alias("s")).select(*group, "n", F.col("s.q").alias("quantiles"))
