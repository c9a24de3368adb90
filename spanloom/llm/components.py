"""Groups of records linked directly or through others, by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: A set of more entries than this, and than 1 / HOT_PARTS of all, is dealt into parts of about that size.
HOT_MIN = 100_000
HOT_PARTS = 20_000
MAX_ROUNDS = 60


def connected_groups(links: DataFrame, a: str, b: str, vertex: str = "vertex", group: str = "group_id",
                     hot_min: int = HOT_MIN, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row per linked vertex with the smallest vertex of its group.

    ``links`` has the ends of a link in the columns ``a`` and ``b`` (same type, orderable); other
    columns are ignored.  A link with a null end, and one of a vertex with itself, links nothing;
    repeated links and either order count once.  A vertex without a link to another one is not in
    the result; empty links give an empty result.

    Each round, a vertex sends its set to the set's minimum and that minimum to all members.  Sets
    are kept as (vertex, member) rows, so no set is ever one record; a vertex with a huge set is
    dealt by member into parts, as many as its size needs.  At most ``HOT_PARTS`` vertices can be that hot, so their list
    is bounded and may be broadcast.
    Rounds are cut by checkpoints.  Raises if ``max_rounds`` do not suffice.
    """
    ends = links.select(F.col(a).alias("v"), F.col(b).alias("u")).filter(F.col("v").isNotNull() & F.col("u").isNotNull() & (F.col("v") != F.col("u")))
    pair = F.array(
        F.struct(F.col("v").alias("v"), F.col("v").alias("u")), F.struct(F.col("v").alias("v"), F.col("u").alias("u")),
        F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct(F.col("u").alias("v"), F.col("u").alias("u")))
    sets = cut(ends.select(F.explode(pair).alias("p")).select("p.*").distinct())
    before: tuple | None = None
    for _ in range(max_rounds):
        least = cut(sets.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"), F.sum(F.xxhash64("u").cast("decimal(20,0)")).alias("h")))
        seen = least.agg(
            F.count("*").alias("vertices"), F.sum("n").alias("entries"), F.expr("bit_xor(xxhash64(v, m, n, h))").alias("x"),
            F.sum(F.expr("hash(v, m, n, h)").cast("bigint")).alias("s"), F.max("n").alias("most")).first()
        if (state := tuple(seen)[:4]) == before or not seen["vertices"]:
            return least.select(F.col("v").alias(vertex), F.col("m").alias(group))
        before, limit = state, max(hot_min, seen["entries"] // HOT_PARTS)
        here, there, on = sets, least.select("v", "m"), ["v"]
        if seen["most"] > limit:
            hot = F.broadcast(least.filter(F.col("n") > limit).select("v", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
            here = here.join(hot, "v", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))).drop("parts")
            there = there.join(hot, "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            on = ["v", "part"]
        met = here.join(there, on)
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        sets = cut(met.select(F.explode(sent).alias("p")).select("p.*").distinct())
    raise RuntimeError(f"groups were not stable after {max_rounds} rounds")
