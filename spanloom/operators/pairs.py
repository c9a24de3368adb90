"""Enumerating pairs: within blocks, across windows, by strata, by near-equal hash words."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Records of a block that one task compares.
TILE = 2_000


def blocked_pairs(records: DataFrame, key: str, block: str | None, tile: int = TILE) -> DataFrame:
    """``block, a, b`` with ``a < b`` for all records of the same block; a missing block counts as UNKNOWN.

    Without a block all records form one.  Records of a block are dealt into tiles by hash and every
    pair of tiles joins on its own, so a large block is spread over many tasks.  The number of pairs is
    the square of a block's size by definition; choose blocks accordingly.
    """
    b = F.coalesce(F.col(block).cast("string"), F.lit("UNKNOWN")) if block else F.lit("ALL")
    r = records.filter(F.col(key).isNotNull()).select(b.alias("block"), F.col(key).alias("k")).distinct()
    sizes = r.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("t")).filter("t > 1")
    r = r.join(sizes, "block", "left").withColumn("t", F.coalesce("t", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("k"), F.col("t")).cast("int"))
    left = r.select("block", "i", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("j"), F.col("k").alias("a"))
    right = r.select("block", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("i"), F.col("i").alias("j"), F.col("k").alias("b"))
    return left.join(right, ["block", "i", "j"]).filter("a < b").select("block", "a", "b")


def window_pairs(pairs: DataFrame, windows: DataFrame, record: str, window: str) -> DataFrame:
    """Every window of one record with every window of the other, for given pairs ``a, b`` of records."""
    wa = windows.select(F.col(record).alias("a"), F.col(window).alias("window_a"))
    wb = windows.select(F.col(record).alias("b"), F.col(window).alias("window_b"))
    return pairs.join(wa, "a").join(wb, "b").select("a", "b", "window_a", "window_b")


def sample_pairs(pairs: DataFrame, record_a: Column, record_b: Column, size: int, seed: str = "0", least: int = 8) -> DataFrame:
    """A sample of at most ``size`` pairs that does not depend on their order.

    Pairs within one record are left out unless fewer than ``least`` others exist.  Pairs are taken in
    order of a hash of the seed and both ends.
    """
    marked = pairs.withColumn("__own", record_a == record_b)
    across = marked.filter("NOT __own").limit(least).count()
    pool = marked.filter("NOT __own") if across >= least else marked
    return pool.drop("__own").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "a", "b")), "a", "b").limit(size)


def stratum(a: str = "m_a", b: str = "m_b") -> Column:
    """How two recordings relate, from their metadata structs; ? where it is unknown."""
    f = lambda side, x: F.col(f"{side}.{x}")
    known = f(a, "environment_l1").isNotNull() & f(b, "environment_l1").isNotNull()
    same = lambda x: F.coalesce(f(a, x) == f(b, x), F.lit(False))
    near = F.abs(f(a, "ordinal") - f(b, "ordinal")) <= 1
    return (
        F.when(~known, "?").when(~same("environment_l1"), "diff_industry").when(same("session_key") & F.coalesce(near, F.lit(False)), "same_session_adjacent")
        .when(same("session_key"), "same_session_distant").when(same("site"), "same_site_diff_session").otherwise("same_industry_diff_site")
    )


def directed(pairs: DataFrame, swap: list[tuple[str, str]]) -> DataFrame:
    """Each pair in both directions; ``swap`` lists the columns that change places."""
    back = {x: y for p in swap for x, y in (p, p[::-1])}
    return pairs.unionByName(pairs.select(*[F.col(back.get(c, c)).alias(c) for c in pairs.columns]))


def hamming_pairs(words: DataFrame, word: str, distance: int = 8, bands: int = 10) -> DataFrame:
    """``p, q`` (p < q) and ``distance``: distinct 64-bit words that differ in at most ``distance`` bits.

    Cut into ``bands`` pieces, such words agree in at least ``bands - distance`` of them, so each word
    is sent under every choice of that many pieces; pairs that meet are verified.  Exact.  Equal words
    count once here; more bands make the keys longer and the meetings fewer.
    """
    agree = bands - distance
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    w = F.col("w")
    piece = [F.shiftrightunsigned(w, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    keys = F.array(*[F.struct(F.lit(n).alias("no"), F.xxhash64(*[piece[i] for i in c]).alias("h")) for n, c in enumerate(combinations(range(bands), agree))])
    r = words.filter(F.col(word).isNotNull()).select(F.col(word).alias("w")).distinct().select("w", F.explode(keys).alias("k")).select("w", "k.*")
    bits = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))).cast("int")
    met = r.select("no", "h", F.col("w").alias("p")).join(r.select("no", "h", F.col("w").alias("q")), ["no", "h"]).filter((F.col("p") < F.col("q")) & (bits <= distance))
    return met.select("p", "q", bits.alias("distance")).distinct()


def hamming_links(records: DataFrame, key: str, word: str, distance: int = 8, bands: int = 10) -> DataFrame:
    """One row per record: ``key, word, class_size`` (records with the same word) and ``n_links`` (other records within the distance)."""
    r = cut(records.filter(F.col(word).isNotNull()).select(key, word))
    sizes = r.groupBy(word).agg(F.count("*").alias("class_size"))
    both = directed(hamming_pairs(r, word, distance, bands), [("p", "q")])
    near = both.join(sizes.select(F.col(word).alias("q"), F.col("class_size").alias("m")), "q").groupBy(F.col("p").alias(word)).agg(F.sum("m").alias("near"))
    return r.join(sizes, word).join(near, word, "left").select(key, word, "class_size", (F.col("class_size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
