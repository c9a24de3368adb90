from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators.intervals import SHARD_ROWS, huge_entities, merge_intervals, shard_of, shard_rows

SCHEMA = "k string, s_ms bigint, e_ms bigint, kind string, shard int"


def brute(rows, limit):
    out = set()
    by = {}
    for k, s, e, *_ in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] - x[1] <= limit}
    return out


@pytest.mark.parametrize("seed,huge_min,spread", [(1, 10**9, 500), (2, 20, 500), (3, 20, 60), (4, 5, 5_000), (5, 10, 10)])
def test_matches_brute_force_at_both_levels(spark, seed, huge_min, spread):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        k = r.choice(["hot"] * 8 + ["a", "b", None])
        s = r.choice([r.randrange(spread), r.randrange(spread) * 100, None] if r.random() < 0.1 else [r.randrange(spread) * 7])
        e = None if s is None else s + r.choice([-3, 0, 1, 5, 20, 700])
        rows.append((k, s, e, "clash", 3))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(x) for x in merge_intervals(df, ["k"], None, 300, huge_min=huge_min, shards=8).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 300)


def test_empty_and_useless_rows(spark):
    for rows in ([], [("a", None, 4, "", 1), ("a", 5, 5, "", 1), ("a", 6, 2, "", 1)]):
        assert merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k"]).count() == 0


def test_tasks_do_not_grow_with_the_data(spark):
    assert shard_rows(10**6) == shard_rows(10**8) == shard_rows(10**10) == SHARD_ROWS
    most = []
    for n in (400, 40_000):  # a hundred times the rows, one entity holding half of them
        df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("e"), (F.col("id") % 97).cast("string"))).alias("k"), F.col("id").alias("s_ms"))
        cuts = huge_entities(df, ["k"], n, huge_min=50)
        hot = df.join(cuts.filter("k = 'hot'"), "k").groupBy(shard_of(F.col("s_ms"), F.col("cuts")).alias("shard")).count()
        most.append(hot.agg(F.max("count")).first()[0])
    assert max(most) <= 2 * 50 and len(hot.collect()) >= 40_000 / 2 / 50


def test_shard_of_counts_borders(spark):
    r = np.random.default_rng(0)
    rows = [(int(v), sorted({int(x) for x in r.integers(0, 50, n)})) for n in range(12) for v in r.integers(-2, 53, 20)]
    df = spark.createDataFrame(rows, "v bigint, cuts array<bigint>")
    got = df.select("v", "cuts", shard_of(F.col("v"), F.col("cuts")).alias("k")).collect()
    assert all(x["k"] == sum(c <= x["v"] for c in x["cuts"]) for x in got)
