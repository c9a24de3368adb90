from __future__ import annotations

import random

import numpy as np

from spanloom.operators import calibrate as C
from spanloom.operators.ranks import exact_grid, numbered, running_total


def sample(spark, n=300, seed=0):
    r = random.Random(seed)
    rows = [(r.choice("xy"), r.choice([r.randrange(20) / 10, r.random(), None, float("nan")] if r.random() < 0.1 else [r.randrange(20) / 10, r.random()]), r.random() < 0.4) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double, y boolean")


def ok(v):
    return v is not None and v == v


def test_exact_grid_is_the_linear_percentile(spark):
    rows, df = sample(spark)
    for r in exact_grid(df, ["g"], "v", 21).collect():
        vals = [v for g, v, _ in rows if g == r["g"] and ok(v)]
        assert r["n"] == len(vals)
        assert np.allclose(r["quantiles"], np.percentile(vals, np.linspace(0, 100, 21)))


def test_single_value_and_empty(spark):
    one = spark.createDataFrame([("a", 2.5)], "g string, v double")
    assert exact_grid(one, ["g"], "v", 5).first()["quantiles"] == [2.5] * 5
    assert exact_grid(one.filter("false"), ["g"], "v", 5).count() == 0


def test_running_total_and_numbers(spark):
    vals = [random.Random(3).randrange(50) for _ in range(200)]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(vals)], "v double, i int").selectExpr("v", "i", "1L AS n")
    for r in running_total(df, "v", "n", ranges=7).collect():
        assert r["before"] == sum(x < r["v"] for x in vals) and r["upto"] == sum(x <= r["v"] for x in vals) and r["whole"] == 200
    got = {r["i"]: r["rank"] for r in numbered(df, "v", ["i"], ranges=7).collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(vals)))}
    assert got == want


def test_auc_and_sweep(spark):
    rows, df = sample(spark, seed=5)
    known = [(v, y) for _, v, y in rows if ok(v)]
    pos, neg = [v for v, y in known if y], [v for v, y in known if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(C.auc(df, "v", "y").first()["auc"] - want) < 1e-9
    best = C.best_cut(df, "v", "y").first()
    f1 = {}
    for t in {v for v, _ in known}:
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        f1[t] = 2 * tp / (tp + fp + len(pos)) if tp else 0.0
    assert abs(best["f1"] - max(f1.values())) < 1e-12
    assert best["threshold"] == min(t for t, f in f1.items() if abs(f - max(f1.values())) < 1e-12)


def test_one_sided_counts_strictly_smaller(spark):
    null = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0, None)], "n double")
    vals = spark.createDataFrame([(x,) for x in (0.5, 2.0, 9.0, None)], "v double")
    got = {r["v"]: r["percentile"] for r in C.one_sided_percentile(vals, null, "v", "n").collect()}
    assert got == {0.5: 0.0, 2.0: 25.0, 9.0: 100.0, None: None}
