from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.functions import vec as V
from spanloom.operators import windows as W


def test_hop_windows_edges(spark):
    df = spark.createDataFrame([("a", 95.0), ("b", 20.0), ("c", None), ("d", 0.0), ("e", float("nan")), ("f", 60.0)], "id string, d double")
    got = {}
    for r in W.hop_windows(df, "d", 30.0, 20.0, 10.0).collect():
        got.setdefault(r["id"], []).append((r["w0"], r["w1"], r["whole"]))
    assert sorted(got["a"]) == [(0.0, 30.0, False), (20.0, 50.0, False), (40.0, 70.0, False), (60.0, 90.0, False), (80.0, 95.0, False)]
    assert got["b"] == [(0.0, 20.0, True)] and sorted(got["f"])[-1] == (40.0, 60.0, False) and set(got) == {"a", "b", "f"}
    assert W.hop_windows(df, "d", 0.0).filter("whole").count() == 3
    assert W.hop_windows(df.filter("id = 'f'"), "d", 30.0).count() == 2


def test_islands_at_both_levels(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 9 + ["x", None]), r.choice([r.randrange(900), None] if r.random() < 0.05 else [r.randrange(900)]), 1) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, p int, first int")
    want = set()
    for k in {k for k, _, _ in rows}:
        ps = sorted({p for kk, p, _ in rows if kk == k and p is not None})
        run = []
        for p in ps:
            if run and p - run[-1] > 2:
                want.add((k, run[0], run[-1], len(run)))
                run = []
            run.append(p)
        if run:
            want.add((k, run[0], run[-1], len(run)))
    for huge_min in (10**9, 30):
        got = [tuple(x) for x in W.islands(df, ["k"], "p", 2, huge_min=huge_min, shards=8).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_frame_windows_pad_and_drop(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", list(range(9))), ("c", []), ("d", None)], "id string, v array<int>")
    got = {(r["id"], r["start"]): r["window"] for r in W.frame_windows(df, "v", 4, 3).collect()}
    assert got == {("a", 0): [1, 2, 3, 3], ("b", 0): [0, 1, 2, 3], ("b", 3): [3, 4, 5, 6]}


def test_suppression_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([([0.0, 0.4, 0.8, 1.2, 1.6],), ([],)], "t array<double>")
    got = [r[0] for r in df.select(W.suppress_close(F.col("t"), 0.5)).collect()]
    assert got == [[0.0, 0.8, 1.6], []]


def test_target_cuts_end_nearest_to_the_target():
    assert W.target_cuts([0.0, 4.0, 9.0, 12.0, 21.0], 10.0) == [(0.0, 9.0, 2), (9.0, 21.0, 2)]
    assert W.target_cuts([0.0, 1.0], 10.0) == [(0.0, 1.0, 1)] and W.target_cuts([0.0], 10.0) == []


def test_uncovered_includes_the_ends(spark):
    rec = spark.createDataFrame([("a", 60.0), ("b", 10.0), ("c", None)], "v string, d double")
    spans = spark.createDataFrame([("a", 5.0, 20.0), ("a", 18.0, 30.0), ("a", None, 50.0), ("a", 58.0, 99.0)], "v string, t0 double, t1 double")
    got = {tuple(r) for r in W.uncovered(spans, rec, "v", "d", "t0", "t1", 3.0).collect()}
    assert got == {("a", 0, 5000), ("a", 30000, 58000), ("b", 0, 10000)}


def test_times_tokens_and_grid(spark):
    texts = ["01:02:03.5", "2:05", "7.25", "soon", " ", None, "1:x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.parse_seconds(F.col("t"))).collect()]
    assert got == [3723.5, 125.0, 7.25, None, None, None, None]
    toks = [" The  Lid., ", "N/A", "-", None, "unknown"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in toks], "t string").select(V.clean_token(F.col("t"))).collect()] == ["the lid", "", "", "", ""]
    grid = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 2.0, 9.0)], "x double").select(V.grid_percentile(F.col("x"), F.array(*[F.lit(float(v)) for v in (0, 1, 1, 2, 3)])))
    assert [r[0] for r in grid.collect()] == [0.0, 0.0, 50.0, 62.5, 75.0, 100.0]
