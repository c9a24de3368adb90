from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanloom.operators import kernels as K
from spanloom.operators import pairscore as PS
from spanloom.operators import signatures as S
from spanloom.operators.text import embedded_captions
from spanloom.sources import decode as D
from spanloom.sources.sinks import Guard, Refused, annotate_csv

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
R = np.random.default_rng(11)


def segments(spark):
    rows = []
    for i in range(5):
        moves = i not in (3,)
        rows.append((f"s{i}", "e1" if i < 4 else "e2", R.random((4, 6)).tolist(), R.random(8).tolist() if moves else None, R.random((7, 5)).tolist() if moves else None,
                     R.random(24).tolist() if moves else None, 2.0 + i, 0.5, "clash"))
    return rows, spark.createDataFrame(rows, "segment_id string, app_encoder string, app_frames array<array<float>>, motion_pooled array<float>, motion_seq array<array<float>>, rhythm array<float>, period_s double, period_strength double, a string")


def test_nine_metrics_of_a_pair(spark):
    rows, df = segments(spark)
    pairs = spark.createDataFrame([("s0", "s1"), ("s0", "s3"), ("s0", "s4"), ("s1", "nobody")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in PS.pair_scores(pairs, df).collect()}
    assert set(got) == {("s0", "s1"), ("s0", "s3")}  # other encoder, unknown segment
    r = got["s0", "s1"]
    x, y = (np.array(rows[i][2], np.float32).astype(float) for i in (0, 1))
    cos = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
    assert r["env_cos"] == pytest.approx(cos(x.mean(0), y.mean(0))) and r["env_chamfer"] == pytest.approx(K.chamfer(x, y))
    p, q = (np.array(rows[i][3], np.float32).astype(float) for i in (0, 1))
    assert r["task_cos"] == pytest.approx(cos(p, q), abs=1e-6) and 0 < r["task_dtw_sim"] <= 1 and 0 < r["rhythm_cos"] <= 1 and r["period_agree"] > 0
    assert r["env_raw"] == pytest.approx(0.5 * r["env_cos"] + 0.35 * r["env_chamfer"] + 0.15 * r["env_bhat_sim"])
    assert r["task_raw"] == pytest.approx(0.4 * r["task_cos"] + 0.3 * r["task_dtw_sim"] + 0.2 * r["rhythm_cos"] + 0.1 * r["period_agree"])
    still = got["s0", "s3"]
    assert still["env_raw"] != 0 and [still[k] for k in ("task_cos", "task_dtw_sim", "rhythm_cos", "period_agree", "task_raw")] == [0.0] * 5
    assert PS.pair_scores(pairs.filter("false"), df).count() == 0


def test_similarity_of_a_kind(spark):
    df = spark.createDataFrame([(0.5, 0.0), (float("nan"), 0.2), (None, None)], "env_raw double, task_raw double")
    grid = F.array(*[F.lit(float(v)) for v in (0, 0.25, 0.5, 0.75, 1)])
    got = [(r["env"], r["task"], r["fused"]) for r in PS.similarity(df, grid).collect()]
    assert got[0] == (0.5, 0.5, 0.5) and got[1][0] is None and got[1][1] == pytest.approx(0.6) and got[2] == (None, None, None)


def words(texts):
    return np.array([[float("a" in t), float("b" in t), 1.0] for t in texts])


def test_embedded_captions_match_best_both_ways(spark):
    said = [("p", "a"), ("p", "a"), ("p", "b"), ("q", "a"), ("r", None), ("r", "")]
    df = spark.createDataFrame([(*s, 1) for s in said], "k string, t string, v int")
    pairs = spark.createDataFrame([("p", "q"), ("q", "p"), ("p", "r")], "a string, b string")
    got = {(r["a"], r["b"]): r["caption_chamfer"] for r in embedded_captions(pairs, df, "k", "t", words).collect()}
    p, q = (words([t for k, t in said if k == x]) for x in "pq")
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    c = u(p) @ u(q).T
    assert got["p", "q"] == got["q", "p"] == pytest.approx(0.5 * (c.max(1).mean() + c.max(0).mean()), abs=1e-6) and got["p", "r"] == 0.0


def decoder(r):
    """A clip whose n-th frame is as bright as n; requests for times get the frame of the second."""
    if "bad" in r.path:
        raise OSError("broken")
    at = np.array(r.times if r.times else np.arange(0, 20, 2.0))
    yield np.stack([np.full((r.height, r.width, 3), int(t) * 5 % 250, np.uint8) for t in at]), at


def test_key_frames_and_remote_samples(spark):
    f, t = D.sample_keyframes("x", 18.0, 4, 4, 4, decoder)
    assert len(f) == 4 and t.tolist() == [0.0, 6.0, 12.0, 18.0] and f[:, 0, 0, 0].tolist() == [0, 30, 60, 90]
    f, t = D.sample_remote("x", 200.0, 4, 4, 3, decoder)
    assert t.tolist() == [2.0, 100.0, 198.0]
    with pytest.raises(ValueError):
        D.eager(lambda r: iter(()), D.Request("x"))
    df = spark.createDataFrame([("v", "x", 18.0), ("w", "bad", 9.0)], "video_id string, path string, duration_s double")
    for mode, n in (("keyframes", 5), ("remote", 5)):
        got = {r["video_id"]: r for r in S.environment_signatures(df, 5, mode, decoder=decoder, size=(64, 64)).collect()}
        assert len(got["v"]["app_frames"]) == n and len(got["v"]["app_mean"]) == len(got["v"]["app_var"]) and "broken" in got["w"]["error"]


def test_csv_is_annotated_in_a_new_place(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", None)], "k string, n int").coalesce(1).write.option("header", "true").csv(src)
    df = spark.read.option("header", "true").schema("k string, n int").csv(src)
    guard = Guard((str(tmp_path),))
    annotate_csv(df, {"twice": F.col("n") * 2}, str(tmp_path / "out"), guard)
    assert {tuple(r) for r in spark.read.option("header", "true").schema("k string, n int, twice int").csv(str(tmp_path / "out")).collect()} == {("a", 1, 2), ("b", None, None)}
    for bad in ("/elsewhere", src):
        with pytest.raises(Refused):
            annotate_csv(df, {}, bad, guard)
