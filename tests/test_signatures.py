from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from spanloom.conf import Settings
from spanloom.operators import kernels as K
from spanloom.operators import signatures as S


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def scene(seed, h, w):
    r = np.random.default_rng(seed)
    return S.resized(r.integers(30, 220, (12, 12, 3)).astype(float), h, w)


def decoder(r):
    """Clips named scene-period: a textured patch swings over a scene."""
    name, period = r.path.split("-")
    if name == "bad":
        raise OSError("broken")
    base = scene(int(name), r.height, r.width)
    ts = np.arange(r.t0, r.t1, 1 / r.fps)
    out = []
    for t in ts:
        f = base.copy()
        x = int(r.width * (0.4 + 0.25 * np.sin(2 * np.pi * t / float(period))))
        y, s = r.height // 3, max(r.width // 8, 3)
        f[y : y + s, x : x + s] = scene(99, s, s)[: f[y : y + s, x : x + s].shape[0], : f[y : y + s, x : x + s].shape[1]]
        out.append(f)
    frames = np.clip(np.stack(out), 0, 255).astype(np.uint8)
    yield (frames.mean(axis=3, keepdims=True).astype(np.uint8) if r.gray else frames), ts


def test_flow_follows_a_shift():
    a = S.blur(np.random.default_rng(0).random((90, 160)) * 255, 2.0)
    f = S.dense_flow(a, np.roll(a, 3, axis=1))[20:-20, 20:-20]
    assert np.median(f[..., 0]) == pytest.approx(3, abs=0.4) and abs(np.median(f[..., 1])) < 0.2


def test_descriptor_sizes_and_weights():
    f = scene(1, 120, 160).astype(np.uint8)
    assert S.texture_colour(f).shape == (564,) and np.linalg.norm(S.texture_colour(f)) == pytest.approx(1, abs=1e-6)
    clip = np.stack([f] * 6)
    clip[:, 20:60, 40:90] = np.random.default_rng(2).integers(0, 255, (6, 40, 50, 3))
    w = S.static_weights(clip, 60)
    assert w[40, 65] > 0.9 and w[110, 10] < 0.3 and S.static_weights(clip, bottom=0.3)[-1].max() < 0.7
    assert np.allclose(S.resized(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]]) and S.resized(np.ones((3, 3)), 7, 7).shape == (7, 7)


def test_each_axis_follows_its_own_factor(spark):
    rows = [("a1", "1-2.0", 0.0, 8.0), ("a2", "1-2.0", 1.0, 9.0), ("a3", "1-4.0", 0.0, 8.0), ("b1", "50-2.0", 0.0, 8.0), ("x", "bad-1", 0.0, 8.0)]
    seg = spark.createDataFrame(rows, "video_id string, path string, t0 double, t1 double")
    got = {r["video_id"]: r for r in S.build_signatures(seg, Settings.of({"motion": {"fps": 6.0}}), decoder, (96, 96)).collect()}
    assert "broken" in got["x"]["error"] and got["x"]["app_mean"] is None and got["a1"]["segment_id"] == "a1:0-8"
    a1, a2, a3, b1 = (got[k] for k in ("a1", "a2", "a3", "b1"))
    place = lambda p, q: K.chamfer(np.array(p["app_frames"]), np.array(q["app_frames"]))
    assert place(a1, a3) > place(a1, b1) and place(a1, a2) > place(a1, b1)
    for r, period in ((a1, 2.0), (a3, 4.0)):  # energy rises twice a swing
        assert r["period_s"] in (pytest.approx(period / 2, abs=0.25), pytest.approx(period, abs=0.35))
    assert len(a1["motion_pooled"]) == 262 and len(a1["rhythm"]) == 24 and len(a1["motion_seq"][0]) == 131
    assert len(a1["phash"]) == len(a1["phash_ts"]) == 16 and len(a1["app_frames"]) == 8
