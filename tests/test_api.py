from __future__ import annotations

import numpy as np

from spanloom.api import Catalog
from spanloom.conf import Settings


def test_factorial_of_places_and_footage(spark):
    """Two places, several takes each, one of them a copy of another: place and source must each follow their own factor."""
    r = np.random.default_rng(0)
    first = r.normal(size=16)
    place = {"a": first, "b": -first}
    hashes = {t: [int(x) for x in r.integers(-(2**62), 2**62, 30)] for t in ("a1", "a2", "a3", "b1", "b2")}
    hashes["a3"] = hashes["a1"]
    rows = []
    for t, h in hashes.items():
        fr = [[float(x) for x in place[t[0]] + 0.2 * r.normal(size=16)] for _ in range(4)]
        rows.append((t, t, "e", fr, [float(x) for x in np.mean(fr, axis=0)], h, [0.5 * i for i in range(30)]))
    seg = spark.createDataFrame(rows, "segment_id string, video_id string, app_encoder string, app_frames array<array<float>>, app_mean array<float>, phash array<bigint>, phash_ts array<double>")
    names = sorted(hashes)
    pairs = spark.createDataFrame([(x, y) for x in names for y in names if x < y], "a string, b string")
    cat = Catalog(seg, Settings.of({"decision": {"env_percentile": 60}}))
    plain = {(x["a"], x["b"]): x for x in cat.compare(pairs).collect()}
    assert plain["a1", "a3"]["label"] == "DUPLICATE_SOURCE" and plain["a1", "a2"]["label"] == "REDUNDANT" and plain["a1", "b1"]["label"] == "NOVEL"
    assert "uncalibrated" in plain["a1", "a2"]["notes"] and plain["a1", "a2"]["env"] > plain["a1", "b1"]["env"]
    cal = {(x["a"], x["b"]): x for x in cat.calibrated(pairs).compare(pairs).collect()}
    assert cal["a1", "a2"]["env"] > cal["a1", "b2"]["env"] and not cal["a1", "a2"]["notes"]
    near = {(x["query"], x["rank"]): x["id"] for x in cat.nearest(seg, 1).collect()}
    assert all(q[0] == i[0] for (q, _), i in near.items())
    assert {x["i"] if "i" in x else x["id"] for x in cat.select(seg, 2).collect()}.__len__() == 2
    verdicts = {x["segment_id"]: x["accept"] for x in cat.admit(seg, 0.5).collect()}
    assert not any(verdicts.values())
    empty = Catalog(seg.filter("false"))
    assert all(x["accept"] for x in empty.admit(seg, 0.5).collect())
