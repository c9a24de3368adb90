"""Transport similarity of whole tables against the kernel of one pair."""

from __future__ import annotations

import time

import numpy as np
import pytest

from spanloom import runtime
from spanloom.operators import kernels as K
from spanloom.operators import sets as S
from spanloom.plans import text_queries as Q

SETS = "v string, set array<struct<acts:array<string>,objs:array<string>,sec:double>>"
CAPTIONS = """video_id string, segment_id int, t0 double, t1 double, verb string, object_name string, hand_left_action string, hand_left_object string,
    hand_right_action string, hand_right_object string, error string, captioned_at int, station string, caption string, confidence double"""
WORDS = ["hold", "höhe", "a b", "\U0001f600", "￮", "x" * 200, *[f"w{i}" for i in range(6)]]


def random_set(r: np.random.Generator, n: int, words: list[str]) -> list[dict]:
    some = lambda k: sorted({str(w) for w in r.choice(words, int(r.integers(0, k + 1)))})
    items = {(tuple(some(3)), tuple(some(3))): round(float(r.random() * 9), 3) for _ in range(n)}
    return [{"acts": list(x), "objs": list(y), "sec": s} for (x, y), s in sorted(items.items())]


def scored(spark, pairs, sets, key="v"):
    from spanloom.operators.transport import packed, register

    register(spark)
    df = spark.createDataFrame([(v, [(i["acts"], i["objs"], i["sec"]) for i in s]) for v, s in sets.items()], SETS)
    out = S.set_transport(spark.createDataFrame(pairs, "a string, b string"), df.select(key, packed("set").alias("set")), key)
    return {(x.a, x.b): x.transport for x in out.collect()}


def test_transport_of_many_pairs_equals_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_A_PART", 7)  # sets in many pairs are copied
    r = np.random.default_rng(5)
    sets = {f"v{i}": random_set(r, int(r.integers(1, 25)), WORDS if i % 2 else WORDS[:4]) for i in range(25)}
    sets["still"] = [{**i, "sec": 0.0} for i in sets["v3"]]
    sets["odd"] = [{**i, "sec": i["sec"] / 7 + 1e7} for i in sets["v4"]]
    sets["long"] = [{**i, "sec": float("nan")} for i in sets["v5"]]
    sets["bare"] = [{"acts": [], "objs": [], "sec": 2.0}]
    pairs = [(a, b) for a in sets for b in sets] + [("v1", "unknown"), ("unknown", "v1")]
    got = scored(spark, pairs, sets)
    assert len(got) == len(sets) ** 2
    for (a, b), x in got.items():
        wa, wb = (np.array([i["sec"] for i in sets[v]]) for v in (a, b))
        assert x == pytest.approx(K.transport_similarity(S.segment_similarity(sets[a], sets[b]), wa, wb), abs=1e-9), (a, b)


def write_tables(spark, folder, captions: list[tuple], pairs: list[tuple]) -> str:
    spark.createDataFrame(captions, CAPTIONS).write.parquet(f"{folder}/caption_segments.parquet")
    spark.createDataFrame(pairs, "video_a string, video_b string").write.parquet(f"{folder}/task_pairs.parquet")
    return str(folder)


def test_transport_does_many_pairs_in_time(spark, tmp_path):
    """20,000 pairs of usual size; numpy needs ten milliseconds a pair or more."""
    r = np.random.default_rng(6)
    word = lambda: f"w{r.integers(0, 20)}"
    rows = [(f"v{v}", i, float(i), i + 1 + float(r.random()), *[word() for _ in range(6)], None, 0, None, None, None) for v in range(200) for i in range(24)]
    at = write_tables(spark, tmp_path, rows, [(f"v{i}", f"v{j}") for i in range(200) for j in range(100)])
    began = time.time()
    Q.transport_similarity(spark, at).write.parquet(f"{at}/out")
    assert time.time() - began < 45
    assert spark.read.parquet(f"{at}/out").count() == 20_000


def test_parts_of_a_record_make_the_same_set(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(7)
    some = lambda: str(r.choice(["", "cut", "weld", "sand"]))
    rows = [(f"v{v}" if v else None, i, float(i), i + 1.5, some(), some(), some(), some(), some(), some(), None if i % 9 else "x", k, None, None, None) for v in range(4) for i in range(40) for k in range(2)]
    at = write_tables(spark, tmp_path, rows, [(f"v{i}", f"v{j}") for i in range(1, 4) for j in range(1, 4)])
    whole = sorted(map(tuple, Q.transport_similarity(spark, at).collect()))
    monkeypatch.setattr(runtime, "ROWS_A_PART", 5)
    assert sorted(map(tuple, Q.transport_similarity(spark, at).collect())) == whole
    latest = {(x[0], x[1]): x for x in rows if x[0] and x[10] is None}
    sets: dict = {}
    for v, _, _, _, verb, obj, la, lo, ra, ro, *_ in latest.values():
        key = tuple(sorted({verb, la, ra} - {""})), tuple(sorted({obj, lo, ro} - {""}))
        sets.setdefault(v, {}).setdefault(key, 0.0)
        sets[v][key] += 1.5
    for a, b, x in whole:
        items = [[{"acts": list(p), "objs": list(q)} for p, q in sorted(sets[v])] for v in (a, b)]
        w = [np.array([s for _, s in sorted(sets[v].items())]) for v in (a, b)]
        assert x == pytest.approx(K.transport_similarity(S.segment_similarity(*items), *w), abs=1e-6)
    assert len(whole) == 9
