"""Queries and operators over small tables that hold what was once left out."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as E
from spanloom.operators.selection import facility_location, greedy_kernel


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def vectors(n, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    x[n - 2] = x[n - 3]  # a copy, and none of the three is divisible by 50
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-8
    return [(i, [float(v) for v in r], 0) for i, r in enumerate(x)], u @ u.T


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_verbs_with_any_characters_are_tallied(spark, tmp_path):
    verbs = ["\ttightening\n", "Tightening.", "tigh\u00adtened", "weld\u200bing", "frás", None, "n/a", "pick \n up", "pick up"]
    sf = put(spark, tmp_path, caption_segments=([(v, "x") for v in verbs], "verb string, object_name string"))
    got = {r["verb"]: r["n"] for r in E.queries()["clean_tokens"](spark, sf).collect()}
    assert got == {"tightening": 2, "tigh\u00adtened": 1, "weld\u200bing": 1, "frás": 1, "": 2, "pick up": 2}


def test_every_vector_may_represent(spark, tmp_path):
    rows, s = vectors(120)
    got = E.queries()["facility_location"](spark, put(spark, tmp_path, embeddings=(rows, VECTORS))).orderBy("rank").collect()
    order, gains = greedy_kernel(s, 8)
    assert [r["vec_id"] for r in got] == order and [r["gain"] for r in got] == pytest.approx(gains, abs=1e-5)
    assert got[-1]["fraction"] == pytest.approx(sum(gains) / np.maximum(s, 0).max(axis=1).sum(), abs=1e-6)
    df = spark.createDataFrame(rows, VECTORS)
    assert [r["id"] for r in facility_location(df, df, "vec_id", "embedding", 5, 50).orderBy("rank").collect()] == order[:5]


def test_arrivals_are_gated_by_the_whole_corpus(spark, tmp_path):
    rows, s = vectors(120)
    np.fill_diagonal(s, -1)
    got = {r["vec_id"]: r for r in E.queries()["stream_gate"](spark, put(spark, tmp_path, embeddings=(rows, VECTORS))).collect()}
    assert len(got) == 120 and not got[117]["accept"] and not got[118]["accept"]
    for i in range(120):
        assert got[i]["similarity"] == pytest.approx(s[i].max(), abs=1e-6) and got[i]["accept"] == (s[i].max() < 0.55)


def test_gate_over_blocks(spark):
    from spanloom.streaming.ingest import gate_batch

    rows, s = vectors(60)
    np.fill_diagonal(s, -1)
    df = spark.createDataFrame(rows, VECTORS)
    got = {r["vec_id"]: r["similarity"] for r in gate_batch(df, "vec_id", "embedding", 0.55, 25)(df).collect()}
    assert got == pytest.approx({i: s[i].max() for i in range(60)}, abs=1e-6)
    alone = gate_batch(df.filter("vec_id = 3"), "vec_id", "embedding", 0.55)(df.filter("vec_id = 3")).collect()
    assert [(r["similarity"], r["accept"]) for r in alone] == [(0.0, True)]


def test_readings_meet_the_null_model_of_their_encoder(spark, tmp_path):
    seg = [("g1", "gist", 1), ("g2", "gist", 1), ("s1", "siglip", 1), ("s2", "gist", 1), ("s2", "siglip", 2), ("o1", "other", 1), ("o2", "other", 1)]
    models = [("env_raw", "gist", [0.0, 0.5, 1.0], 0.5, 0.1), ("env_raw", "siglip", [0.4, 0.5, 0.6], 0.4, 0.2), ("env_cos", "other", [0.0, 1.0], 0.5, 0.1)]
    pairs = [("g1", "g2"), ("s1", "s2"), ("g1", "s1"), ("o1", "o2"), ("g1", "gone")]
    verdicts = [(a, b, True, (0.5, 0.1), None) for a, b in pairs] + [("g2", "g1", True, (float("nan"), 0.1), None), ("s1", "g2", False, (0.5, 0.1), None)]
    raw = "struct<env_raw:double,task_cos:double>"
    sf = put(spark, tmp_path, signatures=(seg, "segment_id string, app_encoder string, indexed_at int"), null_models=(models, "metric string, encoder string, quantiles array<double>, mean_value double, std_value double"),
             verdicts=(verdicts, f"a string, b string, calibrated boolean, raw {raw}, dup struct<overlap_seconds:double,fraction_of_a:double,fraction_of_b:double>"))
    by = lambda name, col: {(r["a"], r["b"]): r[col] for r in E.queries()[name](spark, sf).collect()}
    nothing = {p: None for p in pairs[2:]}
    p, z, env = by("null_percentile", "percentile"), by("null_zscore", "z"), by("verdict_compare", "env")
    assert p.pop(("g2", "g1")) is None and z.pop(("g2", "g1")) is None and env.pop(("g2", "g1")) is None  # NaN is no reading
    assert p.pop(("s1", "g2")) is None and z.pop(("s1", "g2")) is None and env.pop(("s1", "g2")) == 75.0
    assert p == {("g1", "g2"): 50.0, ("s1", "s2"): 50.0, **nothing} == env
    assert z == {("g1", "g2"): 0.0, ("s1", "s2"): 0.5, **nothing}
    assert by("verdict_compare", "label")["s1", "s2"] == "NOVEL"


def test_recordings_without_site_or_session_are_kept(spark, tmp_path):
    rows = [("r1", "hall", "north/AB-1", 30), ("r2", None, "north/AB-1", 60), ("r3", "hall", None, 0), ("r4", None, None, 0)]
    sf = put(spark, tmp_path, recordings=(rows, "video_id string, site string, session_key string, ordinal int"))
    got = {tuple(r) for r in E.queries()["session_keys"](spark, sf).collect()}
    assert got == {("r1", "north/AB-1", "AB-1", 30, 60), ("r2", "north/AB-1", "AB-1", 60, 90), ("r3", None, None, None, None), ("r4", None, None, None, None)}
    pairs = {tuple(r) for r in E.queries()["blocked_pairs"](spark, sf).select("block", "a", "b").collect()}
    assert pairs == {("north/AB-1", "r1", "r2"), ("UNKNOWN", "r3", "r4")}


def test_similarity_half_way_between_two_values_rounds_as_its_sql(spark, tmp_path):
    import duckdb

    readings = [(0.50505, 0.0), (0.88766, 0.51137), (0.22424, 0.00627), (0.19176, 0.14233), (None, 0.1), (float("nan"), 0.1)]
    readings = [*readings, *readings[:4], *((x / 1e5, y / 1e5) for x, y in zip(range(11, 99_000, 3310), range(98_999, 0, -3310)))]
    seg = [(f"s{i}", "gist", 1) for i in range(2 * len(readings))]
    grid = [i / 200 for i in range(201)]
    tables = {
        "signatures": (seg, "segment_id string, app_encoder string, indexed_at int"),
        "null_models": ([("env_raw", "gist", grid, 0.5, 0.1)], "metric string, encoder string, quantiles array<double>, mean_value double, std_value double"),
        "verdicts": ([(f"s{2 * i}", f"s{2 * i + 1}" if i > 9 else "gone", r) for i, r in enumerate(readings)], "a string, b string, raw struct<env_raw:double,task_raw:double>"),
    }
    sf = put(spark, tmp_path, **tables)
    c = duckdb.connect()
    for name in tables:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in E.queries()["similarity_pairs"](spark, sf).select("a", "b", "env", "task", "fused").collect()]
    want = c.execute(f"SELECT a, b, env, task, fused FROM ({E.oracle_sql()['similarity_pairs']})").fetchall()
    assert len(got) == len(readings) and sorted(got, key=str) == sorted(want, key=str)
