from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import pairs as P
from spanloom.operators.overlap import COLUMNS, source_overlap
from spanloom.operators.selection import facility_location, greedy_kernel, search


def test_blocked_pairs_split_large_blocks(spark):
    rows = [(f"r{i}", "big" if i % 3 else None) for i in range(60)] + [("r1", "big"), (None, "big")]
    df = spark.createDataFrame(rows, "id string, b string")
    got = [tuple(r) for r in P.blocked_pairs(df, "id", "b", tile=7).collect()]
    want = {("big" if x % 3 else "UNKNOWN", f"r{x}", f"r{y}") for x in range(60) for y in range(60) if f"r{x}" < f"r{y}" and bool(x % 3) == bool(y % 3)}
    assert len(got) == len(want) and set(got) == want


def test_hamming_pairs_are_exact(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) - 2**63 for _ in range(20)]
    words = base + [w ^ sum(1 << b for b in r.sample(range(63), r.choice([1, 7, 8, 9]))) for w in base] + base[:3] + [None]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w bigint")
    d = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    uniq = sorted({w for w in words if w is not None})
    want = {(a, b, d(a, b)) for a in uniq for b in uniq if a < b and d(a, b) <= 8}
    for bands in (9, 10, 11):
        assert {tuple(x) for x in P.hamming_pairs(df, "w", 8, bands).collect()} == want
    links = {x["id"]: x["n_links"] for x in P.hamming_links(df, "id", "w", 8).collect()}
    assert links == {i: sum(j != i and v is not None and d(w, v) <= 8 for j, v in enumerate(words)) for i, w in enumerate(words) if w is not None}


def test_overlap_needs_an_unbroken_stretch(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(-(2**62), 2**62, 60), r.integers(-(2**62), 2**62, 60)
    t = np.arange(60) * 0.5
    scattered, shared = b.copy(), b.copy()
    scattered[[3, 11, 24, 37, 52]] = a[[3, 11, 24, 37, 52]]
    shared[20:25] = a[20:25]
    none = np.zeros(0, np.int64)
    cases = {"scattered": (a, t, scattered, t), "shared": (a, t, shared, t), "later": (a, t, a[30:], t[:30]), "same": (a, t, a, t), "other": (a, t, b, t), "empty": (none, t[:0], b, t), "null": (None, None, b, t),
             "still": (np.zeros(30, np.int64), t[:30], np.zeros(30, np.int64), t[:30]), "single": (a[:1], t[:1], a, t)}
    rows = [(k, "x", *[None if v is None else v.tolist() for v in c], 9) for k, c in cases.items()]
    df = spark.createDataFrame(rows, "a string, b string, phash_a array<bigint>, phash_ts_a array<double>, phash_b array<bigint>, phash_ts_b array<double>, top int")
    got = {r["a"]: tuple(r[c] for c in COLUMNS) for r in source_overlap(df).collect()}
    nothing = (0.0, 0.0, 0, 0.0, 0.0)
    assert got["scattered"][0] < 2 <= got["shared"][0]
    assert got["later"][1] == -15.0 and got["same"][3:] == (1.0, 1.0) and got["still"] == (15.0, 0.0, 30, 1.0, 1.0)
    assert got["other"] == got["empty"] == got["null"] == got["single"] == nothing
    assert source_overlap(df.filter("false")).count() == 0


def test_search_and_greedy_match_brute_force(spark):
    x = np.random.default_rng(4).normal(size=(60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in row], "extra") for i, row in enumerate(x)], "i int, v array<double>, rank string").repartition(3)
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = np.round(u @ u.T, 12)
    got = {}
    for r in search(df, df.filter("i % 5 = 0"), "i", "v", 4, block=5).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    for q in range(0, 60, 5):
        want = sorted((j for j in range(60) if j != q), key=lambda j: (-s[q, j], j))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want
    picks = [r["id"] if "id" in r else r["i"] for r in facility_location(df, df, "i", "v", 5).orderBy("rank").collect()]
    assert picks == greedy_kernel(u @ u.T, 5)[0]
    assert search(df, df.filter("false"), "i", "v", 4).count() == 0 and facility_location(df, df.filter("false"), "i", "v", 5).count() == 0


def test_sample_excludes_one_record_unless_too_few(spark):
    df = spark.createDataFrame([(f"r{i % 4}:{i}", f"r{i % 3}:{i}") for i in range(50)], "a string, b string")
    rec = lambda c: F.substring_index(c, ":", 1)
    got = P.sample_pairs(df, rec("a"), rec("b"), 20)
    assert got.count() == 20 and got.filter(rec("a") == rec("b")).count() == 0
    assert P.sample_pairs(df.filter(rec("a") == rec("b")), rec("a"), rec("b"), 99).count() > 0
