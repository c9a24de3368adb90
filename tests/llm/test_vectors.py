from __future__ import annotations

import numpy as np
import pytest

from spanloom.llm.hnsw import Graph
from spanloom.llm.similar import most_similar
from spanloom.llm.varied import choose_varied
from spanloom.llm.vectors import usable_vectors

SCHEMA = "segment_id string, app_encoder string, app_mean array<float>, indexed_at int, kind string, vec string"


def table(spark, seed=0, n=300, copies=40):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    rows = []
    for i in range(n):
        c = 0 if i % 3 == 0 else int(r.integers(12))
        rows.append((f"s{i:04}", "one", [float(np.float32(x)) for x in centres[c] + 0.3 * r.normal(size=16)], 1, "clash", "clash"))
    rows += [(f"d{i:04}", "one", rows[5][2], 1, "", "") for i in range(copies)]
    rows += [(f"w{i}", "two", [float(np.float32(x)) for x in r.normal(size=5)], 1, "", "") for i in range(4)]
    rows += [(f"w{i}", "one", [float(np.float32(x)) for x in r.normal(size=5)], 1, "", "") for i in range(2)]  # later replaced by nothing: same id, other width
    rows = [x for x in rows if not (x[1] == "one" and x[0].startswith("w"))]
    rows += rows[:20]
    bad = [("z1", "one", None, 1, "", ""), ("z2", "one", [0.0] * 16, 1, "", ""), ("z3", "one", [], 1, "", ""), ("z4", "one", [float("nan")] * 16, 1, "", ""), (None, "one", [1.0] * 16, 1, "", ""), ("z5", "lone", [1.0, 2.0], 1, "", "")]
    return rows, spark.createDataFrame(rows + bad, SCHEMA)


def exact(rows, k):
    out = set()
    seen = {i: (e, np.array(v, np.float64)) for i, e, v, *_ in rows}
    for e in {x for x, _ in seen.values()}:
        ids = sorted(i for i in seen if seen[i][0] == e)
        x = np.stack([seen[i][1] for i in ids])
        n = np.linalg.norm(x, axis=1)
        s = np.round(x @ x.T / (n[:, None] * n[None]), 9)
        for a, i in enumerate(ids):
            for j in sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]:
                out.add((i, ids[j]))
    return out


@pytest.mark.parametrize("shard_points,chunk", [(8192, 16384), (40, 30)])
def test_neighbours_match_brute_force(spark, shard_points, chunk):
    rows, df = table(spark)
    vecs = usable_vectors(df, "segment_id", "app_encoder", "app_mean", "indexed_at")
    got = {(r["id"], r["neighbour"]) for r in most_similar(vecs, 5, cell_points=30, visits=40, reach=9.0, shard_points=shard_points, chunk_queries=chunk).collect()}
    want = exact(rows, 5)
    assert len(got & want) >= 0.97 * len(want) and len(got) == len(want)
    copies = {r for r in want if r[0].startswith("d")}
    assert copies <= got


def test_nothing_usable(spark):
    _, df = table(spark)
    vecs = usable_vectors(df.filter("segment_id LIKE 'z%' AND app_encoder = 'one'"), "segment_id", "app_encoder", "app_mean")
    assert most_similar(vecs).count() == 0 and choose_varied(vecs, 5).count() == 0


def test_graph_recall_in_one_cloud():
    x = np.random.default_rng(1).normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    s = x @ x.T
    want = np.argsort(-s, axis=1)[:, :6]
    for found in (g.search(x, 96, np.arange(len(x))), Graph.of(g.arrays()).search(x, 96)):
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(want, found)]) > 0.95
    assert Graph(x[:0]).search(x[:3]).max() == -1 and Graph(x[:1]).search(x[:1], own=np.array([0]))[0, 0] == 0


def test_subset_is_varied_and_gains_add_up(spark):
    rows, df = table(spark, n=900, copies=400)
    vecs = usable_vectors(df, "segment_id", "app_encoder", "app_mean", "indexed_at")
    picks = choose_varied(vecs, 30).orderBy("rank").collect()
    assert [p["rank"] for p in picks] == list(range(1, 31)) and len({p["id"] for p in picks}) == 30
    assert sum(p["id"].startswith("d") for p in picks) <= 4  # a third of the rows, but one place
    seen = {i: (e, np.array(v, np.float64)) for i, e, v, *_ in [*rows, ("z5", "lone", [1.0, 2.0])]}
    total, best = 0.0, {i: 0.0 for i in seen}
    for p in picks[:5]:
        e, v = seen[p["id"]]
        gain = 0.0
        for i, (f, u) in seen.items():
            c = max(0.0, float(u @ v / np.linalg.norm(u) / np.linalg.norm(v))) if f == e else 0.0
            gain += max(0.0, c - best[i])
            best[i] = max(best[i], c)
        total += gain
        assert p["gain"] == pytest.approx(gain) and p["coverage"] == pytest.approx(total / len(seen))
    assert [p["id"] for p in choose_varied(vecs, 10).orderBy("rank").collect()] == [p["id"] for p in picks[:10]]
    few = usable_vectors(df.filter("segment_id < 's0003' AND segment_id > 's'"), "segment_id", "app_encoder", "app_mean")
    assert choose_varied(few, 10).count() == 3
