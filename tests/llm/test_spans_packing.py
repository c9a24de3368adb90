from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import spanloom.llm.shared_spans as shared_spans_module
from spanloom.llm.packing import Bins, first_fit_decreasing, pack, with_token_counts
from spanloom.llm.shared_spans import Automaton, shared_spans


def records(seed):
    r = random.Random(seed)
    new = lambda n: [r.getrandbits(63) for _ in range(n)]
    pool = [new(30) for _ in range(4)]
    out = []
    for i in range(80):
        v = new(r.choice([5, 12, 40]))
        if r.random() < 0.6:
            p = r.choice(pool)
            a = r.randrange(0, 12)
            n = r.choice([6, 11, 12, 13, 18])
            at = r.randrange(len(v) + 1)
            v = v[:at] + p[a : a + n] + v[at:]
        out.append((f"r{i:02}", f"o{i % 30}", v))
    still = [7] * 20
    out += [(f"f{i}", f"q{i % 6}", [7] * 30) for i in range(12)] + [("e1", "q1", out[3][2]), ("e2", out[4][1], out[4][2])]  # frozen streams and copies
    out += [(f"t{i}", f"p{i}", still + new(3)) for i in range(25)]
    return out


def brute(rows, least):
    grams = {}
    for i, o, v in rows:
        for a in range(len(v) - least + 1):
            grams.setdefault(tuple(v[a : a + least]), set()).add((i, o))
    pairs, cover = set(), {}
    for i, o, v in rows:
        for a in range(len(v) - least + 1):
            others = {(j, p) for j, p in grams[tuple(v[a : a + least])] if p != o}
            pairs |= {(min(i, j), max(i, j)) for j, _ in others if j != i}
            if others:
                cover.setdefault(i, set()).update(range(a, a + least))
    return pairs, cover


@pytest.mark.parametrize("shard,most,each", [(2000, 10**6, 10**5), (2000, 10**6, 200), (2000, 0, 1), (6, 0, 1)])
def test_spans_match_brute_force_broadcast_routed_and_split(spark, monkeypatch, shard, most, each):
    monkeypatch.setattr(shared_spans_module, "SHARD_VALUES", each)
    rows = records(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows] + [("n1", "o1", None, 1, ""), ("n2", None, [1] * 20, 1, ""), (None, "o", [1] * 20, 1, ""), ("n3", "o3", [1, None] * 9, 1, "")], "id string, owner string, vals array<bigint>, shard int, anchor string")
    got = shared_spans(df, "id", "owner", "vals", 12, shard, most).collect()
    pairs, cover = brute(rows, 12)
    assert {(r["a"], r["b"]) for r in got if r["b"] is not None} == pairs
    seen = {}
    for r in got:
        if r["b"] is None:
            seen.setdefault(r["a"], set()).update(range(r["start"], r["end"]))
    assert seen == cover


def test_no_spans(spark):
    df = spark.createDataFrame([], "id string, owner string, vals array<bigint>")
    assert shared_spans(df, "id", "owner", "vals").count() == 0
    df = spark.createDataFrame([("a", "o", list(range(20))), ("b", "o", list(range(20)))], "id string, owner string, vals array<bigint>")
    assert shared_spans(df, "id", "owner", "vals").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=9), min_size=1, max_size=4), st.text("abc", max_size=12))
def test_matching_statistics(refs, doc):
    auto = Automaton()
    for r in refs:
        auto.add([ord(c) for c in r])
    for i, (_, n) in enumerate(auto.statistics([ord(c) for c in doc])):
        assert n == max(k for k in range(i + 2) if k == 0 or any(doc[i + 1 - k : i + 1] in r for r in refs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing_is_first_fit(sizes):
    got = first_fit_decreasing(sizes, 20)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((j for j, x in enumerate(room) if x >= sizes[i]), len(room))
        room += [20] * (b == len(room))
        room[b] -= sizes[i]
        want[i] = b
    assert got == want


def test_bins_open_in_order():
    b = Bins(4, 10)
    assert [b.place(x) for x in (10, 6, 5, 4)] == [0, 1, 2, 1] and b.opened == 3


def test_packing_keeps_every_item_whole(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0, None, -2, 5, 100, 99, 64, 250, 1000])) for i in range(400)] + [(7, 30)] * 200 + [(None, 12)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc bigint, n int, slot string, piece int")
    got = pack(df, "doc", "n", 100, len(rows), 50).collect()
    fill = {}
    for x in got:
        fill.setdefault(x["container_id"], []).append(x["length"])
        assert 0 < x["length"] <= 100 and x["start"] % 100 == 0
    assert all(sum(v) <= 100 for v in fill.values())
    items = sorted(n for _, n in rows if n and n > 0)
    assert sum(x["length"] for x in got) == sum(items)
    assert sum(x["piece"] == 0 for x in got) == len(items) and all(x["length"] == 100 for x in got if x["piece"] == 0 and x["container_id"].split("-")[1][0] == "w")
    assert len(fill) <= sum(items) / 100 * 1.3 + 14
    assert pack(df.filter("false"), "doc", "n", 100, 0).count() == 0


def test_tokens_are_counted_on_whole_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "word " * 3000), (5, "x" * 20000)], "i int, t string")
    got = {r["i"]: r["n_tokens"] for r in with_token_counts(df, "t").collect()}
    assert got[1] == got[2] == 0 and 1 < got[3] < 5 and got[4] >= 3000 and got[5] > 500
