from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import quantiles as Q
from spanloom.llm.components import connected_groups
from spanloom.llm.naming import Namer, count_names, count_stems, letters, one_slip, stem
from spanloom.llm.runs import canonical, collapse_runs, fit_namers, keyed


def groups_of(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed,n,m,hot_min", [(0, 40, 30, 10**6), (1, 60, 50, 3), (2, 200, 100, 5)])
def test_groups_match_union_find(spark, seed, n, m, hot_min):
    r = random.Random(seed)
    links = [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)] + [("hub", f"s{i}") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    links += links[:10] + [(None, "v1"), ("v2", None), ("alone", "alone")]
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "a string, b string, v string")
    got = {x["vertex"]: x["group_id"] for x in connected_groups(df, "a", "b", hot_min=hot_min).collect()}
    assert got == groups_of(links)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([(None, "a"), ("b", "b")], "a string, b string")
    assert connected_groups(df, "a", "b").count() == 0


def sketch_of(spark, rows, groups=("g",)):
    df = spark.createDataFrame(rows, "g string, day int, v double").withColumn("bucket", Q.bucket_key(F.col("v")))
    return Q.sketch(df, list(groups))


def test_percentiles_keep_the_stated_error_and_merge(spark):
    r = random.Random(5)
    vals = {g: [r.choice([r.gauss(0, 1), r.lognormvariate(0, 4), -r.lognormvariate(0, 4), 0.0, 1e-300, -1e-12]) for _ in range(n)] for g, n in (("a", 3000), ("b", 1), ("c", 2))}
    rows = [(g, i % 7, v) for g, vs in vals.items() for i, v in enumerate(vs)] + [("a", 1, None), ("a", 1, float("nan")), ("a", 2, float("inf")), (None, 1, 2.0)]
    daily = sketch_of(spark, rows, ("g", "day"))
    merged = {x["g"]: x for x in Q.percentiles(Q.merge(daily, ["g"]), ["g"]).collect()}
    direct = {x["g"]: x for x in Q.percentiles(sketch_of(spark, rows), ["g"]).collect()}
    for g, vs in vals.items():
        assert merged[g]["n_values"] == len(vs) and merged[g]["quantiles"] == direct[g]["quantiles"]
        s = np.sort(vs)
        at = np.arange(201) / 200 * (len(s) - 1)
        lo, hi = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
        exact = lo + (hi - lo) * (at - np.floor(at))
        assert (np.abs(np.array(merged[g]["quantiles"]) - exact) <= Q.ALPHA * 1.000001 * np.maximum(np.abs(lo), np.abs(hi)) + 1e-300).all()
    assert None in merged
    assert Q.percentiles(sketch_of(spark, [("a", 1, None)]), ["g"]).count() == 0


def test_names():
    assert [stem(w) for w in ("tightening", "tightened", "tightens", "tighten")] == ["tighten"] * 4
    assert stem("plugging") == stem("plugs") == stem("plugged") and stem("carries") == stem("carried") == stem("carrying") == stem("carry")
    assert stem("calibrating") == stem("calibrate") == stem("calibrates") and stem("housings") == stem("housing")
    assert letters("  The_Gear\xa0hou​sing.  ") == "the gear housing" and letters(None) == ""
    assert one_slip("welding", "wedling") and one_slip("weld", "wel") and one_slip("weld", "wweld") and not one_slip("weld", "hold") and not one_slip("pack", "stack")
    spelt = {"weld": 900, "stacking": 800, "sorting": 700, "gear housing": 900, "wled": 1, "frobbing": 1}
    n = Namer(count_stems(spelt), count_names(spelt))
    assert n.name('"Wleding"') == n.name("welds") == "weld" and n.name("a  GEAR housinn") == n.name("gear_housings")
    assert n.name("frobbed") == n.name("frob") == "frob"
    assert n.name("gearzhousings") == n.name("gearhousing") == n.name("te gear housing") == "gear hous"
    seen = {"shoe upper": 500, "zipper": 500}
    assert Namer(count_stems(seen), count_names(seen)).name("the zpper") == "zipper"
    for missing in ("", None, " N/A ", "-", "None.", "null", "UNKNOWN", "nan"):
        assert n.name(missing) is None


def test_words_that_look_alike_stay_apart_without_evidence():
    for counts in ({"nut": 3, "net": 2, "cap": 4, "cup": 3}, {"nut": 1000, "net": 60, "cap": 1000, "cup": 900}, {"nut": 1, "net": 1, "cap": 1, "cup": 1}):
        n = Namer(count_stems(counts), count_names(counts))
        assert n.name("nut") == "nut" and n.name("net") == "net" and n.name("cap") == "cap" and n.name("cups") == "cup"
    spelt = {f"w{i}x{i * 7919}": 3 for i in range(4000)} | {"tightening": 40, "tihgtening": 1, "glass panel": 600, "lass panel": 20}
    n = Namer(count_stems(spelt), count_names(spelt))  # most words are rarer than a thousandth
    assert n.name("tihgtening") == n.name("tightened") and n.name("lass panels") == n.name("glass panel")
    assert n.name("lass") != n.name("glass")  # too common for a slip where no other word vouches for it


def test_slips_in_both_fields_join_a_run(spark):
    rows = [("tightening", "cable drum")] * 300 + [("tihgtening", "cabel drum"), ("tightenign", "cable durm"), ("tightened", "the cable drums")]
    df = spark.createDataFrame(rows, "verb string, obj string")
    keys = [x[0] for x in df.select(canonical(df, ["verb", "obj"], fit_namers(df, ["verb", "obj"])).alias("k")).collect()]
    assert len(set(keys)) == 1


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_one_slip_is_the_bounded_edit_distance(a, b):
    near = {a} | {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in "abc"} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"}
    near |= {a[:i] + a[i + 1] + a[i] + a[i + 2:] for i in range(len(a) - 1)}
    assert one_slip(a, b) == (b in near)


def brute_runs(rows, pause):
    best = {}
    for e, ev, s, t, k, ver in rows:
        if (e, ev) not in best or (ver, s, t, k or "") > best[e, ev]:
            best[e, ev] = (ver, s, t, k or "")
    out = set()
    for e in {x for x, _ in best}:
        evs = sorted((v[1], ev, v[2], v[3] or None) for (x, ev), v in best.items() if x == e)
        run, reach = [], None
        for s, ev, t, k in [*evs, (None, None, None, None)]:
            stop = not run or k is None or k != run[-1][3] or s - reach > pause
            if stop and run:
                out.add((e, run[0][3], len(run), run[0][1], run[-1][1], run[0][0], max(x[2] for x in run)))
                run = []
            if k is not None:
                run.append((s, ev, t, k))
            if t is not None:
                reach = t if reach is None else max(reach, t)
    return out


@pytest.mark.parametrize("seed,huge_min", [(1, 10**9), (2, 30), (3, 10), (4, 5)])
def test_runs_match_brute_force_across_shards(spark, seed, huge_min):
    r = random.Random(seed)
    rows = []
    for i in range(500):
        s = r.randrange(4000)
        rows.append((r.choice(["hot"] * 8 + ["a", None]), i, s, s + r.choice([1, 5, 40, 900]), r.choice(["x", "x", "x", "y", None]), 1))
    rows += [(*row[:4], row[4], 2) for row in rows[:40]] + rows[:20]
    df = spark.createDataFrame(rows, "ent string, id int, s_ms bigint, e_ms bigint, k string, ver int").withColumn("run", F.lit("clash")).withColumn("n", F.lit(0))
    got = [tuple(x)[:7] for x in collapse_runs(df, "ent", "id", "k", "ver", pause_ms=25, huge_min=huge_min, shards=8).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_runs(rows, 25)


def test_canonical_keys_from_data(spark):
    rows = [("weld", "lid")] * 900 + [("Welding.", "The LIDS"), ("wleding", "lid"), ("n/a", "lid"), (None, "lid"), ("weld", "")]
    df = spark.createDataFrame(rows, "verb string, obj string")
    keys = [x[0] for x in df.select(canonical(df, ["verb", "obj"], fit_namers(df, ["verb", "obj"])).alias("k")).collect()]
    assert keys[:902] == ["weld|lid"] * 902 and keys[902:] == [None, None, None]
    empty = df.filter("false")
    assert collapse_runs(spark.createDataFrame([], "e string, id int, s_ms bigint, e_ms bigint, k string"), "e", "id", "k").count() == 0
    assert [n.stems for n in fit_namers(empty, ["verb", "obj"])] == [{}, {}]


def test_slips_are_traced_back_to_any_number_of_stems():
    r = random.Random(4)
    spelt = {"".join(r.choice("abcdghkmnprtu") for _ in range(9)): 1000 for _ in range(4200)} | {"tightening": 40, "tihgtening": 1}
    n = Namer(count_stems(spelt), count_names(spelt))  # 4,200 stems are more frequent than the right one
    assert n.name("tihgtening") == "tighten"


def test_no_name_is_too_long_and_no_word_has_too_many_options():
    long = "red steel front wheel axle cover bolt cap"
    spelt = {long: 500, "cup": 40, "red stele forn whele axel cvoer bolt cap": 1} | {w: 500 for w in long.split()}
    n = Namer(count_stems(spelt), count_names(spelt))
    assert n.name("red stele front whele axle cover bolt cap") == n.name(long) == n.name("red steel front wheel axle cover bolt cpa")
    assert n.name("red steel front wheel axle cover bolt cup") == n.name(long) and n.name("cup") == "cup"  # the other seven words vouch
    many = {"mabel": 900, "label": 800, "cabel": 700, "babel": 600, "sabel": 500, "gabel housing": 400, "gabel": 1}
    assert Namer(count_stems(many), count_names(many)).name("xabel housing") == "gabel hous"  # the sixth of six options makes a known name


@pytest.mark.parametrize("kept,indexed", [(10, 10**6), (10**6, 3)])
def test_names_beyond_what_is_held_are_found_by_joins(spark, kept, indexed):
    r = random.Random(9)
    vocab = ["tighten", "glass", "panel", "cap", "gear", "housing", "nut", "welder", *("".join(r.choice("abcehilnorst") for _ in range(r.choice([3, 5, 7]))) for _ in range(40))]
    names = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 7]))) for _ in range(60)]
    rows = [["weld", "weldx"][r.random() < 0.01] for _ in range(1500)]
    rows = [(v, names[min(int(r.expovariate(0.1)), 59)]) for v in rows]
    for i in range(0, 1500, 5):
        w = list(rows[i][1])
        at = r.randrange(len(w))
        w[at] = r.choice(["", "x", "e", w[at] * 2, " "])
        rows[i] = (rows[i][0], r.choice(["The ", "te ", ""]) + "".join(w).upper())
    # a slip for "quantor" explains no other word; what is two slips away from it is a word of its own
    rows += [("weld", "quantor")] * 2000 + [("weld", "quantov")] * 90 + [("weld", "quantovk")] * 5 + [("weld", "quantovkz"), (None, "cap"), ("weld", None), ("weld", " N/A "), ("weld", "the"), ("weld", "...")]
    df = spark.createDataFrame(rows, "verb string, obj string")
    spelt = [{k: n for k, n in zip(*np.unique([x[i] for x in rows if x[i] is not None], return_counts=True))} for i in (0, 1)]
    verb, obj = (Namer(count_stems(s), count_names(s)) for s in spelt)
    assert obj.name("quantovkz") == obj.name("quantovk") == "quantovk" and obj.name("quantov") == "quantor"
    namers = fit_namers(df, ["verb", "obj"], kept, indexed)
    assert isinstance(namers[0], Namer) and not isinstance(namers[1], Namer)
    got = keyed(df, ["verb", "obj"], namers).collect()
    want = {x: None if None in (verb.name(x[0]), obj.name(x[1])) else f"{verb.name(x[0])}|{obj.name(x[1])}" for x in set(rows)}
    assert len(got) == len(rows) and {(x["verb"], x["obj"]): x["key"] for x in got} == want


def test_runs_of_rare_names_in_a_large_vocabulary(spark, tmp_path):
    import datetime

    import __spark_entry__ as E

    r = random.Random(6)
    words = sorted({"".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(9)) for _ in range(20_500)})
    rows = [("v", 3 * i + j, 10.0 * (3 * i + j), 10.0 * (3 * i + j) + 5, "weld", w) for i, w in enumerate(words) for j in range(3)]
    rows += [("z", i, 10.0 * i, 10.0 * i + 5, "weld", w) for i, w in enumerate(["zyxquarkling"] * 20 + ["zyxqaurkling", "zyxquarkling", "zyquarkling"])]
    rows = [(*x, None, datetime.datetime(2025, 1, 1)) for x in rows]
    spark.createDataFrame(rows, "video_id string, segment_id int, t0 double, t1 double, verb string, object_name string, error string, captioned_at timestamp").write.parquet(f"{tmp_path}/caption_segments.parquet")
    got = {tuple(x) for x in E.queries()["p6_found"](spark, str(tmp_path)).collect()}
    assert got == {("v", 3 * i, 3 * i + 2) for i in range(len(words))} | {("z", 0, 22)}
