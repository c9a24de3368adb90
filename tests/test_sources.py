from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.conf import Settings
from spanloom.registry import APPEARANCE, METRICS, encode_frames, register_metric, register_sql
from spanloom.sources import decode as D
from spanloom.sources import files as S
from spanloom.sources import sinks as K
from spanloom.streaming.ingest import new_only


def test_settings_are_strict():
    assert Settings.of({"decision": {"env_percentile": 55}}).decision.env_percentile == 55
    with pytest.raises(KeyError):
        Settings.of({"decision": {"env_percentil": 55}})
    with pytest.raises(ValueError):
        Settings.of({"decision": {"env_percentile": 155}})


def test_media_paths_and_ids(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for n in ("z.mp4", "a.MOV", "note.txt", "b/c.mkv"):
        (tmp_path / n).write_bytes(b"1234")
    got = [r["path"].rsplit("/", 1)[-1] for r in S.media_paths(spark, str(tmp_path)).collect()]
    assert got == ["a.MOV", "c.mkv", "z.mp4"]
    df = spark.createDataFrame([("/x/captioning/Ind/d/S-1/s2/001/segments/seg_3/captions.parquet",), ("/a/b/c.parquet",)], "p string")
    assert [r[0] for r in df.select(S.caption_id(F.col("p"))).collect()] == ["Ind__d__S-1__s2__001__seg_3", "a__b"]


def test_captions_tolerate_missing_columns(spark, tmp_path):
    folder = tmp_path / "captioning" / "A" / "segments" / "s1"
    spark.createDataFrame([("00:01.0", "00:03.5", "cut", None), ("00:05", "00:04", "cut", None), ("x", "00:04", "cut", None), ("0", "2", "cut", "failed")], "start_time string, end_time string, verb string, error string").coalesce(1).write.parquet(str(folder))
    got = S.captions(spark, str(tmp_path)).collect()
    assert [(r["t0"], r["t1"], r["verb"], r["station"], r["video_id"]) for r in got] == [(1.0, 3.5, "cut", None, "A__s1")]


def test_descriptions_labels_and_tracks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "u1.json").write_text(json.dumps({"video_level": {"task": {"task_name": " pack ", "task_description": "packs"}, "l1_environment": "hall"}, "windows": [{"task": {"description": "one"}}, {"task": {"task_description": "two"}}]}))
    (tmp_path / "j" / "u2.json").write_text("{}")
    got = {r["video_id"]: r for r in S.descriptions(spark, str(tmp_path / "j")).collect()}
    assert got["u1"]["full"] == "packs one two" and got["u1"]["name"] == "pack" and got["u1"]["n_windows"] == 2 and got["u2"]["n_windows"] == 0
    (tmp_path / "l.yaml").write_text("pairs:\n  - {a: x, b: y, same_env: true, same_task: false}\n")
    assert [tuple(r) for r in S.label_pairs(spark, str(tmp_path / "l.yaml")).collect()] == [("x", "y", True, False)]
    (tmp_path / "t").mkdir()
    np.savez(tmp_path / "t" / "e1.npz", kp3d_cam=np.ones((3, 21, 3)), frame_idx=np.array([0, 10, 20]), hand=np.array([0, 1, 2]), kept=np.array([1, 1, 1], bool), is_wearer=np.array([1, 1, 1], bool), fps=30.0, step=10)
    (tmp_path / "t" / "bad.npz").write_bytes(b"no archive")
    rows = S.hand_tracks(spark, str(tmp_path / "t")).collect()
    assert sorted((r["frame"], r["hand"], r["fps"]) for r in rows if r["error"] is None) == [(0, 0, 3.0), (1, 1, 3.0)]
    assert [r["episode"] for r in rows if r["error"]] == ["bad"]


def test_decode_seam(spark):
    files = spark.createDataFrame([("good",), ("bad",)], "path string")

    def tool(p):
        if p == "bad":
            raise OSError("broken")
        return {"duration_s": 2.0, "width": 4, "height": 2, "fps": 10.0, "n_frames": 20, "codec": "x"}

    got = {r["path"]: r for r in D.probe(files, tool=tool).collect()}
    assert got["good"]["n_frames"] == 20 and "broken" in got["bad"]["error"]

    def decoder(r):
        yield np.full((3, r.height, r.width, 3), 100, np.uint8), r.t0 + np.arange(3) / r.fps

    seg = spark.createDataFrame([("s", "good", 1.0, 2.0)], "segment_id string, path string, t0 double, t1 double")
    fr = D.frames(seg, 2.0, 6, 6, decoder=decoder)
    assert [r["ts"] for r in fr.orderBy("ts").collect()] == [1.0, 1.5, 2.0]
    vec = encode_frames(fr, "grid_colour").collect()
    assert len(vec) == 3 and len(vec[0]["vec"]) == APPEARANCE.get("grid_colour").width
    assert D.parse_rate("30000/1001") == pytest.approx(29.97, abs=0.01) and D.parse_rate("0/0") == 0.0 and D.even_places(5, 9).tolist() == [0, 1, 2, 3, 4]


def test_sinks_and_guard(spark, tmp_path):
    g = K.Guard((str(tmp_path / "out"),))
    with pytest.raises(K.Refused):
        g.check(str(tmp_path / "other"))
    with pytest.raises(K.Refused):
        g.check(str(tmp_path / "out" / ".." / "other"))
    path = str(tmp_path / "out" / "seg")
    mk = lambda rows: spark.createDataFrame(rows, "segment_id string, video_id string, v int, indexed_at int")
    K.upsert_segments(mk([("a", "x", 1, 1), ("b", "y", 1, 1)]), path, g)
    K.upsert_segments(mk([("a", "x", 2, 2), ("b", "y", 0, 0), ("c", "y", 5, 1)]), path, g)
    assert {(r["segment_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1), ("c", 5)}
    page = K.html_report({"segments": 3}, [("<x>", 1.0, 0.5)], [[1.0, 0.2], [0.2, 1.0]], False)
    assert "UNCALIBRATED" in page and "&lt;x&gt;" in page and "Small corpus" in page


def test_registry_and_sql(spark):
    with pytest.raises(KeyError):
        APPEARANCE.get("none")
    register_metric("same", lambda a, b: F.col(a) == F.col(b))
    assert "same" in METRICS
    register_sql(spark)
    assert spark.sql("SELECT * FROM hop_windows(95D, 30D, 20D, 10D)").count() == 5
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x",)], "k string")
    assert [r[0] for r in new_only(a, b, "k").collect()] == ["y"]
