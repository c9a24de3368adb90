"""Readers with explicit schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of video files.
VIDEO_ENDINGS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".mpg", ".mpeg", ".ts")
CAPTION_COLUMNS = {
    "segment_id": "int", "start_frame": "int", "end_frame": "int", "start_time": "string", "end_time": "string", "station": "string", "verb": "string", "object_name": "string", "object_color": "string",
    "object_shape": "string", "object_context": "string", "caption": "string", "hand_left_action": "string", "hand_left_object": "string", "hand_right_action": "string", "hand_right_object": "string",
    "confidence": "double", "model": "string", "error": "string",
}
DESCRIPTION_SCHEMA = "video_level struct<task: struct<task_name: string, task_description: string>, l1_environment: string, l2_venue: string, l3_scene: string>, windows array<struct<task: struct<task_description: string, description: string>>>"


def media_paths(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size``: video files below a folder, in order of path, without reading their content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return r.filter(ends.isin(*VIDEO_ENDINGS)).orderBy("path")


def video_id(path: Column, size: Column) -> Column:
    """Identity of a file from its path and size."""
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"))), 1, 12)


def segment_id(video: Column, t0: Column, t1: Column) -> Column:
    return F.concat(video, F.lit(":"), F.rint(t0).cast("bigint").cast("string"), F.lit("-"), F.rint(t1).cast("bigint").cast("string"))


def caption_id(path: Column) -> Column:
    """Recording id from the folders between ``captioning`` and the file (or the last seven), without ``segments``."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[a-z]+:/*", "/"), "/"), lambda p: p != "")
    n = F.size(parts)
    mark = F.array_position(parts, "captioning").cast("int")
    inner = F.when(mark > 0, F.slice(parts, mark + 1, F.greatest(n - mark - 1, F.lit(0)))).otherwise(F.slice(parts, F.greatest(n - 7, F.lit(1)), F.least(n - 1, F.lit(7))))
    return F.array_join(F.filter(inner, lambda p: p != "segments"), "__")


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """Caption segments of all files below a folder: usable ones, with seconds, in order of start.

    Files end in ``.parquet`` or, misleadingly, ``.parquet.zst``; missing columns are null.
    """
    from ..functions.vec import parse_seconds

    r = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet*").option("ignoreCorruptFiles", "true").parquet(folder)
    cols = [(F.col(c) if c in r.columns else F.lit(None)).cast(t).alias(c) for c, t in CAPTION_COLUMNS.items()]
    r = r.select(caption_id(F.col("_metadata.file_path")).alias("video_id"), *cols)
    r = r.withColumn("t0", parse_seconds(F.col("start_time"))).withColumn("t1", parse_seconds(F.col("end_time")))
    return r.filter(F.coalesce(F.trim("error"), F.lit("")).isin("") & (F.col("t1") > F.col("t0"))).orderBy("video_id", "t0")


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file: id, whole text, task name, environment labels, number of windows."""
    r = spark.read.schema(DESCRIPTION_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    texts = F.transform("windows", lambda w: F.coalesce(F.nullif(w["task"]["task_description"], F.lit("")), w["task"]["description"], F.lit("")))
    full = F.concat_ws(" ", F.coalesce("video_level.task.task_description", F.lit("")), F.array_join(F.coalesce(texts, F.array()), " "))
    return r.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("video_id"), full.alias("full"), F.trim(F.coalesce("video_level.task.task_name", F.lit(""))).alias("name"),
                    F.coalesce("video_level.l1_environment", F.lit("")).alias("l1"), F.coalesce("video_level.l2_venue", F.lit("")).alias("l2"), F.coalesce("video_level.l3_scene", F.lit("")).alias("l3"),
                    F.coalesce(F.size(F.coalesce("windows", F.array())), F.lit(0)).alias("n_windows"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a known schema; columns are added with ``withColumns`` and written to a new place."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def label_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs from a YAML file with ``pairs: [{a, b, same_env, same_task}]``."""
    import yaml

    with open(path) as f:
        given = (yaml.safe_load(f) or {}).get("pairs") or []
    rows = [(p["a"], p["b"], p.get("same_env"), p.get("same_task")) for p in given]
    return spark.createDataFrame(rows, "a string, b string, same_env boolean, same_task boolean")


def hand_tracks(spark: SparkSession, folder: str, glob: str = "*.npz") -> DataFrame:
    """``episode, fps, frame, hand, x, y, z``: wrist positions of the wearer's hands from archives.

    Frames and rates are divided by the archive's stride; dropped detections and other people's hands
    are left out.  An unreadable archive gives one row with its reason in ``error``.
    """
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    cols = ["episode", "fps", "frame", "hand", "x", "y", "z", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as d:
                        step = max(int(d["step"]), 1) if "step" in d.files else 1
                        use = d["kept"].astype(bool) & d["is_wearer"].astype(bool) & np.isin(d["hand"], (0, 1))
                        wrist = d["kp3d_cam"][use][:, 0, :].astype(float)
                        yield pd.DataFrame({"episode": name, "fps": float(d["fps"]) / step, "frame": d["frame_idx"][use] // step, "hand": d["hand"][use], "x": wrist[:, 0], "y": wrist[:, 1], "z": wrist[:, 2], "error": None}, columns=cols)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])], columns=cols)

    return r.select("path", "content").mapInPandas(run, "episode string, fps double, frame int, hand int, x double, y double, z double, error string")


def with_step_reason(tracks: DataFrame, stride: str = "step") -> DataFrame:
    """Adds ``skipped``: why an episode with a stride above one is not analysed; null for the others."""
    return tracks.withColumn("skipped", F.when(F.col(stride) > 1, F.concat(F.lit("stride "), F.col(stride).cast("string"))))
