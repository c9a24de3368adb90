"""Writers, all behind an allowlist of destinations."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


class Refused(PermissionError):
    """The destination is not under an allowed prefix."""


@dataclass(frozen=True)
class Guard:
    """Destinations that may be written."""

    prefixes: tuple[str, ...]

    def check(self, path: str) -> str:
        clean = path.rstrip("/")
        if ".." in clean.split("/") or not any(clean == p.rstrip("/") or clean.startswith(p.rstrip("/") + "/") for p in self.prefixes):
            raise Refused(f"{path!r} is not under any of {list(self.prefixes)}")
        return path


def upsert_segments(new: DataFrame, path: str, guard: Guard, key: str = "segment_id", version: str = "indexed_at", buckets: int = BUCKETS) -> None:
    """Writes segments so that a later version of a key replaces the earlier one.

    The table is partitioned by a hash bucket of the recording; only buckets that receive rows are
    rewritten (to a new place first, since a table cannot be read and overwritten at once).
    """
    guard.check(path)
    spark = new.sparkSession
    new = new.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        new = new.unionByName(old.filter(F.col("bucket").isin(touched)), allowMissingColumns=True)
    rest = [c for c in new.columns if c != key]
    best = new.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("b")).select(key, "b.*")
    from ..runtime import cut

    cut(best).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def save_table(df: DataFrame, path: str, guard: Guard) -> None:
    """Small artefacts such as null models, whiteners and weights."""
    df.write.mode("overwrite").parquet(guard.check(path))


def save_pairs(df: DataFrame, path: str, guard: Guard, by: str = "episode") -> None:
    """Pairs as CSV, one folder per episode."""
    df.write.mode("overwrite").partitionBy(by).option("header", "true").csv(guard.check(path))


def save_session_tree(tables: dict[str, DataFrame], path: str, guard: Guard) -> None:
    """The four report tables, each as CSV in a folder of its name."""
    guard.check(path)
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path.rstrip('/')}/{name}")


def save_selection(order: list[str], gains: list[float], fractions: list[float], knee: int, path: str, guard: Guard) -> None:
    with open(guard.check(path), "w") as f:
        json.dump({"order": order, "gains": gains, "coverage_fraction": fractions, "knee": knee}, f)


def cut_clips(segments: DataFrame, cut: Callable[[str, float, float, str], None], path: str, guard: Guard) -> DataFrame:
    """Cuts a clip per segment (``path, t0, t1, n_cycles, period_s``) on the executors; ``name, error`` per clip."""
    guard.check(path)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            out = []
            for p, t0, t1, n, s in zip(b["path"], b["t0"], b["t1"], b["n_cycles"], b["period_s"]):
                name = f"{path.rstrip('/')}/{t0:.0f}-{t1:.0f}_{n}x{s:.2f}s.mp4"
                try:
                    cut(p, t0, t1, name)
                    out.append((name, None))
                except Exception as e:  # noqa: BLE001
                    out.append((name, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["name", "error"])

    return segments.select("path", "t0", "t1", "n_cycles", "period_s").mapInPandas(run, "name string, error string")


def html_report(kpis: dict[str, float], picks: list[tuple[str, float, float]], heat: list[list[float]], calibrated: bool, small: int = 30) -> str:
    """A page from aggregates only: figures, coverage curve, gain bars, order and a heat map of at most 200 x 200."""
    if len(heat) > 200 or len(picks) > 5_000:
        raise ValueError("aggregate before reporting")
    warn = ([] if calibrated else ["UNCALIBRATED: scores are raw, not percentiles of this corpus."]) + (["Small corpus: percentiles are coarse."] if kpis.get("segments", 0) < small else [])
    esc = html.escape
    top = max((g for _, g, _ in picks), default=1.0) or 1.0
    bars = "".join(f'<tr><td>{i + 1}</td><td>{esc(n)}</td><td><div style="width:{200 * g / top:.0f}px;height:9px;background:#468"></div></td><td>{g:.4f}</td><td>{c:.3f}</td></tr>' for i, (n, g, c) in enumerate(picks))
    curve = " ".join(f"{20 + 360 * i / max(len(picks) - 1, 1):.1f},{180 - 160 * c:.1f}" for i, (_, _, c) in enumerate(picks))
    cells = "".join("<tr>" + "".join(f'<td style="background:rgba(30,80,160,{min(max(v, 0), 1):.2f});width:6px;height:6px"></td>' for v in row) + "</tr>" for row in heat)
    return (
        "<!doctype html><meta charset=utf-8><title>Corpus report</title>" + "".join(f"<p><b>{esc(w)}</b></p>" for w in warn)
        + "<ul>" + "".join(f"<li>{esc(k)}: {v:g}</li>" for k, v in kpis.items()) + f'</ul><svg width=400 height=200><polyline fill="none" stroke="#468" points="{curve}"/></svg>'
        + f"<table>{bars}</table><table style='border-spacing:0'>{cells}</table>"
    )


def annotate_csv(source: DataFrame, columns: dict[str, Column], path: str, guard: Guard) -> None:
    """Writes a table read from CSV with further columns to a new place, so that a failed run leaves the source whole."""
    guard.check(path)
    bare = lambda p: re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", p).rstrip("/") + "/"
    if any(bare(f).startswith(bare(path)) for f in source.inputFiles()):
        raise Refused(f"{path!r} holds the source itself")
    source.withColumns(columns).write.mode("overwrite").option("header", "true").csv(path)
