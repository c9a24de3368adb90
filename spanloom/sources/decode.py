"""The seam to video decoding.  Pixels are decoded on executors by a pluggable decoder, never on the driver."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DecoderMissing(RuntimeError):
    """No decoder is installed where a frame was asked for."""


@dataclass(frozen=True)
class Request:
    """What to decode: a span, a rate or explicit times, a size, a colour mode."""

    path: str
    t0: float = 0.0
    t1: float | None = None
    fps: float | None = None
    times: tuple[float, ...] | None = None
    width: int = 0
    height: int = 0
    gray: bool = False
    keyframes: bool = False


#: A decoder yields blocks of frames (n, h, w, c) of type uint8 with their times in seconds.
Decoder = Callable[[Request], Iterator[tuple[np.ndarray, np.ndarray]]]


def parse_rate(text: str | None) -> float:
    """Frames per second from ``30000/1001`` or a plain number; 0 if unknown."""
    if not text or text in ("0/0", "N/A"):
        return 0.0
    top, _, low = text.partition("/")
    return float(top) / float(low) if low and float(low) else 0.0 if low else float(top)


def probe_file(path: str, tool: str = "ffprobe") -> dict:
    """Duration, size, rate, frames and codec of a file."""
    if shutil.which(tool) is None:
        raise DecoderMissing(f"{tool} is not installed on this machine")
    said = subprocess.run([tool, "-v", "error", "-select_streams", "v:0", "-show_streams", "-show_format", "-of", "json", path], capture_output=True, text=True, check=True, timeout=120)
    d = json.loads(said.stdout)
    s = d["streams"][0]
    duration = float(s.get("duration") or d["format"].get("duration") or 0)
    fps = parse_rate(s.get("avg_frame_rate"))
    return {"duration_s": duration, "width": int(s["width"]), "height": int(s["height"]), "fps": fps, "n_frames": int(s.get("nb_frames") or round(duration * fps)), "codec": s.get("codec_name", "")}


def ffmpeg_frames(r: Request, tool: str = "ffmpeg", block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frames from a decoder process, a block at a time, so memory stays bounded; the span is cut by the decoder."""
    if shutil.which(tool) is None:
        raise DecoderMissing(f"{tool} is not installed on this machine")
    if not r.width or not r.height:
        raise ValueError("frames need a size")
    span = ["-ss", str(r.t0)] + (["-t", str(r.t1 - r.t0)] if r.t1 is not None else [])
    chain = ([f"fps={r.fps}"] if r.fps else []) + [f"scale={r.width}:{r.height}"]
    cmd = [tool, "-v", "error", *(["-skip_frame", "nokey"] if r.keyframes else []), *span, "-i", r.path, "-vf", ",".join(chain), "-f", "rawvideo", "-pix_fmt", "gray" if r.gray else "rgb24", "-"]
    c = 1 if r.gray else 3
    size, seen = r.width * r.height * c, 0
    with subprocess.Popen(cmd, stdout=subprocess.PIPE) as p:
        while data := p.stdout.read(size * block):
            n = len(data) // size
            frames = np.frombuffer(data[: n * size], np.uint8).reshape(n, r.height, r.width, c)
            yield frames, r.t0 + (seen + np.arange(n)) / (r.fps or 1.0)
            seen += n
    if not seen:
        raise ValueError(f"no frame came out of {r.path}")


def ffmpeg_frame_at(r: Request, tool: str = "ffmpeg") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One frame at each of the request's times, every one found by a seek of its own, so little of a remote file is read."""
    if shutil.which(tool) is None:
        raise DecoderMissing(f"{tool} is not installed on this machine")
    for t in r.times or ():
        cmd = [tool, "-v", "error", "-ss", str(t), "-i", r.path, "-frames:v", "1", "-vf", f"scale={r.width}:{r.height}", "-f", "rawvideo", "-pix_fmt", "gray" if r.gray else "rgb24", "-"]
        data = subprocess.run(cmd, capture_output=True, timeout=120).stdout
        c = 1 if r.gray else 3
        if len(data) == r.width * r.height * c:
            yield np.frombuffer(data, np.uint8).reshape(1, r.height, r.width, c), np.array([t])


def eager(decoder: Decoder, request: Request) -> tuple[np.ndarray, np.ndarray]:
    """All frames of a request and their times; raises if there are none."""
    blocks = list(decoder(request))
    if not sum(len(f) for f, _ in blocks):
        raise ValueError(f"no frame came out of {request.path}")
    return np.concatenate([f for f, _ in blocks]), np.concatenate([t for _, t in blocks])


def sample_keyframes(path: str, duration: float, width: int, height: int, k: int | None = None, decoder: Decoder = ffmpeg_frames) -> tuple[np.ndarray, np.ndarray]:
    """The key frames of a file, thinned to k; their times are taken as evenly spaced over its duration."""
    frames, _ = eager(decoder, Request(path, 0.0, None, None, None, width, height, keyframes=True))
    at = np.arange(len(frames)) if k is None else even_places(len(frames), k)
    return frames[at], keyframe_times(len(frames), duration, k)


def sample_remote(path: str, duration: float, width: int, height: int, k: int, decoder: Decoder = ffmpeg_frame_at) -> tuple[np.ndarray, np.ndarray]:
    """Single frames at k even times of a remote file, away from its first and last two seconds (or two percent)."""
    lo, hi = min(2.0, duration * 0.02), max(duration - 2.0, duration * 0.98)
    return eager(decoder, Request(path, times=tuple(np.linspace(lo, hi, k).tolist()), width=width, height=height))


def probe(files: DataFrame, path: str = "path", tool: Callable[[str], dict] = probe_file) -> DataFrame:
    """Metadata of every file; a file that cannot be read keeps its row, with the reason in ``error``."""
    schema = "path string, duration_s double, width int, height int, fps double, n_frames bigint, codec string, error string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    rows.append({"path": p, **tool(p), "error": None})
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append({"path": p, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    return files.select(F.col(path).alias("path")).mapInPandas(run, schema)


def frames(segments: DataFrame, fps: float, width: int, height: int, gray: bool = False, decoder: Decoder = ffmpeg_frames) -> DataFrame:
    """``segment_id, ts, h, w, c, pixels, error`` of segments ``segment_id, path, t0, t1``, streamed block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["segment_id", "ts", "h", "w", "c", "pixels", "error"]
        for b in batches:
            for s, p, t0, t1 in zip(b["segment_id"], b["path"], b["t0"], b["t1"]):
                try:
                    for block, ts in decoder(Request(p, t0, t1, fps, None, width, height, gray)):
                        yield pd.DataFrame([(s, float(t), *f.shape, f.tobytes(), None) for f, t in zip(block, ts)], columns=cols)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(s, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])], columns=cols)

    return segments.select("segment_id", "path", "t0", "t1").mapInPandas(run, "segment_id string, ts double, h int, w int, c int, pixels binary, error string")


def even_places(n: int, k: int) -> np.ndarray:
    """At most k evenly spaced places among n, the first and the last among them."""
    return np.arange(n) if n <= k else np.rint(np.linspace(0, n - 1, k)).astype(int)


def remote_times(duration: Column, k: int) -> Column:
    """Times for k single-frame reads of a remote file, away from its first and last two seconds (or two percent)."""
    lo, hi = F.least(F.lit(2.0), duration * 0.02), F.greatest(duration - 2.0, duration * 0.98)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: lo + (hi - lo) * i / max(k - 1, 1))


def keyframe_times(n: int, duration: float, k: int | None = None) -> np.ndarray:
    """Times of n key frames, taken as evenly spaced over the duration, thinned to k."""
    ts = np.linspace(0.0, duration, n) if n else np.zeros(0)
    return ts if k is None else ts[even_places(n, k)]
