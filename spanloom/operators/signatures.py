"""Signatures of segments from decoded frames: appearance, motion and hash tiers, one row a segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import Settings
from ..registry import APPEARANCE, TASK, Encoder
from ..runtime import spread
from ..sources.decode import Decoder, Request, even_places, ffmpeg_frames, sample_keyframes, sample_remote
from ..sources.files import segment_id
from .kernels import dominant_period, flow_descriptor, perceptual_hash, pool_motion, rhythm_spectrum, smooth

#: Sizes of the texture and colour descriptor and of the decoded pictures.
SIDE, SIGMAS, GRID, TURNS, COLOUR_GRID = 256, (1.0, 2.0, 4.0), 4, 8, 3
MOTION_SIZE, HASH_SIDE = (160, 90), 32

SCHEMA = (
    "segment_id string, app_frames array<array<float>>, app_mean array<float>, app_var array<float>, motion_pooled array<float>, motion_seq array<array<float>>, rhythm array<float>, motion_energy array<float>, "
    "period_s double, period_strength double, ego_magnitude double, phash array<bigint>, phash_ts array<double>, error string"
)


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of a plane, mirrored at its borders."""
    if sigma <= 0:
        return x
    r = min(int(np.ceil(3 * sigma)), min(x.shape) - 1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        x = np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis), k, (2, 0))
    return x


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """A picture at another size: cells are averaged, or repeated where it grows."""
    rows, cols = (np.linspace(0, n, m + 1).astype(int) for n, m in ((x.shape[0], h), (x.shape[1], w)))
    at = lambda edges, n: (np.minimum(edges[:-1], n - 1), np.maximum(np.diff(edges), 1))
    (r, rn), (c, cn) = at(rows, x.shape[0]), at(cols, x.shape[1])
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1, *x.shape[2:]))
    total[1:, 1:] = x.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    r1, c1 = np.minimum(r + rn, x.shape[0]), np.minimum(c + cn, x.shape[1])
    area = ((r1 - r)[:, None] * (c1 - c)[None, :]).reshape(len(r), len(c), *[1] * (x.ndim - 2))
    return (total[np.ix_(r1, c1)] - total[np.ix_(r, c1)] - total[np.ix_(r1, c)] + total[np.ix_(r, c)]) / area


def static_weights(frames: np.ndarray, percentile: float = 20.0, floor: float = 0.15, bottom: float = 0.0, sigma: float = 6.0) -> np.ndarray:
    """Weights of a clip's pixels: those that hardly change over time count little, with soft borders."""
    luma = frames.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if frames.shape[-1] == 3 else frames[..., 0].astype(np.float64)
    change = blur(luma.std(axis=0), sigma)
    w = np.where(change <= np.percentile(change, percentile), floor, 1.0)
    if bottom > 0:
        w[int(len(w) * (1 - bottom)) :] = floor
    return blur(w, sigma)


def _cells(plane: np.ndarray, weight: np.ndarray, grid: int, bins: int) -> np.ndarray:
    """Weighted histogram of bin numbers in every cell of a grid."""
    side = len(plane) // grid
    cut = slice(0, side * grid)
    cell = (np.arange(side * grid) // side)[:, None] * grid + (np.arange(side * grid) // side)[None, :]
    return np.bincount((cell * bins + plane[cut, cut]).ravel(), weights=weight[cut, cut].ravel(), minlength=grid * grid * bins).reshape(grid * grid, bins)


def texture_colour(frame: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """564 numbers of a picture: edge directions at three scales on a 4 x 4 grid, hue, saturation and value on a 3 x 3 grid."""
    rgb = resized(frame, SIDE, SIDE) / 255.0
    w = np.ones((SIDE, SIDE)) if weight is None else resized(weight, SIDE, SIDE)
    gray = rgb @ np.array([0.299, 0.587, 0.114])
    unit = lambda v: v / (np.linalg.norm(v) + 1e-8)
    blocks = []
    for s in SIGMAS:
        p = np.pad(blur(gray, s), 1, mode="reflect")
        across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
        gx = across[:-2] + 2 * across[1:-1] + across[2:]
        gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
        turn = np.minimum((np.arctan2(gy, gx) % np.pi / np.pi * TURNS).astype(int), TURNS - 1)
        blocks.append(unit(_cells(turn, np.hypot(gx, gy) * w, GRID, TURNS).ravel()))
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = top - low
    r, g, b = np.moveaxis(rgb, 2, 0)
    safe = np.where(span > 0, span, 1)
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6 * (span > 0)
    sat = np.where(top > 0, span / np.where(top > 0, top, 1), 0)
    parts = [_cells(np.minimum((x * n).astype(int), n - 1), w, COLOUR_GRID, n) for x, n in ((hue, 12), (sat, 4), (top, 4))]
    blocks.append(unit(np.hstack(parts).ravel()))
    return unit(np.concatenate(blocks))


def texture_encoder() -> Encoder:
    def encode(frames: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.stack([texture_colour(f, weights) for f in frames])

    return Encoder("gist", len(SIGMAS) * GRID * GRID * TURNS + COLOUR_GRID * COLOUR_GRID * 20, encode, True)


APPEARANCE.register("gist", texture_encoder)


def dense_flow(a: np.ndarray, b: np.ndarray, levels: int = 3, rounds: int = 3, sigma: float = 3.0) -> np.ndarray:
    """Motion (x, y) of every pixel from one grey picture to the next: windowed least squares, coarse to fine."""
    if levels > 1 and min(a.shape) >= 32:
        half = tuple(n // 2 for n in a.shape)
        flow = dense_flow(resized(a, *half), resized(b, *half), levels - 1, rounds, sigma)
        flow = 2 * np.stack([resized(flow[..., i], *a.shape) for i in (0, 1)], axis=2)
    else:
        flow = np.zeros((*a.shape, 2))
    gy, gx = np.gradient(blur(a, 1.0))
    sxx, syy, sxy = (blur(x, sigma) for x in (gx * gx, gy * gy, gx * gy))
    scale = sxx + syy
    det = sxx * syy - sxy * sxy + 1e-3 * scale.mean() ** 2 + 1e-9
    y, x = np.indices(a.shape)
    target, base = blur(b, 1.0), blur(a, 1.0)
    for _ in range(rounds):
        px, py = np.clip(x + flow[..., 0], 0, a.shape[1] - 1.001), np.clip(y + flow[..., 1], 0, a.shape[0] - 1.001)
        ix, iy = px.astype(int), py.astype(int)
        fx, fy = px - ix, py - iy
        jx, jy = np.minimum(ix + 1, a.shape[1] - 1), np.minimum(iy + 1, a.shape[0] - 1)
        there = (target[iy, ix] * (1 - fx) + target[iy, jx] * fx) * (1 - fy) + (target[jy, ix] * (1 - fx) + target[jy, jx] * fx) * fy
        d = there - base
        bx, by = blur(gx * d, sigma), blur(gy * d, sigma)
        flow = flow - np.stack([(syy * bx - sxy * by) / det, (sxx * by - sxy * bx) / det], axis=2)
    return flow


def motion_tier(blocks: Iterator[np.ndarray], fps: float, max_seq: int, smooth_s: float) -> dict:
    """Pooled motion, thinned sequence, rhythm and period of a stream of grey frames."""
    steps, last = [], None
    for block in blocks:
        for f in block:
            gray = f[..., 0].astype(np.float64)
            if last is not None:
                steps.append(flow_descriptor(dense_flow(last, gray)))
            last = gray
    if not steps:
        return {}
    d = np.stack(steps)
    energy = smooth(d[:, 128], max(int(round(smooth_s * fps)), 0))
    period, strength = dominant_period(energy, fps)
    seq = np.hstack([d[:, :128] / (np.linalg.norm(d[:, :128], axis=1, keepdims=True) + 1e-8), np.log1p(np.maximum(d[:, 128:], 0)) * 0.3])
    return {"motion_pooled": pool_motion(d), "motion_seq": seq[even_places(len(seq), max_seq)], "rhythm": rhythm_spectrum(energy, fps), "motion_energy": d[:, 128], "period_s": period, "period_strength": strength, "ego_magnitude": float(d[:, 129].mean())}


TASK.register("flow", lambda: Encoder("flow", 262, motion_tier))


def environment_signatures(recordings: DataFrame, k: int = 64, mode: str = "keyframes", settings: Settings | None = None, decoder: Decoder | None = None, size: tuple[int, int] = (256, 256)) -> DataFrame:
    """``video_id, app_frames, app_mean, app_var, app_encoder, error`` of whole recordings ``video_id, path, duration_s``.

    ``mode`` is ``keyframes`` (at most k of a file) or ``remote`` (k single reads of a remote file).  One recording is one
    task's row; a failing one keeps its row, with the reason in ``error``.
    """
    s = settings or Settings()
    take = {"keyframes": sample_keyframes, "remote": sample_remote}[mode]
    extra = {} if decoder is None else {"decoder": decoder}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = APPEARANCE.get(s.appearance.encoder)
        for b in batches:
            rows = []
            for i, path, d in zip(b["video_id"], b["path"], b["duration_s"]):
                try:
                    frames, _ = take(path, float(d), *size, k, **extra)
                    w = static_weights(frames, s.appearance.static_percentile, s.appearance.static_floor, s.appearance.bottom_crop) if e.takes_weights and len(frames) >= 4 else None
                    v = e.encode(frames, w) if e.takes_weights else e.encode(frames)
                    rows.append((i, v.tolist(), v.mean(axis=0).tolist(), v.var(axis=0).tolist(), e.name, None))
                except Exception as x:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((i, None, None, None, e.name, f"{type(x).__name__}: {x}"[:300]))
            names = ("video_id", "app_frames", "app_mean", "app_var", "app_encoder", "error")
            yield pd.DataFrame({c: pd.Series([r[j] for r in rows], dtype=object) for j, c in enumerate(names)})

    work = spread(recordings.select("video_id", "path", "duration_s"))
    return work.mapInPandas(run, "video_id string, app_frames array<array<float>>, app_mean array<float>, app_var array<float>, app_encoder string, error string")


def build_signatures(segments: DataFrame, settings: Settings | None = None, decoder: Decoder = ffmpeg_frames, size: tuple[int, int] = (256, 256), task_encoder: str = "flow") -> DataFrame:
    """One signature per row of ``segments`` (``video_id, path, t0, t1``); a failing one keeps its row, with ``error``.

    The motion tier is that of a registered ``task_encoder``: a function of grey blocks, rate, length and smoothing.
    Every tier decodes for itself at its own rate and size; frames never leave their task.
    """
    s = settings or Settings()
    fields = [f.strip().split()[0] for f in SCHEMA.split(", ")]

    def one(path: str, t0: float, t1: float) -> dict:
        e = APPEARANCE.get(s.appearance.encoder)
        frames = np.concatenate([f for f, _ in decoder(Request(path, t0, t1, s.appearance.fps, None, *size))])
        w = static_weights(frames, s.appearance.static_percentile, s.appearance.static_floor, s.appearance.bottom_crop) if e.takes_weights and len(frames) >= 4 else None
        v = e.encode(frames, w) if e.takes_weights else e.encode(frames)
        out = {"app_frames": v, "app_mean": v.mean(axis=0), "app_var": v.var(axis=0)}
        if s.motion.enabled:
            tier = TASK.get(task_encoder).encode
            out |= tier((f for f, _ in decoder(Request(path, t0, t1, s.motion.fps, None, *MOTION_SIZE, True))), s.motion.fps, s.motion.max_seq, s.motion.smooth_s)
        if s.hashing.enabled:
            hashed = [(perceptual_hash(p[..., 0]), float(t)) for f, ts in decoder(Request(path, t0, t1, s.hashing.fps, None, HASH_SIDE, HASH_SIDE, True)) for p, t in zip(f, ts)]
            out |= {"phash": [h for h, _ in hashed], "phash_ts": [t for _, t in hashed]}
        return {k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in out.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path, t0, t1 in zip(b["segment_id"], b["path"], b["t0"], b["t1"]):
                try:
                    rows.append({"segment_id": i, **one(path, t0, t1)})
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append({"segment_id": i, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in fields})

    named = segments.withColumn("segment_id", segment_id(F.col("video_id"), F.col("t0"), F.col("t1")))
    made = named.select("segment_id", "path", "t0", "t1").mapInPandas(run, SCHEMA)
    return named.select("segment_id", "video_id", "path", "t0", "t1").join(made, "segment_id").withColumn("app_encoder", F.lit(s.appearance.encoder))
