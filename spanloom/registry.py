"""Pluggable encoders and metrics, SQL functions, and the small public interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vec as V


@dataclass(frozen=True)
class Encoder:
    """A batch function from frames (n, h, w, c), and weights if it takes them, to vectors (n, width)."""

    name: str
    width: int
    encode: Callable[..., np.ndarray]
    takes_weights: bool = False


class Registry:
    """Encoders of one kind, by name."""

    def __init__(self, kind: str):
        self.kind = kind
        self._made: dict[str, Callable[[], Encoder]] = {}

    def register(self, name: str, make: Callable[[], Encoder]) -> None:
        if name in self._made:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._made[name] = make

    def get(self, name: str) -> Encoder:
        if name not in self._made:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self._made)}")
        return self._made[name]()

    def names(self) -> list[str]:
        return sorted(self._made)


APPEARANCE = Registry("appearance encoder")
TASK = Registry("task encoder")


def grid_colour(cells: int = 3) -> Encoder:
    """Mean colour and contrast over a grid of cells; an encoder that needs no model."""

    def encode(frames: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        x = frames.astype(np.float64) / 255.0
        if weights is not None:
            x = x * weights[None, :, :, None] + 0.5 * (1 - weights[None, :, :, None])
        out = []
        for r in np.array_split(np.arange(x.shape[1]), cells):
            for c in np.array_split(np.arange(x.shape[2]), cells):
                part = x[:, r][:, :, c]
                out += [part.mean(axis=(1, 2)), part.std(axis=(1, 2))]
        v = np.concatenate(out, axis=1)
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)

    return Encoder("grid_colour", cells * cells * 6, encode, True)


APPEARANCE.register("grid_colour", grid_colour)


def encode_frames(frames: DataFrame, encoder: str) -> DataFrame:
    """``segment_id, ts, vec`` from decoded frames; the encoder is made once per task."""

    def run(batches):  # noqa: ANN001, ANN202
        e = APPEARANCE.get(encoder)
        for b in batches:
            if b.empty:
                continue
            x = np.stack([np.frombuffer(p, np.uint8).reshape(h, w, c) for p, h, w, c in zip(b["pixels"], b["h"], b["w"], b["c"])])
            yield pd.DataFrame({"segment_id": b["segment_id"], "ts": b["ts"], "vec": list(e.encode(x).astype(np.float32))})

    return frames.filter("pixels IS NOT NULL").select("segment_id", "ts", "h", "w", "c", "pixels").mapInPandas(run, "segment_id string, ts double, vec array<float>")


#: Metrics of a pair: name to a function from the two sides' column prefix-free names to a Column.
METRICS: dict[str, Callable[[str, str], Column]] = {
    "cosine": lambda a, b: V.cosine(F.col(a), F.col(b)),
    "rhythm_cosine": lambda a, b: V.hellinger_cosine(F.col(a), F.col(b)),
    "jaccard": lambda a, b: V.jaccard(F.col(a), F.col(b)),
}


def register_metric(name: str, build: Callable[[str, str], Column]) -> None:
    if name in METRICS:
        raise ValueError(f"metric {name!r} is registered already")
    METRICS[name] = build


def register_sql(spark: SparkSession) -> None:
    """Makes windows available to SQL as a table function: ``SELECT * FROM hop_windows(duration, seconds, hop, shortest)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="t0: double, t1: double, whole: boolean")
    class HopWindows:
        def eval(self, duration: float, seconds: float, hop: float, shortest: float):  # noqa: ANN202
            if duration is None or duration <= 0:
                return
            if seconds <= 0 or seconds >= duration:
                yield 0.0, duration, True
                return
            step, i = hop if hop > 0 else seconds, 0
            while i * step < duration - 1e-6:
                a, b = i * step, min(i * step + seconds, duration)
                if b - a >= seconds - 1e-6 or b - a >= shortest or i == 0:
                    yield a, b, False
                i += 1

    spark.udtf.register("hop_windows", HopWindows)
