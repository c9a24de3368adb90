"""Settings of the engine: frozen, checked when made, never part of the Spark configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Appearance:
    encoder: str = "gist"
    fps: float = 1.0
    static_percentile: float = 20.0
    static_floor: float = 0.15
    bottom_crop: float = 0.0


@dataclass(frozen=True)
class Motion:
    enabled: bool = True
    fps: float = 10.0
    max_seq: int = 256
    smooth_s: float = 0.5
    clip_encoder: str | None = None


@dataclass(frozen=True)
class Hashing:
    enabled: bool = True
    fps: float = 2.0
    max_hamming: int = 8
    min_overlap_seconds: float = 2.0
    min_overlap_fraction: float = 0.5


@dataclass(frozen=True)
class Decision:
    env_percentile: float = 60.0
    task_percentile: float = 95.0
    use_task_axis: bool = False


@dataclass(frozen=True)
class Segmenting:
    seconds: float = 0.0
    hop: float = 0.0
    drop_last_shorter_than: float = 5.0


@dataclass(frozen=True)
class Settings:
    appearance: Appearance = field(default_factory=Appearance)
    motion: Motion = field(default_factory=Motion)
    hashing: Hashing = field(default_factory=Hashing)
    decision: Decision = field(default_factory=Decision)
    segment: Segmenting = field(default_factory=Segmenting)

    def __post_init__(self) -> None:
        d = self.decision
        if not (0 <= d.env_percentile <= 100 and 0 <= d.task_percentile <= 100):
            raise ValueError("percentiles lie between 0 and 100")
        if self.appearance.fps <= 0 or self.motion.fps <= 0 or self.hashing.fps <= 0:
            raise ValueError("sampling rates are positive")

    @classmethod
    def of(cls, given: dict[str, Any] | None) -> Settings:
        """From nested dictionaries; an unknown key is an error."""
        return _fill(cls, given or {})

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """From a YAML file; defaults without one."""
        if path is None:
            return cls()
        import yaml

        with open(path) as f:
            return cls.of(yaml.safe_load(f))

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def _fill(kind: type, given: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if strange := set(given) - set(known):
        raise KeyError(f"unknown settings in {kind.__name__}: {sorted(strange)}")
    made = kind()
    values = {k: _fill(type(getattr(made, k)), v or {}) if is_dataclass(getattr(made, k)) else v for k, v in given.items()}
    return kind(**values)
