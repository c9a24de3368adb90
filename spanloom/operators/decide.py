"""Verdicts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default cuts of the rules.
ENV_PERCENTILE, TASK_PERCENTILE = 60.0, 95.0
SAME_ENV_RAW, BORDERLINE_RAW = 0.4920, 0.4666
SAME_ONE_SIDED, DIFFERENT_ONE_SIDED = 99.5, 90.0
COVERED, PARTLY = 0.8, 0.3
MIN_OVERLAP_S, MIN_FRACTION = 2.0, 0.5
GATE = 0.97
KEEP = ("NOVEL", "SAME_PLACE_NEW_TASK", "SAME_TASK_NEW_PLACE")
DROP = ("REDUNDANT", "DUPLICATE_SOURCE")


def percentile_verdict(env: Column, task: Column, env_cut: float = ENV_PERCENTILE, task_cut: float = TASK_PERCENTILE, use_task: bool = False) -> Column:
    """REDUNDANT or NOVEL by the environment alone, or one of four labels with the task axis."""
    same_env = F.coalesce(env >= env_cut, F.lit(False))
    if not use_task:
        return F.when(same_env, "REDUNDANT").otherwise("NOVEL")
    same_task = F.coalesce(task >= task_cut, F.lit(False))
    return F.when(same_env & same_task, "REDUNDANT").when(same_env, "SAME_PLACE_NEW_TASK").when(same_task, "SAME_TASK_NEW_PLACE").otherwise("NOVEL")


def uncalibrated(score: Column) -> Column:
    """A raw score in [-1, 1] on the scale of percentiles."""
    return 100.0 * (score + 1.0) / 2.0


def is_duplicate(overlap_s: Column, fraction_a: Column, fraction_b: Column) -> Column:
    return F.coalesce((overlap_s >= MIN_OVERLAP_S) & (F.greatest(fraction_a, fraction_b) >= MIN_FRACTION), F.lit(False))


def kept(label: Column) -> Column:
    """True for labels that keep a record, false for those that drop it, null for others."""
    return F.when(label.isin(*KEEP), True).when(label.isin(*DROP), False)


def one_sided_verdict(percentile: Column) -> Column:
    return F.when(percentile >= SAME_ONE_SIDED, "SAME_ENV").when(percentile <= DIFFERENT_ONE_SIDED, "DIFFERENT_ENV").otherwise("UNRESOLVED")


def calibrated_verdict(env_raw: Column, same: float = SAME_ENV_RAW, borderline: float = BORDERLINE_RAW) -> Column:
    return F.when(env_raw.isNull() | F.isnan(env_raw), F.lit(None).cast("string")).when(env_raw >= same, "SAME_ENV").when(env_raw >= borderline, "BORDERLINE").otherwise("DIFFERENT_ENV")


def quadrant(env: Column, task_sim: Column, threshold: Column) -> Column:
    """Environment verdict and text similarity together; without a similarity NO_TASK_DATA, without an environment blank."""
    has_task = task_sim.isNotNull() & ~F.isnan(task_sim)
    same_task = task_sim >= threshold
    return (
        F.when(~has_task, "NO_TASK_DATA").when(env.isNull() | (env == ""), "").when(env == "BORDERLINE", "BORDERLINE_ENV")
        .when((env == "SAME_ENV") & same_task, "REDUNDANT").when(env == "SAME_ENV", "SAME_PLACE_NEW_TASK").when(same_task, "SAME_TASK_NEW_PLACE").otherwise("DISTINCT")
    )


def resolved_quadrant(env: Column, task_sim: Column, threshold: Column) -> Column:
    """The quadrant with borderline environments taken as different."""
    return quadrant(F.when(env == "BORDERLINE", "DIFFERENT_ENV").otherwise(env), task_sim, threshold)


def coverage_verdict(a: Column, b: Column, covered: float = COVERED, partly: float = PARTLY) -> Column:
    """How two sets cover one another, from the covered share of each."""
    return (
        F.when((a >= covered) & (b >= covered), "DUPLICATE_COVERAGE").when(a >= covered, "A_CONTAINED_IN_B").when(b >= covered, "B_CONTAINED_IN_A")
        .when(F.greatest(a, b) >= partly, "PARTIAL_OVERLAP").otherwise("DISTINCT")
    )


def notes(*conditions: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conditions]))
