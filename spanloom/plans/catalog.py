"""The modules that register queries of the core."""

from __future__ import annotations

from . import calibration_queries, pair_queries, problem_queries, selection_queries, stream_queries, text_queries, vector_queries, window_queries


def modules() -> list:
    return [problem_queries, vector_queries, calibration_queries, pair_queries, window_queries, text_queries, selection_queries, stream_queries]
