"""The modules of this subpackage that register queries."""

from __future__ import annotations

from . import queries_runs_groups, queries_spans, queries_subset_packing, queries_text


def modules() -> list:
    return [queries_runs_groups, queries_spans, queries_subset_packing, queries_text]
