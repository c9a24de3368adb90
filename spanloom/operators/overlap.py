"""Shared source material of two hash streams: near-equal hashes vote for a distance in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("overlap_seconds", "offset_seconds", "matched_frames", "fraction_of_a", "fraction_of_b")


def median_step(times: Column, single: float) -> Column:
    """Median distance of consecutive times; ``single`` for a stream of one."""
    steps = F.array_sort(F.transform(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda t, i: t - F.get(times, i)))
    n = F.size(steps)
    return F.when(n > 0, (F.get(steps, ((n - 1) / 2).cast("int")) + F.get(steps, (n / 2).cast("int"))) / 2).otherwise(F.lit(single))


def commonest(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries hold the commonest value of their row; of equally common ones the smallest."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    first = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(v) != 0)]) if len(r) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(r)))
    ranked = np.lexsort((v[first], -size, r[first]))
    best = ranked[np.r_[True, np.diff(r[first][ranked]) != 0]] if len(first) else ranked
    out = np.zeros(len(row), bool)
    for_best = np.zeros(len(first), bool)
    for_best[best] = True
    out[order] = np.repeat(for_best, size)
    return out


def longest_runs(row: np.ndarray, place: np.ndarray, gap: int, rows: int) -> np.ndarray:
    """For each of ``rows``, the members of the longest run of its distinct places with neighbours at most ``gap`` apart."""
    both = np.unique(np.stack([row, place]), axis=1)
    out = np.zeros(rows, np.int64)
    if both.shape[1]:
        start = np.flatnonzero(np.r_[True, (np.diff(both[0]) != 0) | (np.diff(both[1]) > gap)])
        np.maximum.at(out, both[0][start], np.diff(np.append(start, both.shape[1])))
    return out


def source_overlap(pairs: DataFrame, bits: int = 8, bin_s: float = 0.5, votes: int = 3, gap: int = 2) -> DataFrame:
    """``a, b`` and the overlap record of pairs with ``phash_a, phash_ts_a, phash_b, phash_ts_b``.

    Hashes that differ in at most ``bits`` bits vote for their distance in time, in bins of ``bin_s``; the commonest
    bin wins, of several the smallest.  The overlap is the longest run of the places of ``a`` that voted for it.
    All zero where a bin has fewer than ``votes`` votes or a run on either side fewer members, and for
    missing or empty streams, and for streams with missing parts.

    All pairs of an Arrow batch vote together; nothing is shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = [(b.column(c).flatten().to_numpy(zero_copy_only=False), b.column(c).offsets.to_numpy() - b.column(c).offsets[0].as_py()) for c in ("phash_a", "phash_ts_a", "phash_b", "phash_ts_b")]
            (ha, at), (ta, _), (hb, bt), (tb, _) = streams
            met = [np.zeros((3, 0), np.int64)]
            for r in range(b.num_rows):
                i, j = np.nonzero(np.bitwise_count(ha[at[r] : at[r + 1], None].view(np.uint64) ^ hb[None, bt[r] : bt[r + 1]].view(np.uint64)) <= bits)
                if len(i):
                    met.append(np.stack([np.full(len(i), r), i, j]))
            row, i, j = np.concatenate(met, axis=1)
            place = np.rint((tb[bt[row] + j] - ta[at[row] + i]) / bin_s).astype(np.int64)
            won = commonest(row, place)
            row, i, j, place = row[won], i[won], j[won], place[won]
            n, offset = np.bincount(row, minlength=b.num_rows), np.zeros(b.num_rows, np.int64)
            offset[row] = place
            runs = [longest_runs(row, x, gap, b.num_rows) for x in (i, j)]
            kept = [b.column(c) for c in ("a", "b", "n_a", "n_b", "step")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in (n, offset, *runs))], ["a", "b", "n_a", "n_b", "step", "n", "bin", "run_a", "run_b"])

    same = lambda s: (F.size(f"phash_{s}") == F.size(f"phash_ts_{s}")) & (F.size(f"phash_{s}") > 0)
    whole = lambda s: F.forall(f"phash_{s}", lambda h: h.isNotNull()) & F.forall(f"phash_ts_{s}", lambda t: t.isNotNull() & ~F.isnan(t))
    able = F.coalesce(same("a") & same("b") & whole("a") & whole("b"), F.lit(False))
    listed = [F.when(able, F.col(c)).otherwise(F.array().cast(t)).alias(c) for s in "ab" for c, t in ((f"phash_{s}", "array<bigint>"), (f"phash_ts_{s}", "array<double>"))]
    facts = ("a", "b", F.size("phash_a").alias("n_a"), F.size("phash_b").alias("n_b"), median_step(F.col("phash_ts_a"), 0.5).alias("step"))
    kinds = dict(pairs.dtypes)
    r = pairs.select(*facts, *listed).mapInArrow(count, f"a {kinds['a']}, b {kinds['b']}, n_a int, n_b int, step double, n bigint, bin bigint, run_a bigint, run_b bigint")
    found = F.least("n", "run_a", "run_b") >= votes
    record = (F.col("run_a") * F.col("step"), F.col("bin") * F.lit(bin_s), F.col("n"), F.col("run_a") / F.col("n_a"), F.col("run_b") / F.col("n_b"))
    types = ("double", "double", "int", "double", "double")
    return r.select("a", "b", *[F.when(found, x).otherwise(0).cast(k).alias(c) for c, x, k in zip(COLUMNS, record, types)])
