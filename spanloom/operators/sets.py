"""Recordings as sets of captioned segments: similarity of segments, coverage of one set by another, transport."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import parts_of, with_part, work_partitions
from .text import ACTIONS, OBJECTS, field_tokens
from .transport import merged, packed, register, transport

ACTION_SHARE = 0.65


def caption_sets(segments: DataFrame, key: str, seconds: Column) -> DataFrame:
    """``key, items``: every distinct pair of action and object sets of a record with its total seconds.

    Segments that name the same things are one item, so a record of any length stays as large as its vocabulary.
    """
    s = segments.select(key, F.array_sort(field_tokens(ACTIONS)).alias("acts"), F.array_sort(field_tokens(OBJECTS)).alias("objs"), seconds.alias("sec"))
    g = s.groupBy(key, "acts", "objs").agg(F.sum("sec").alias("sec"))
    return g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("acts", "objs", "sec"))).alias("items"))


def _jaccard(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    words = {w: i for i, w in enumerate({w for s in (*a, *b) for w in s})}
    ma, mb = np.zeros((len(a), len(words) + 1)), np.zeros((len(b), len(words) + 1))
    for m, sets in ((ma, a), (mb, b)):
        for i, s in enumerate(sets):
            m[i, [words[w] for w in s]] = 1
    both = ma @ mb.T
    union = ma.sum(axis=1)[:, None] + mb.sum(axis=1)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def segment_similarity(a: list, b: list) -> np.ndarray:
    """Similarity of every segment of one set to every one of another, by shared actions and objects."""
    return ACTION_SHARE * _jaccard([x["acts"] for x in a], [x["acts"] for x in b]) + (1 - ACTION_SHARE) * _jaccard([x["objs"] for x in a], [x["objs"] for x in b])


def covered(best: np.ndarray, weight: np.ndarray, threshold: float) -> float:
    """Share of the weight whose best match reaches the threshold; 0 without weight."""
    return float(weight[best >= threshold].sum() / weight.sum()) if weight.sum() > 0 else 0.0


def _met(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    met = pairs.join(sets.select(F.col(key).alias("a"), F.col("items").alias("x")), "a")
    return met.join(sets.select(F.col(key).alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")


def set_coverage(pairs: DataFrame, sets: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Coverage both ways and mean best match both ways of pairs ``a, b`` with both sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for a, b, x, y in zip(f["a"], f["b"], f["x"], f["y"]):
                s = segment_similarity(x, y)
                wa, wb = (np.array([i["sec"] for i in z], float) for z in (x, y))
                ba, bb = s.max(axis=1) + 1e-12, s.max(axis=0) + 1e-12
                out.append((a, b, covered(ba, wa, threshold), covered(bb, wb, threshold), float(np.average(ba, weights=wa)), float(np.average(bb, weights=wb))))
            yield pd.DataFrame(out, columns=["a", "b", "covered_a", "covered_b", "best_a", "best_b"])

    return _met(pairs, sets, key).mapInPandas(run, "a string, b string, covered_a double, covered_b double, best_a double, best_b double")


def packed_caption_sets(segments: DataFrame, key: str, seconds: Column) -> DataFrame:
    """``key, set``: the sets of ``caption_sets``, packed, from segments that lie together by ``key, part``.  Only packed sets are moved."""
    register(segments.sparkSession)
    s = segments.select(key, "part", F.array_sort(field_tokens(ACTIONS)).alias("acts"), F.array_sort(field_tokens(OBJECTS)).alias("objs"), seconds.alias("sec"))
    g = s.groupBy(key, "part", "acts", "objs").agg(F.sum("sec").alias("sec"))
    p = g.groupBy(key, "part").agg(packed(F.array_sort(F.collect_list(F.struct("acts", "objs", "sec")))).alias("set"))
    return p.groupBy(key).agg(merged(F.collect_list("set")).alias("set"))


def set_transport(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Transport similarity of pairs ``a, b`` by packed sets: as much similarity as the durations of both sets allow at once.

    Sets go to the pairs, b's first; only b's move once a pair.  A set in many pairs has a copy for each part of them.
    """
    register(pairs.sparkSession)
    n = work_partitions(pairs.sparkSession)  # small rows, long work: spread by pair instead of by bytes
    parts = parts_of(pairs.select(F.explode(F.array("a", "b")).alias(key)), key)
    own = sets.filter(F.col(key).isNotNull()).join(parts, key, "left")
    own = own.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1)).alias("part"), "set").repartition(n, key, "part")
    p = with_part(with_part(pairs, parts.toDF("a", "parts"), "a", "b", "a_part"), parts.toDF("b", "parts"), "b", "a", "b_part")
    met = p.repartition(n, "b", "b_part").join(own.toDF("b", "b_part", "b_set"), ["b", "b_part"]).select("a", "a_part", "b", "b_set")
    met = met.repartition(n, "a", "a_part").join(own.toDF("a", "a_part", "a_set"), ["a", "a_part"])
    return met.select("a", "b", transport(F.col("a_set"), F.col("b_set"), ACTION_SHARE).alias("transport"))
