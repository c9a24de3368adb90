"""Nearest-neighbour search, gating and coverage of a corpus by a subset."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, spread
from .kernels import unit_rows

#: Vectors that one pass carries to the executors.
BLOCK = 8_192
#: Rows that a task compares with a block at once.
SLICE = 512


def _blocks(df: DataFrame, id_: str, vector: str, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of about ``block`` vectors, by a hash of the id, so that the driver never holds more."""
    n = df.count()
    parts = max(1, -(-n // block))
    for p in range(parts):
        rows = df.filter(F.pmod(F.xxhash64(id_), F.lit(parts)) == p).select(id_, vector).orderBy(id_).collect()
        if rows:
            yield [r[0] for r in rows], unit_rows(np.array([r[1] for r in rows], np.float64))


def search(corpus: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """``query, rank, id, similarity``: the k corpus vectors with the largest cosine to every query but itself.

    Ties go to the smaller id.  Queries are carried to the corpus in blocks of at most about ``block``;
    each batch of the corpus keeps its own best k, and those are merged.  All vectors have one width.
    """
    kind = dict(corpus.dtypes)[id_]
    out = None
    for ids, q in _blocks(queries, id_, vector, block):
        shared = corpus.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, q = shared.value
            for b in batches:
                if b.empty:
                    continue
                mine = b["id"].to_numpy()
                s = np.round(q @ unit_rows(np.stack(b["v"].to_numpy())).T, 12)
                rows = []
                keep = min(k + 1, s.shape[1])
                order = np.lexsort((np.broadcast_to(mine, s.shape), -s), axis=1)[:, :keep]
                for i, cols in enumerate(order):
                    rows += [(ids[i], mine[c], s[i, c]) for c in cols if mine[c] != ids[i]][:k]
                yield pd.DataFrame(rows, columns=["query", "id", "similarity"])

        part = corpus.select(F.col(id_).alias("id"), F.col(vector).alias("v")).mapInPandas(best, f"query {kind}, id {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], f"query {kind}, rank int, id {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def gate(nearest: DataFrame, candidates: DataFrame, id_: str, threshold: float) -> DataFrame:
    """Decision per candidate from its nearest neighbour (``query, id, similarity`` of rank 1).

    A candidate is accepted if its nearest neighbour is below the threshold, or if there is none.
    """
    r = candidates.select(F.col(id_).alias("query")).join(nearest.filter("rank = 1").select("query", "id", "similarity"), "query", "left")
    s = F.coalesce("similarity", F.lit(0.0))
    return r.select(F.col("query").alias(id_), (F.col("similarity").isNull() | (s < threshold)).alias("accept"), F.col("id").alias("nearest"), s.alias("similarity"), (1 - s).alias("distance"))


def marginal_gains(corpus: DataFrame, chosen: DataFrame, candidates: DataFrame, id_: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``id, gain``: what each candidate would add to the corpus' similarity to its nearest chosen vector.

    Negative similarities count as zero.  ``chosen`` must be small (it is carried to all executors).
    """
    sc = corpus.sparkSession.sparkContext
    few = [r[0] for r in chosen.select(vector).limit(block + 1).collect()]
    if len(few) > block:
        raise ValueError(f"more than {block} chosen vectors")
    have = sc.broadcast(unit_rows(np.array(few, np.float64)) if few else None)
    kind = dict(corpus.dtypes)[id_]
    out = None
    for ids, q in _blocks(candidates, id_, vector, block):
        shared = sc.broadcast((ids, q))

        def gain(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, q = shared.value
            total = np.zeros(len(ids))
            for b in batches:
                if b.empty:
                    continue
                x = unit_rows(np.stack(b["v"].to_numpy()))
                best = np.maximum(x @ have.value.T, 0).max(axis=1) if have.value is not None else np.zeros(len(x))
                total += np.maximum(np.maximum(x @ q.T, 0) - best[:, None], 0).sum(axis=0)
            yield pd.DataFrame({"id": ids, "gain": total})

        part = corpus.select(F.col(vector).alias("v")).mapInPandas(gain, f"id {kind}, gain double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], f"id {kind}, gain double")
    return out.groupBy("id").agg(F.sum("gain").alias("gain"))


def facility_location(corpus: DataFrame, candidates: DataFrame, id_: str, vector: str, budget: int, block: int = BLOCK) -> DataFrame:
    """``rank, id, gain, coverage, fraction``: greedy choice among the candidates that represents the corpus best.

    Each round takes the candidate that adds most to the sum of every row's similarity to its nearest
    pick; ties go to the smaller id.  Candidates are carried to the corpus in blocks of about ``block``,
    with one pass over the corpus per round and block; the driver holds one block and the picks.
    """
    spark = corpus.sparkSession
    sc = spark.sparkContext
    kind = dict(corpus.dtypes)[id_]
    pool = cut(candidates.select(id_, vector))
    base = cut(spread(corpus.select(F.col(vector).alias("v"))).withColumn("row", F.monotonically_increasing_id()))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
        for b in batches:
            for i in range(0, len(b), SLICE):
                part = b.iloc[i : i + SLICE]
                yield part["row"], unit_rows(np.stack(part["v"].to_numpy()))

    def gains(q: np.ndarray, picked: list[np.ndarray]) -> np.ndarray:
        """Gain of every vector of a block after ``picked``."""
        shared = sc.broadcast((q, np.array(picked) if picked else None))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, have = shared.value
            out = np.zeros(len(c))
            for _, x in slices(batches):
                best = np.maximum(x @ have.T, 0).max(axis=1) if have is not None else np.zeros(len(x))
                out += np.maximum(np.maximum(x @ c.T, 0) - best[:, None], 0).sum(axis=0)
            yield pd.DataFrame({"i": np.arange(len(out)), "x": out})

        r = np.zeros(len(q))
        for g in base.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            r[g["i"]] = g["x"]
        shared.unpersist()
        return r

    def total() -> float:
        """What all candidates together would cover."""
        out = None
        for _, q in _blocks(pool, id_, vector, block):
            shared = sc.broadcast(q)

            def top(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
                for row, x in slices(batches):
                    yield pd.DataFrame({"row": row, "x": np.maximum(x @ shared.value.T, 0).max(axis=1)})

            part = base.mapInPandas(top, "row bigint, x double")
            out = part if out is None else out.unionByName(part)
        return 0.0 if out is None else out.groupBy("row").agg(F.max("x").alias("x")).agg(F.sum("x")).first()[0] or 0.0

    whole = total()
    chosen: dict = {}
    out, so_far = [], 0.0
    for rank in range(1, budget + 1):
        best = None
        for ids, q in _blocks(pool, id_, vector, block):
            g = gains(q, list(chosen.values()))
            for i in np.lexsort((np.arange(len(ids)), -np.round(g, 9))):
                if ids[i] not in chosen:
                    key = (-round(float(g[i]), 9), ids[i])
                    if best is None or key < best[0]:
                        best = key, float(g[i]), q[i]
                    break
        if best is None:
            break
        (_, pick), gain, vec = best
        chosen[pick] = vec
        so_far += gain
        out.append((rank, pick, gain, so_far, so_far / whole if whole > 0 else 0.0))
    return spark.createDataFrame(out, f"rank int, id {kind}, gain double, coverage double, fraction double")


def greedy_kernel(s: np.ndarray, budget: int | None = None, chosen: list[int] | None = None) -> tuple[list[int], list[float]]:
    """The same choice for one similarity matrix in memory, with lazily refreshed gains.

    Gains are compared to 9 digits, so that sums of the same numbers in another order are ties; the smaller place wins.
    """
    s = np.maximum(np.asarray(s, np.float64), 0)
    best = s[:, chosen].max(axis=1) if chosen else np.zeros(len(s))
    taken = set(chosen or ())

    def gain(j: int) -> float:
        return round(float(np.maximum(s[:, j] - best, 0).sum()), 9)

    queue = [(-gain(j), j) for j in range(s.shape[1]) if j not in taken]
    heapq.heapify(queue)
    order, gains = [], []
    while queue and len(order) < (len(s) if budget is None else budget):
        _, j = heapq.heappop(queue)
        fresh = -gain(j), j
        if queue and fresh > queue[0]:
            heapq.heappush(queue, fresh)
            continue
        best = np.maximum(best, s[:, j])
        order.append(j)
        gains.append(-fresh[0])
    return order, gains


def knee(gains: Column, total: Column, tolerance: float = 0.01) -> Column:
    """Number of picks before the first that adds less than ``tolerance`` of the total."""
    low = F.transform(gains, lambda g: (total > 0) & (g / total < tolerance))
    at = F.array_position(low, True)
    return F.when(at > 0, at - 1).otherwise(F.size(gains)).cast("int")
