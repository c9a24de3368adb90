"""The k most similar vectors of every vector: small-world graphs per shard, shard results merged."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .hnsw import BEAM_BUILD, BEAM_SEARCH, GROUND, Graph
from .vectors import by_kind, matrix, unit

#: Vectors of a kind, at most, that the coarse cells are fitted on.
SAMPLE = 16_384
#: A kind has one coarse cell for so many vectors, up to MAX_CELLS; larger cells are split by sign bits, as many as their size needs.
CELL_POINTS = 128
MAX_CELLS = 1_024
MAX_BITS = 24
#: Cells whose shards a query may visit, and shards that it visits at most.
PROBES = 32
VISITS = 8
#: A query visits no shard further off than its own cell by more than this share of its squared distance to that cell's centre.
REACH = 0.1
#: Points of one graph.
SHARD_POINTS = 8_192
#: Queries of other shards answered by one task.
CHUNK_QUERIES = 16_384
#: Shards whose numbers of visitors are broadcast (some 40 bytes each); more are joined by shuffle.
BROADCAST_SHARDS = 500_000
#: Parts into which the copies of a vector with more than k + 1 of them are dealt.
COPY_SALTS = 64


class Cells:
    """Coarse cells of one kind: centres, main directions of what is left and, once counted, the shards of every cell."""

    def __init__(self, x: np.ndarray, cells: int, seed: int = 5, rounds: int = 5):
        x = unit(x).astype(np.float32)
        c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
        for _ in range(rounds):
            at = self._near(x, c).argmax(axis=1)
            by = np.argsort(at, kind="stable")
            used, first = np.unique(at[by], return_index=True)
            c[used] = np.add.reduceat(x[by], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        self.centres = c
        rest = (x - c[self._near(x, c).argmax(axis=1)]).astype(np.float64)
        self.directions = np.linalg.eigh(rest.T @ rest)[1][:, ::-1][:, :MAX_BITS].astype(np.float32)
        self.middle = np.median(rest @ self.directions, axis=0).astype(np.float32)
        self.first = self.bits = np.zeros(len(c), np.int64)

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Minus half the squared distance of every row to every centre, up to a constant of the row."""
        return x @ c.T - (c * c).sum(axis=1) / 2

    def own(self, x: np.ndarray) -> np.ndarray:
        return self._near(unit(x).astype(np.float32), self.centres).argmax(axis=1)

    def plan(self, counts: dict[int, int], shard_points: int) -> None:
        """Shards of the cells, given the points of each.

        A cell of more than ``shard_points`` is split by sign bits; smaller ones share a shard with their nearest
        neighbours, up to that many points.
        """
        size = np.array([counts.get(i, 0) for i in range(len(self.centres))])
        most = min(MAX_BITS, self.directions.shape[1])
        self.first, self.bits = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        made = 0
        for i in np.flatnonzero(size > shard_points):
            self.first[i], self.bits[i] = made, min(most, int(np.ceil(np.log2(size[i] / shard_points))))
            made += 1 << int(self.bits[i])
        left = list(np.flatnonzero(size <= shard_points))
        while left:
            seed = left.pop(int(np.argmax(size[left])))
            room = shard_points - size[seed]
            self.first[seed] = made
            gap = ((self.centres[left] - self.centres[seed]) ** 2).sum(axis=1)
            taken = set()
            for j in np.argsort(gap, kind="stable").tolist():
                if size[left[j]] > room:
                    break
                room -= size[left[j]]
                self.first[left[j]] = made
                taken.add(j)
            left = [c for j, c in enumerate(left) if j not in taken]
            made += 1

    def own_shard(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The shard that each vector is in."""
        cell = near.argmax(axis=1)
        code = np.zeros(len(x), np.int64)
        at = np.flatnonzero(self.bits[cell] > 0)
        if len(at):
            side = (x[at] - self.centres[cell[at]]) @ self.directions - self.middle
            code[at] = ((side > 0) & (np.arange(side.shape[1]) < self.bits[cell[at]][:, None])) @ (1 << np.arange(side.shape[1]))
        return self.first[cell] + code

    def shards(self, x: np.ndarray, probes: int, visits: int, reach: float) -> np.ndarray:
        """Shards of the vectors, their own first, then those nearest to them; -1 after the last."""
        x = unit(x).astype(np.float32)
        near = self._near(x, self.centres)
        p = min(probes, near.shape[1])
        cell = np.argsort(-near, axis=1, kind="stable")[:, :p]
        far = 2 * (near.max(axis=1, keepdims=True) - np.take_along_axis(near, cell, axis=1))  # squared distance beyond the own cell's
        shard, cost = [self.first[cell]], [np.where(self.bits[cell] == 0, far, np.inf)]
        for k in range(p):  # cells that are split: the code of the vector, and codes with its least certain bits turned
            at = np.flatnonzero(self.bits[cell[:, k]] > 0)
            if not len(at):
                continue
            c = cell[at, k]
            side = (x[at] - self.centres[c]) @ self.directions - self.middle
            used = np.arange(side.shape[1]) < self.bits[c][:, None]
            code = ((side > 0) & used) @ (1 << np.arange(side.shape[1]))
            loss = np.where(used, side * side, np.inf)
            weak = np.argsort(loss, axis=1, kind="stable")[:, :8]
            loss = np.take_along_axis(loss, weak, axis=1)
            for n, most in enumerate((0, 8, 4)):
                for turned in combinations(range(min(weak.shape[1], most)), n):
                    s, v = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
                    flip = sum((1 << weak[:, j] for j in turned), np.zeros(len(at), np.int64))
                    s[at], v[at] = self.first[c] + (code ^ flip), far[at, k] + sum((loss[:, j] for j in turned), np.zeros(len(at)))
                    shard.append(s[:, None])
                    cost.append(v[:, None])
        shard, cost = np.hstack(shard), np.hstack(cost)
        order = np.lexsort((cost, shard), axis=1)  # of several ways to a shard the nearest counts
        shard, cost = np.take_along_axis(shard, order, axis=1), np.take_along_axis(cost, order, axis=1)
        cost[:, 1:][shard[:, 1:] == shard[:, :-1]] = np.inf
        cost[cost > reach * (1 - 2 * near.max(axis=1, keepdims=True))] = np.inf
        cost[shard == self.own_shard(x, near)[:, None]] = -1.0
        cost[:, 1:][shard[:, 1:] == shard[:, :-1]] = np.inf
        order = np.argsort(cost, axis=1, kind="stable")[:, :visits]
        return np.where(np.isfinite(np.take_along_axis(cost, order, axis=1)), np.take_along_axis(shard, order, axis=1), -1)


def _classes(vecs: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids with the hash of their vector; the first ``keep`` ids of every distinct vector; the distinct vectors."""
    parts = ["kind", "h1", "h2"]
    hashed = cut(vecs.select("id", "kind", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.reverse("vec")).alias("h2")))
    everyone = hashed.select("id", *parts)
    few = cut(everyone.withColumn("rn", F.row_number().over(Window.partitionBy(*parts).orderBy("id"))).filter(F.col("rn") <= keep))
    points = hashed.select("id", "kind", "vec").join(few.filter("rn = 1").select("id"), "id", "left_semi")
    return everyone, few, points


def most_similar(vecs: DataFrame, k: int = 5, digits: int = 9, sample: int = SAMPLE, cell_points: int = CELL_POINTS, probes: int = PROBES,
                 visits: int = VISITS, reach: float = REACH, shard_points: int = SHARD_POINTS, chunk_queries: int = CHUNK_QUERIES,
                 ground: int = GROUND, beam_build: int = BEAM_BUILD, beam: int = BEAM_SEARCH) -> DataFrame:
    """``id, neighbour, similarity``: the k most similar other vectors of the same kind for every one.

    ``vecs`` has ``id, kind, vec`` (see ``usable_vectors``).  Similarity is the cosine in double
    precision rounded to ``digits``; ties go to the smaller id.  A vector of a kind with k or fewer
    others gets them all; empty input gives an empty result.  Exact copies of a vector are one point
    of the graphs, and their ids are put back afterwards, so a crowd of copies costs no search.

    Vectors are dealt into coarse cells (fitted on at most ``sample`` vectors of a kind; every vector
    is indexed), neighbouring cells into shards of about ``shard_points`` points, and cells larger than that into
    as many shards as they need, by the signs of what is left along its main directions.  Each shard gets a graph of
    its own.  A query searches its own shard and those nearest to it, at most ``visits`` in all whatever the number of
    vectors and none further off than ``reach`` allows, and the results are merged.  The candidates a graph gives are compared exactly, so only the
    choice of candidates is approximate.
    """
    spark = vecs.sparkSession
    everyone, few, points = _classes(vecs, k + 1)
    key = {f.name: f.dataType.simpleString() for f in vecs.schema}["id"]
    sizes = {r["kind"]: r["count"] for r in few.filter("rn = 1").groupBy("kind").count().collect()}  # one row a kind
    empty = f"id {key}, neighbour {key}, similarity double"
    if not sizes:
        return spark.createDataFrame([], empty)
    points = cut(points.withColumn("h", F.xxhash64("id", F.lit(17))))
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("kind") == kind, 1.0 if n <= sample else 0.95 * sample / n).otherwise(share)
    taken = vecs_of_few(points, share)
    fitted = {}
    names = taken.column("kind").to_numpy()
    for kind, n in sizes.items():
        at = np.flatnonzero(names == kind)
        fitted[kind] = Cells(matrix(taken.column("vec").take(pa.array(at))), min(MAX_CELLS, max(1, n // cell_points)))
    shared = spark.sparkContext.broadcast(fitted)  # MAX_CELLS centres a kind

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, at in by_kind(b):
                cell = shared.value[kind].own(matrix(b.column("vec").take(pa.array(at))))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(cell, pa.int32())], ["kind", "cell"])

    counts: dict[str, dict[int, int]] = {kind: {} for kind in sizes}
    for r in points.select("kind", "vec").mapInArrow(cells_of, "kind string, cell int").groupBy("kind", "cell").count().collect():  # at most MAX_CELLS a kind
        counts[r["kind"]][r["cell"]] = r["count"]
    for kind in sizes:
        fitted[kind].plan(counts[kind], shard_points)
    planned = spark.sparkContext.broadcast(fitted)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own shard of every vector and all shards it visits."""
        for b in batches:
            for kind, at in by_kind(b):
                here = b.take(pa.array(at))
                shards = planned.value[kind].shards(matrix(here.column("vec")), probes, visits, reach)
                used = shards >= 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, used.sum(axis=1).cumsum()), pa.int32()), pa.array(shards[used]))
                yield pa.RecordBatch.from_arrays([*[here.column(c) for c in ("id", "kind", "vec", "h")], pa.array(shards[:, 0]), lists], ["id", "kind", "vec", "h", "shard", "visits"])

    routed = cut(points.select("id", "kind", "vec", "h").mapInArrow(route, f"id {key}, kind string, vec array<float>, h bigint, shard bigint, visits array<bigint>"))
    # signs need not split evenly: a shard of more than twice its points is dealt into parts that are all visited
    parts_of = routed.groupBy("kind", "shard").agg(F.ceil(F.count("*") / (2 * shard_points)).cast("int").alias("parts")).filter("parts > 1")
    crowded = cut(parts_of)
    even = crowded.isEmpty()

    def with_parts(df: DataFrame) -> DataFrame:
        return df.withColumn("parts", F.lit(1)) if even else df.join(crowded, ["kind", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    part = F.pmod("h", F.col("parts")).cast("int")
    where = ["kind", "shard", "part"]
    dealt = with_parts(routed.select("kind", "shard", "h", "id", "vec")).select("kind", "shard", part.alias("part"), "id", "vec")

    def guests(*columns: str) -> DataFrame:
        """Visits to shards, or parts, other than a vector's own, with these columns of the vector."""
        each = routed.select("kind", F.col("shard").alias("mine"), F.explode("visits").alias("shard"), "h", *columns)
        each = with_parts(each).select("kind", "mine", "shard", "h", part.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *columns)
        return each.filter((F.col("shard") != F.col("mine")) | (F.col("part") != F.col("own"))).select(*where, "h", *columns)

    chunks = cut(guests().groupBy(*where).agg(F.ceil(F.count("*") / chunk_queries).cast("int").alias("n")))
    n_shards = chunks.count()
    chunks = F.broadcast(chunks) if n_shards <= BROADCAST_SHARDS else chunks

    def ranked(q: np.ndarray, q_ids: list, x: np.ndarray, ids: list, found: np.ndarray) -> tuple[list, list, list]:
        """Exact order of the best candidates of every query."""
        found = found[:, : 2 * k + 6]
        q, x = q.astype(np.float64), x.astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        src, dst, sim = [], [], []
        for a in range(0, len(q), 512):
            part, cand = q[a : a + 512], found[a : a + 512]
            s = np.einsum("qd,qkd->qk", part, x[np.maximum(cand, 0)]) / (norm[np.maximum(cand, 0)] * np.linalg.norm(part, axis=1)[:, None])
            for i, (vals, cs) in enumerate(zip(np.round(s, digits).tolist(), cand.tolist())):
                me = q_ids[a + i]
                best = sorted((-v, ids[c]) for v, c in zip(vals, cs) if c >= 0 and ids[c] != me)[:k]
                src += [me] * len(best)
                dst += [b for _, b in best]
                sim += [-v for v, _ in best]
        return src, dst, sim

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        raw = np.stack(frame["vec"].to_numpy()).astype(np.float32)
        ids = frame["id"].tolist()
        graph = Graph(unit(raw).astype(np.float32), ground, beam_build)
        src, dst, sim = ranked(raw, ids, raw, ids, graph.search(graph.x, beam, np.arange(len(ids))))
        stored: list = [None] * len(src)
        if n_shards:  # one more row holds the graph for the shard's guests
            stored.append(pickle.dumps((graph.arrays(), ids, raw), protocol=5))
            src, dst, sim = [*src, None], [*dst, None], [*sim, None]
        same = {c: [frame[c].iloc[0]] * len(src) for c in where}
        return plain_frame(id=src, neighbour=dst, similarity=sim, graph=stored, **same)

    built = cut(dealt.groupBy(*where).applyInPandas(build, f"id {key}, neighbour {key}, similarity double, graph binary, kind string, shard bigint, part int"))
    found = built.filter(F.col("graph").isNull()).select("id", "neighbour", "similarity")
    if n_shards:
        graphs = built.filter(F.col("graph").isNotNull()).select(*where, "graph")
        graphs = graphs.join(chunks, where).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        asked = guests("id", "vec").join(chunks, where).withColumn("chunk", F.pmod(F.shiftright("h", 16), F.col("n")).cast("int")).drop("n", "h")
        on = [*where, "chunk"]

        def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return plain_frame(id=[], neighbour=[], similarity=[])
            arrays, ids, raw = pickle.loads(right["graph"].iloc[0])
            q = np.stack(left["vec"].to_numpy()).astype(np.float32)
            src, dst, sim = ranked(q, left["id"].tolist(), raw, ids, Graph.of(arrays).search(unit(q).astype(np.float32), beam))
            return plain_frame(id=src, neighbour=dst, similarity=sim)

        found = found.unionByName(asked.groupBy(*on).cogroup(graphs.groupBy(*on)).applyInPandas(answer, empty))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    near = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).select("id", "neighbour", "similarity")
    # copies: neighbours of a distinct vector stand for the first ids of each neighbouring vector
    same_vec = ["kind", "h1", "h2"]
    rep = few.filter("rn = 1").select(F.col("id").alias("neighbour"), *[F.col(p).alias(f"n_{p}") for p in same_vec])
    mine = few.filter("rn = 1").select("id", *same_vec)
    hop = near.join(rep, "neighbour").join(mine, "id")
    same = [F.col(f"n_{p}") == F.col(f"f.{p}") for p in same_vec]
    others = hop.join(few.alias("f"), same[0] & same[1] & same[2]).select(*[hop[p] for p in same_vec], F.col("f.id").alias("neighbour"), "similarity")
    options = others.unionByName(few.select(*same_vec, F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity")))
    order = Window.partitionBy(*same_vec).orderBy(F.desc("similarity"), "neighbour")
    top = options.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1).drop("rn")
    each = few.drop("rn").join(top, same_vec)
    many = cut(everyone.groupBy(*same_vec).count().filter(F.col("count") > k + 1).select(*same_vec))
    if not many.isEmpty():  # the other copies of vectors with many: these may be a third of all rows, so their key is salted
        salts = F.explode(F.array(*[F.lit(i) for i in range(COPY_SALTS)])).alias("salt")
        more = everyone.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int")).join(many.select(*same_vec, salts), [*same_vec, "salt"])
        more = more.join(few.select("id"), "id", "left_anti")
        each = each.unionByName(more.join(top.join(many, same_vec).select(*same_vec, "neighbour", "similarity", salts), [*same_vec, "salt"]).drop("salt"))
    final = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return each.filter(F.col("id") != F.col("neighbour")).withColumn("rn", F.row_number().over(final)).filter(F.col("rn") <= k).select("id", "neighbour", "similarity")


def plain_frame(**columns: list) -> pd.DataFrame:
    """A frame of plain objects; string arrays of several chunks cannot be handed to Spark."""
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def vecs_of_few(points: DataFrame, share: Column) -> pa.Table:
    """A hash sample of the points, ``share`` of each kind."""
    return points.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("kind", "vec").toArrow()
