"""A varied subset: sampling with probability inverse to a density taken from hash bucket counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .vectors import by_kind, matrix, unit

TABLES = 16
#: Sign bits of a bucket: so many that a kind's rows fall on average FILL into one, within these bounds.
LEAST_BITS, MOST_BITS, FILL = 12, 19, 16
#: Counters held by the driver and broadcast: kinds * TABLES * 2^BITS may not exceed this.
MAX_COUNTERS = 20_000_000


def planes(kind: str, width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Random hyperplanes of a kind of vectors; the same wherever they are made."""
    rng = np.random.default_rng([seed, zlib.crc32(kind.encode())])
    return rng.standard_normal((width, tables * bits)).astype(np.float32)


def bits_for(rows: int, kinds: int, tables: int = TABLES) -> int:
    """Bits of a bucket; they grow with the logarithm of the largest kind's rows as far as the counters allow."""
    bits = min(MOST_BITS, max(LEAST_BITS, (max(rows, 1) // FILL).bit_length() - 1))
    while bits > LEAST_BITS and kinds * (tables << bits) > MAX_COUNTERS:
        bits -= 1
    return bits


def codes(x: np.ndarray, p: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket of every row in every table."""
    signs = (x @ p > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def bucket_counts(vecs: DataFrame, tables: int = TABLES, bits: int = LEAST_BITS, seed: int = 7) -> dict[str, np.ndarray]:
    """Rows per bucket of every table and kind, over all rows; its size does not depend on their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        made: dict[str, np.ndarray] = {}
        for b in batches:
            for k, at in by_kind(b):
                x = matrix(b.column("vec").take(pa.array(at)))
                if k not in made:
                    made[k] = planes(k, x.shape[1], tables, bits, seed)
                    seen[k] = np.zeros(tables << bits, np.int64)
                c = codes(x, made[k], tables, bits) + (np.arange(tables) << bits)
                seen[k] += np.bincount(c.ravel(), minlength=tables << bits)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["kind", "bucket", "n"])

    kinds = vecs.select("kind").distinct().count()
    if kinds * (tables << bits) > MAX_COUNTERS:
        raise ValueError(f"{kinds} kinds of vectors need more than {MAX_COUNTERS} counters")
    got = vecs.select("kind", "vec").mapInArrow(count, "kind string, bucket bigint, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, np.ndarray] = {}
    names = got.column("kind").to_numpy()
    for k in dict.fromkeys(names):
        at = np.flatnonzero(names == k)
        out[k] = np.zeros(tables << bits, np.int64)
        out[k][got.column("bucket").to_numpy()[at]] = got.column("n").to_numpy()[at]
    return out


def choose_varied(vecs: DataFrame, size: int, tables: int = TABLES, bits: int | None = None, seed: int = 7) -> DataFrame:
    """``size`` ids in order of choice, each with the gain it adds.

    ``vecs`` has ``id, kind, vec`` (see ``usable_vectors``).  A row's density is the mean number of
    rows in its buckets; rows are drawn without replacement, with a probability inverse to it at
    every draw, so the first n picks are such a sample of size n.  The gain of a pick is what it adds
    to the sum, over all rows, of the largest cosine to a pick of the same kind (negative ones count
    as zero).  With fewer rows than ``size`` all are picked; without rows the result is empty.

    Two passes over the vectors and a top-``size``; the only data on the driver are bucket counts,
    of at most ``MAX_COUNTERS`` buckets, and the picks themselves.

    Returns ``rank`` (from 1), ``id``, ``gain``, ``coverage`` (of all rows' total).
    """
    spark = vecs.sparkSession
    vecs = cut(vecs)
    if bits is None:
        sizes = [x["count"] for x in vecs.groupBy("kind").count().collect()]  # one row a kind
        bits = bits_for(max(sizes, default=0), len(sizes), tables)
    counts = spark.sparkContext.broadcast(bucket_counts(vecs, tables, bits, seed))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, np.ndarray] = {}
        for b in batches:
            density = np.ones(b.num_rows)
            for k, at in by_kind(b):
                x = matrix(b.column("vec").take(pa.array(at)))
                if k not in made:
                    made[k] = planes(k, x.shape[1], tables, bits, seed)
                c = codes(x, made[k], tables, bits) + (np.arange(tables) << bits)
                density[at] = counts.value[k][c].mean(axis=1)
            u = b.column("u").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("kind"), b.column("vec"), pa.array(-np.log(u) * density)], ["id", "kind", "vec", "draw"])

    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = vecs.select("id", "kind", "vec", u.alias("u")).mapInArrow(weigh, "id string, kind string, vec array<float>, draw double")
    picks = drawn.orderBy("draw", "id").limit(size).collect()  # at most `size` rows
    if not picks:
        return spark.createDataFrame([], "rank int, id string, gain double, coverage double")
    chosen = spark.sparkContext.broadcast([(p["kind"], np.asarray(p["vec"], np.float32)) for p in picks])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(chosen.value))
        rows = 0
        sides: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for k in {k for k, _ in chosen.value}:
            at = np.array([i for i, (kk, _) in enumerate(chosen.value) if kk == k])
            sides[k] = at, unit(np.stack([chosen.value[i][1] for i in at]))
        for b in batches:
            rows += b.num_rows
            for k, at in by_kind(b):
                if k in sides:
                    where, p = sides[k]
                    best = np.maximum.accumulate(np.maximum(unit(matrix(b.column("vec").take(pa.array(at)))) @ p.T, 0), axis=1)
                    total[where] += np.diff(best, axis=1, prepend=0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([rows] * len(total), pa.int64())], ["i", "gain", "n"])

    sums = vecs.select("kind", "vec").mapInArrow(gains, "i int, gain double, n bigint").groupBy("i").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"))
    got = {r["i"]: r for r in sums.collect()}
    out, so_far = [], 0.0
    for i, p in enumerate(picks):
        so_far += got[i]["gain"]
        out.append((i + 1, p["id"], got[i]["gain"], so_far / got[i]["n"]))
    return spark.createDataFrame(out, "rank int, id string, gain double, coverage double")
