"""Incremental ingest and gating with Structured Streaming."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import unit_rows
from ..operators.selection import BLOCK, SLICE, _blocks
from ..runtime import cut, ensure_checkpoint_dir, spread


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the parquet files in a folder, or of one file; the schema is that of what is there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if os.path.isdir(path) or "://" in path:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def drain(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, state: str, processing_time: str | None = None) -> DataFrame:
    """Runs a stream until no new file is left and returns what it has written.

    Every micro-batch writes a folder of its own and writes it again if it is repeated, so each input
    counts once whatever fails.  With ``processing_time`` the stream goes on; stop it from its handle.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
    q = (q.trigger(processingTime=processing_time) if processing_time else q.trigger(availableNow=True)).start()
    if not processing_time:
        q.awaitTermination()
    return stream.sparkSession.read.parquet(target)


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and state folders in the shared folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def gate_batch(corpus: DataFrame, id_: str, vector: str, threshold: float, block: int = BLOCK) -> Callable[[DataFrame], DataFrame]:
    """A transformation that accepts arrivals less similar than ``threshold`` to every vector of the corpus but themselves.

    The corpus is carried to the arrivals in blocks of about ``block``, so it may be of any size.  An
    arrival that has nothing to be compared with is accepted, with similarity 0.
    """

    def judge(batch: DataFrame) -> DataFrame:
        kind = dict(batch.dtypes)[id_]
        rows = cut(spread(batch.select(F.col(id_).alias("id"), F.col(vector).alias("v"))).withColumn("row", F.monotonically_increasing_id()))
        met = rows.select("row", "id", F.lit(None).cast("double").alias("s"))
        for ids, known in _blocks(corpus, id_, vector, block):
            shared = corpus.sparkSession.sparkContext.broadcast((np.array(ids), known))

            def run(parts, shared=shared):  # noqa: ANN001, ANN202
                ids, known = shared.value
                for p in parts:
                    for i in range(0, len(p), SLICE):
                        x = p.iloc[i : i + SLICE]
                        s = np.round(unit_rows(np.stack(x["v"].to_numpy())) @ known.T, 12)
                        mine = x["id"].to_numpy()
                        for r in np.flatnonzero(np.isin(mine, ids)):
                            s[r, ids == mine[r]] = -np.inf
                        best = s.max(axis=1)
                        yield pd.DataFrame({"row": x["row"], "id": x["id"], "s": best})[best > -np.inf]

            met = met.unionByName(rows.select("row", "id", "v").mapInPandas(run, f"row bigint, id {kind}, s double"))
        best = met.groupBy("row", "id").agg(F.max("s").alias("s"))
        return best.select(F.col("id").alias(id_), F.coalesce("s", F.lit(0.0)).alias("similarity"), (F.col("s").isNull() | (F.col("s") < threshold)).alias("accept"))

    return judge


def new_only(arrivals: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Arrivals whose key has not been processed."""
    return arrivals.join(done.select(key).distinct(), key, "left_anti")
