"""Queries that run a stream to its end and return its final state."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import r6
from ..operators.intervals import to_millis
from ..runtime import table
from ..streaming.ingest import drain, file_stream, gate_batch, scratch


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable caption segments and their seconds per video after all files have come in."""

    def usable(batch: DataFrame) -> DataFrame:
        b = batch.filter("error IS NULL").select("video_id", "segment_id", to_millis(F.col("t0")).alias("s"), to_millis(F.col("t1")).alias("e"))
        return b.filter("s IS NOT NULL AND e > s")

    out, state = scratch(spark, "ingest")
    got = drain(file_stream(spark, os.path.join(sf_dir, "caption_segments.parquet")), usable, out, state)
    once = got.groupBy("video_id", "segment_id").agg(F.max(F.col("e") - F.col("s")).alias("ms"))
    return once.groupBy("video_id").agg(F.count("*").alias("n_segments"), F.sum("ms").alias("total_ms"))


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arriving vector against all other vectors of the table."""
    judge = gate_batch(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.55)
    out, state = scratch(spark, "gate")
    got = drain(file_stream(spark, os.path.join(sf_dir, "embeddings.parquet")), judge, out, state)
    return got.select("vec_id", r6(F.col("similarity")).alias("similarity"), "accept")


QUERIES = {"stream_ingest": stream_ingest, "stream_gate": stream_gate}
ORACLES = {
    "stream_ingest": """WITH u AS (SELECT video_id, segment_id, CAST(round(t0 * 1000) AS BIGINT) AS s, CAST(round(t1 * 1000) AS BIGINT) AS e FROM caption_segments WHERE error IS NULL AND t0 IS NOT NULL AND t1 IS NOT NULL),
      o AS (SELECT video_id, segment_id, max(e - s) AS ms FROM u WHERE e > s GROUP BY ALL) SELECT video_id, count(*) AS n_segments, CAST(sum(ms) AS BIGINT) AS total_ms FROM o GROUP BY video_id""",
    "stream_gate": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS n FROM embeddings),
      s AS (SELECT x.vec_id, max(round(list_dot_product(x.v, r.v) / (x.n * r.n), 12)) AS s FROM v x JOIN v r ON r.vec_id <> x.vec_id GROUP BY x.vec_id) SELECT vec_id, round(s, 6) + 0.0 AS similarity, s < 0.55 AS accept FROM s""",
}
