"""Session-level helpers: durable lineage cuts, bounded broadcasts, table access."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_PART = 16_384


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset a folder is made
    only for a local master; on a cluster a machine-local folder would be lost with its
    executor, so the call fails instead.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def work_partitions(spark: SparkSession) -> int:
    """Partitions for work whose cost does not follow the bytes it reads."""
    return max(4 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer partitions than there are cores; else unchanged.

    For work that costs far more than moving its input; large inputs are never moved.
    """
    # the partitions of a plan with shuffles are only known by running it, the number of its files is not
    if len(df.inputFiles()) >= parallelism(df.sparkSession) or df.rdd.getNumPartitions() >= parallelism(df.sparkSession):
        return df
    return df.repartition(work_partitions(df.sparkSession))


def parts_of(rows: DataFrame, key: str) -> DataFrame:
    """``key, parts`` of the keys with more than ``ROWS_A_PART`` rows, broadcast: there is at most one for so many rows."""
    n = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > ROWS_A_PART)
    return F.broadcast(n.select(key, F.ceil(F.col("n") / ROWS_A_PART).alias("parts")))


def with_part(df: DataFrame, parts: DataFrame, key: str, by: str, out: str = "part") -> DataFrame:
    """``df`` and the part of its key that a row falls into by the hash of ``by``; part 0 of keys without parts."""
    number = F.coalesce("parts", F.lit(1).cast("bigint"))
    return df.join(F.broadcast(parts), key, "left").withColumn(out, F.pmod(F.xxhash64(by), number)).drop("parts")
