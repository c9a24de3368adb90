"""Views of the project's tables that several plans share, with their SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import without_repeats
from ..runtime import parts_of, table, with_part


def latest_segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per segment: the one indexed last.  Only the columns asked for are read and moved."""
    t = table(spark, sf_dir, "signatures")
    body = F.struct(*[F.col(c) for c in columns])
    return t.groupBy("segment_id").agg(F.max_by(body, "indexed_at").alias("b")).select("segment_id", "b.*")


#: The same as a common table expression ``seg`` with the columns of the signatures.
SEG = "seg AS (SELECT * FROM signatures QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY indexed_at DESC) = 1)"


CAPTION_COLUMNS = ("t0", "t1", "station", "verb", "object_name", "caption", "hand_left_action", "hand_left_object", "hand_right_action", "hand_right_object", "confidence")


def usable_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption segments without an error and with a positive span, one row per segment of a video."""
    return _latest(_usable(spark, sf_dir), CAPTION_COLUMNS, "video_id", "segment_id")


def placed_captions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same with the columns asked for alone, of known videos, moved once: all of a video lie together, or of its ``part`` if it has many."""
    t = _usable(spark, sf_dir).filter("video_id IS NOT NULL")
    t = with_part(t, parts_of(t, "video_id"), "video_id", "segment_id").repartition("video_id", "part")
    return _latest(t, columns, "video_id", "part", "segment_id")


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "caption_segments").filter(F.col("error").isNull() & F.col("t0").isNotNull() & F.col("t1").isNotNull() & (F.col("t1") > F.col("t0")))


def _latest(t: DataFrame, columns: tuple[str, ...], *keys: str) -> DataFrame:
    return t.groupBy(*keys).agg(F.max_by(F.struct(*columns), "captioned_at").alias("b")).select(*keys, "b.*")


CAPS = """caps AS (SELECT * FROM caption_segments WHERE error IS NULL AND t0 IS NOT NULL AND t1 IS NOT NULL AND t1 > t0
  QUALIFY row_number() OVER (PARTITION BY video_id, segment_id ORDER BY captioned_at DESC) = 1)"""


def distinct_verdicts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Verdict rows without exact repeats."""
    return without_repeats(table(spark, sf_dir, "verdicts"), *columns)


def with_null_model(spark: SparkSession, sf_dir: str, verdicts: DataFrame, metric: str, *columns: str) -> DataFrame:
    """Verdicts beside the null model of the encoder that both segments were last indexed with.

    The model's columns are null where the encoders differ, a segment is unknown, or the encoder has no model.
    """
    s = latest_segments(spark, sf_dir, "app_encoder")
    n = table(spark, sf_dir, "null_models").filter(F.col("metric") == metric).select(F.col("encoder").alias("__a"), *columns)  # one row an encoder
    met = verdicts.join(s.toDF("a", "__a"), "a", "left").join(s.toDF("b", "__b"), "b", "left")
    met = met.withColumn("__a", F.when(F.col("__a") == F.col("__b"), F.col("__a")))
    return met.join(F.broadcast(n), "__a", "left").select(*verdicts.columns, *columns)


#: The verdicts ``verd`` as a common table expression ``nulls`` beside that model; needs ``seg``.
NULLS = """nulls AS (SELECT v.*, n.quantiles AS q, n.mean_value, n.std_value FROM verd v LEFT JOIN seg x ON v.a = x.segment_id LEFT JOIN seg y ON v.b = y.segment_id
  LEFT JOIN null_models n ON n.metric = 'env_raw' AND n.encoder = x.app_encoder AND x.app_encoder = y.app_encoder)"""

VERD = "verd AS (SELECT DISTINCT * FROM verdicts)"


def clean_token_sql(c: str) -> str:
    t = f"trim(regexp_replace(lower(trim({c})), '\\s+', ' ', 'g'), ' .,;:')"
    return f"CASE WHEN coalesce({t}, '') IN ('', 'none', 'n/a', 'na', 'null', 'unknown', 'nan', '-') THEN '' ELSE {t} END"
