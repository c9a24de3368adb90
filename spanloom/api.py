"""The small public interface: a catalog of segments that can be compared, searched, selected and gated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import Settings
from .functions import vec as V
from .operators import decide as D
from .operators import features as FE
from .operators.calibrate import null_grid
from .operators.overlap import source_overlap
from .operators.selection import facility_location, gate, search


@dataclass(frozen=True)
class Catalog:
    """Segments with ``segment_id, video_id, app_encoder, app_frames, app_mean, phash, phash_ts``, and a null model."""

    segments: DataFrame
    settings: Settings = Settings()
    null: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, settings: Settings | None = None) -> Catalog:
        return cls(spark.read.parquet(path), settings or Settings())

    def scores(self, pairs: DataFrame) -> DataFrame:
        """Environment scores of pairs ``a, b``."""
        return FE.env_scores(pairs, self.segments.select("segment_id", "app_encoder", "app_frames"))

    def calibrated(self, pairs: DataFrame) -> Catalog:
        """This catalog with a null model from the scores of the given pairs."""
        long = self.scores(pairs).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("env_cos", "env_chamfer", "env_bhat_sim", "env_raw")])).alias("p")).select("p.*")
        return Catalog(self.segments, self.settings, null_grid(long, ["metric"], "value"))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Verdict per pair: percentile against the null model (a scaled score and a note without one), shared source first."""
        d = self.settings.decision
        scored = self.scores(pairs)
        over = source_overlap(FE.attach_pair(pairs, self.segments.select("segment_id", "phash", "phash_ts"), "segment_id"))
        r = scored.join(over, ["a", "b"], "left")
        if self.null is None:
            r = r.withColumn("env", D.uncalibrated(F.col("env_raw"))).withColumn("calibrated", F.lit(False))
        else:
            grid = F.broadcast(self.null.filter("metric = 'env_raw'").select("quantiles"))  # one row
            r = r.join(grid).withColumn("env", V.grid_percentile(F.col("env_raw"), F.col("quantiles"))).withColumn("calibrated", F.lit(True))
        dup = D.is_duplicate(F.col("overlap_seconds"), F.col("fraction_of_a"), F.col("fraction_of_b"))
        label = F.when(dup, "DUPLICATE_SOURCE").otherwise(D.percentile_verdict(F.col("env"), F.lit(None).cast("double"), d.env_percentile, d.task_percentile))
        return r.select("a", "b", "env", label.alias("label"), D.kept(label).alias("keep"), D.notes((~F.col("calibrated"), "uncalibrated"), (~dup & (F.col("overlap_seconds") > 0), "weak overlap")).alias("notes"))

    def _vectors(self) -> DataFrame:
        return self.segments.filter(F.col("app_mean").isNotNull())

    def nearest(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k nearest segments of each queried one (all of one encoder)."""
        return search(self._vectors(), queries, "segment_id", "app_mean", k)

    def admit(self, arrivals: DataFrame, threshold: float = D.GATE) -> DataFrame:
        """Which arrivals are new enough; an empty catalog admits all."""
        return gate(search(self._vectors(), arrivals, "segment_id", "app_mean", 1), arrivals, "segment_id", threshold)

    def select(self, candidates: DataFrame, budget: int) -> DataFrame:
        """A representative choice among the candidates."""
        return facility_location(self._vectors(), candidates, "segment_id", "app_mean", budget)
