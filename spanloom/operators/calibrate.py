"""Calibration against the corpus: null grids, percentiles, ranks, sweeps, fitted weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import exact_grid, numbered, running_total

POINTS = 201


def null_grid(long: DataFrame, group: list[str], value: str, points: int = POINTS) -> DataFrame:
    """Exact percentile grid, mean and population deviation: ``group, n_pairs, quantiles, mean_value, std_value``.

    NaN and null values do not count.
    """
    grid = exact_grid(long, group, value, points)
    ok = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    moments = ok.groupBy(*group).agg(F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"))
    return grid.withColumnRenamed("n", "n_pairs").join(moments, group)


def one_sided_percentile(values: DataFrame, null: DataFrame, value: str, null_value: str, out: str = "percentile") -> DataFrame:
    """Share of null values strictly below each value, in percent; null for a null or NaN value.

    Both sides are counted per distinct value and ranked by running totals, without comparing all with all.
    """
    ok = lambda df, c: df.filter(F.col(c).isNotNull() & ~F.isnan(c))
    known = ok(null, null_value).groupBy(F.col(null_value).alias("x")).agg(F.count("*").alias("n")).withColumn("asked", F.lit(0))
    asked = ok(values, value).select(F.col(value).alias("x")).distinct().withColumn("n", F.lit(0).cast("bigint")).withColumn("asked", F.lit(1))
    ranked = running_total(known.unionByName(asked), "x", "n").filter("asked = 1")
    share = ranked.select(F.col("x").alias("__x"), (F.col("before") * 100.0 / F.col("whole")).alias(out))
    return values.join(share, values[value] == F.col("__x"), "left").drop("__x")


def score_counts(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Positives and negatives per distinct score, with those at or above it: ``score, pos, neg, pos_at, neg_at, all_pos, all_neg``.

    Rows with a null or NaN score, or without a label, do not count.
    """
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(positive).isNotNull())
    c = ok.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("neg"))
    p = running_total(c, "score", "pos", descending=True).withColumnsRenamed({"upto": "pos_at", "whole": "all_pos"}).drop("before")
    return running_total(p, "score", "neg", descending=True).withColumnsRenamed({"upto": "neg_at", "whole": "all_neg"}).drop("before")


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row ``auc, n_pos, n_neg``: chance that a positive scores above a negative, ties counting half."""
    c = score_counts(df, score, positive)
    sums = c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                 F.sum(F.col("pos").cast("double") * F.col("neg_at")).alias("lost"), F.sum(F.col("pos").cast("double") * F.col("neg")).alias("tied"))
    n = F.col("n_pos").cast("double") * F.col("n_neg")
    # of all pairs, a positive loses to the negatives at or above it, of which the tied ones count half
    return sums.select((1 - (F.col("lost") - 0.5 * F.col("tied")) / n).alias("auc"), "n_pos", "n_neg")


def rank_auc(df: DataFrame, score: str, positive: str, order: list[str]) -> DataFrame:
    """AUC from plain ranks without a correction for ties; equal scores rank in the order of ``order``.

    Kept for comparison with ``auc``, which is the one to use.
    """
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(positive).isNotNull())
    pos = F.col(positive)
    s = numbered(ok, score, order, out="rn").agg(F.sum(F.when(pos, F.col("rn"))).alias("r"), F.sum(pos.cast("bigint")).alias("p"), F.count("*").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def f1_sweep(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Every distinct score as a threshold (score >= t): ``threshold, tp, fp, fn, precision, recall, f1``."""
    r = score_counts(df, score, positive)
    tp, fp, fn = F.col("pos_at"), F.col("neg_at"), F.col("all_pos") - F.col("pos_at")
    return r.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (tp / (tp + fp)).alias("precision"),
                    F.when(F.col("all_pos") > 0, tp / F.col("all_pos")).otherwise(0.0).alias("recall"), F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def best_cut(df: DataFrame, score: str, positive: str) -> DataFrame:
    """The threshold of the best F1; of equally good ones the lowest."""
    return f1_sweep(df, score, positive).orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def separation(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Difference of the class means in units of the pooled population deviation."""
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(positive).isNotNull())
    p, n = F.when(F.col(positive), F.col(score)), F.when(~F.col(positive), F.col(score))
    s = ok.agg(F.avg(p).alias("mp"), F.avg(n).alias("mn"), F.var_pop(p).alias("vp"), F.var_pop(n).alias("vn"))
    return s.select("mp", "mn", ((F.col("mp") - F.col("mn")) / F.sqrt((F.col("vp") + F.col("vn")) / 2)).alias("separation"))


def fit_weights(df: DataFrame, components: list[str], positive: str) -> dict[str, float]:
    """Weights of a fused score from labelled rows: logistic regression on standardised components.

    Negative coefficients become zero and the rest is scaled to one.  Refused with one class only,
    with fewer rows than twice the components, or if nothing stays positive.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ok = df.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in components], F.col(positive).cast("double").alias("label")).filter("label IS NOT NULL")
    s = ok.agg(F.count("*").alias("n"), F.sum("label").alias("p"), *[F.avg(c).alias(f"m_{c}") for c in components], *[F.stddev_pop(c).alias(f"s_{c}") for c in components]).first()
    if not s["n"] or s["n"] < 2 * len(components) or s["p"] in (0, s["n"]):
        raise ValueError("labels of both classes, and two rows a component, are needed")
    z = ok.select(*[((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + 1e-8)).alias(c) for c in components], "label")
    model = LogisticRegression(regParam=1.0 / s["n"], elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(
        VectorAssembler(inputCols=components, outputCol="features").transform(z))
    coef = [max(0.0, float(x)) for x in model.coefficients]
    if sum(coef) <= 0:
        raise ValueError("no component speaks for the label")
    return {c: x / sum(coef) for c, x in zip(components, coef)}


def split_half(frames: DataFrame, key: str, vectors: str, least: int = 6) -> DataFrame:
    """First and second half of every record with at least ``least`` vectors."""
    n = F.size(vectors)
    half = F.floor(n / 2).cast("int")
    return frames.filter(n >= least).select(key, F.slice(vectors, F.lit(1), half).alias("first"), F.slice(vectors, half + 1, n - half).alias("second"))


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key and their share of all rows."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("total")))
    return c.join(total).select(*keys, "n", (F.col("n") / F.col("total")).alias("share"))

