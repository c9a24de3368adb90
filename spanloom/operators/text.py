"""Text and caption profiles, their weights and similarities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import clean_token
from .kernels import unit_rows

#: Words that carry no task.
STOP = """a an the is are was were be been being this that these those there
of in on at to from with without into onto for by and or but then than as it its
his her their them they he she person worker man woman using use used uses while
during after before over under across around near next other another some each
both all more most very much many few several one two three both hand hands left
right side front back top bottom part parts thing things item items area place
appears seems looks like seen visible camera view wearing""".split()
FLOOR = 0.05
ACTIONS = ("verb", "hand_left_action", "hand_right_action")
OBJECTS = ("object_name", "hand_left_object", "hand_right_object")
TASK_PARTS = {"action_cos": 0.40, "action_jaccard": 0.25, "object_cos": 0.20, "object_jaccard": 0.15}


def stems(text: Column) -> Column:
    """Words of a to z, at least three letters, without stop words, each without its first fitting ending."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)")), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))

    def cut(w: Column) -> Column:
        out = w
        for end in ("s", "es", "ed", "ing"):  # the one tried first is outermost
            out = F.when(w.endswith(end) & (F.length(w) >= len(end) + 4), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
        return out

    return F.coalesce(F.transform(words, cut), F.array().cast("array<string>"))


def token_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, token, n``."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def idf(counts: DataFrame, key: str, documents: int, floor: float | None = FLOOR) -> DataFrame:
    """``token, df, idf``: log of all documents over those with the token, with a floor if one is given."""
    d = counts.select(key, "token").distinct().groupBy("token").agg(F.count("*").alias("df"))
    raw = F.log(F.lit(float(max(documents, 1))) / F.col("df"))
    return d.withColumn("idf", raw if floor is None else F.greatest(raw, F.lit(floor)))


def tfidf(counts: DataFrame, weights: DataFrame, key: str, floor: float = FLOOR) -> DataFrame:
    """``key, token, w``: counts times weight, scaled to length one per key."""
    w = counts.join(weights.select("token", "idf"), "token").withColumn("x", F.col("n") * F.greatest("idf", F.lit(floor)))
    size = w.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return w.join(size, key).select(key, "token", (F.col("x") / F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)).alias("w"))


def profile_dot(pairs: DataFrame, profile: DataFrame, key: str, covered: DataFrame, out: str = "similarity") -> DataFrame:
    """``a, b`` and the sum over shared tokens of both weights; null unless both ends are in ``covered`` (column ``key``)."""
    have = covered.select(key).distinct()
    known = pairs.join(have.select(F.col(key).alias("a"), F.lit(1).alias("ka")), "a", "left").join(have.select(F.col(key).alias("b"), F.lit(1).alias("kb")), "b", "left")
    pa = profile.select(F.col(key).alias("a"), "token", F.col("w").alias("wa"))
    pb = profile.select(F.col(key).alias("b"), "token", F.col("w").alias("wb"))
    sums = pairs.join(pa, "a").join(pb, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return known.join(sums, ["a", "b"], "left").select("a", "b", F.when(F.col("ka").isNotNull() & F.col("kb").isNotNull(), F.coalesce("s", F.lit(0.0))).alias(out))


def field_tokens(columns: tuple[str, ...]) -> Column:
    """Distinct non-empty tokens of several fields, in their order."""
    return F.array_distinct(F.filter(F.array(*[clean_token(F.col(c)) for c in columns]), lambda t: t != ""))


def time_profile(segments: DataFrame, key: str, tokens: Column, seconds: Column) -> DataFrame:
    """``key, token, w``: share of time per token; a segment's time is split evenly over its tokens."""
    t = segments.select(key, tokens.alias("ts"), seconds.alias("s")).filter(F.size("ts") > 0)
    long = t.select(key, F.explode("ts").alias("token"), (F.col("s") / F.size("ts")).alias("x")).groupBy(key, "token").agg(F.sum("x").alias("x"))
    total = long.groupBy(key).agg(F.sum("x").alias("total"))
    return long.join(total, key).filter("total > 0").select(key, "token", (F.col("x") / F.col("total")).alias("w"))


def reweight(profile: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Profile times token weight (1 for unknown tokens), scaled back to sum to one."""
    x = profile.join(weights.select("token", "idf"), "token", "left").withColumn("x", F.col("w") * F.coalesce("idf", F.lit(1.0)))
    total = x.groupBy(key).agg(F.sum("x").alias("total"))
    return x.join(total, key).filter("total > 0").select(key, "token", (F.col("x") / F.col("total")).alias("w"))


def profile_overlap(pairs: DataFrame, profile: DataFrame, key: str, name: str) -> DataFrame:
    """``a, b, name_cos, name_jaccard`` of two profiles; 0 where neither has tokens or none is shared."""
    size = profile.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("n"))
    sa = size.select(F.col(key).alias("a"), F.col("norm").alias("norm_a"), F.col("n").alias("n_a"))
    sb = size.select(F.col(key).alias("b"), F.col("norm").alias("norm_b"), F.col("n").alias("n_b"))
    pa = profile.select(F.col(key).alias("a"), "token", F.col("w").alias("wa"))
    pb = profile.select(F.col(key).alias("b"), "token", F.col("w").alias("wb"))
    met = pairs.join(pa, "a").join(pb, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("d"), F.count("*").alias("c"))
    r = pairs.join(sa, "a", "left").join(sb, "b", "left").join(met, ["a", "b"], "left")
    cos = F.when(F.col("norm_a") * F.col("norm_b") > 0, F.coalesce("d", F.lit(0.0)) / (F.col("norm_a") * F.col("norm_b"))).otherwise(0.0)
    union = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0)) - F.coalesce("c", F.lit(0))
    return r.select("a", "b", cos.alias(f"{name}_cos"), F.when(union > 0, F.coalesce("c", F.lit(0)) / union).otherwise(0.0).alias(f"{name}_jaccard"))


def dominant(profile: DataFrame, key: str) -> DataFrame:
    """The token with the largest share; of equal ones the first in the alphabet."""
    best = F.min_by("token", F.struct((-F.round("w", 9)).alias("x"), "token"))
    return profile.groupBy(key).agg(best.alias("token"))


def bag_of_words(text: Column) -> Column:
    """Words of a to z of more than three letters."""
    return F.coalesce(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)")), lambda w: F.length(w) > 3), F.array().cast("array<string>"))


def embedded_captions(pairs: DataFrame, captions: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``a, b, caption_chamfer``: mean best cosine, both ways, of the embedded distinct captions of pairs ``a, b``.

    ``embed`` maps texts to the rows of a matrix; it runs on executors, once for each distinct caption.  Null and empty captions
    do not count; a pair with a side without captions scores 0.
    """
    kind = dict(captions.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"t": b["t"], "v": list(unit_rows(np.asarray(embed(b["t"].tolist()), np.float64)))})

    said = captions.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    vectors = said.select("t").distinct().mapInPandas(run, "t string, v array<double>")
    counted = said.groupBy("k", "t").count().join(vectors, "t")
    sets = counted.groupBy("k").agg(F.collect_list(F.struct("v", F.col("count").alias("n"))).alias("s"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["x"], b["y"]):
                value = 0.0
                if x is not None and y is not None:
                    (p, n), (q, m) = ((np.stack([i["v"] for i in s]), np.array([i["n"] for i in s], float)) for s in (x, y))
                    c = p @ q.T
                    value = 0.5 * (np.average(c.max(axis=1), weights=n) + np.average(c.max(axis=0), weights=m))
                out.append(float(value))
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "caption_chamfer": pd.Series(out, index=b.index, dtype="float64")})

    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a", "left").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b", "left")
    return both.select("a", "b", "x", "y").mapInPandas(score, f"a {kind}, b {kind}, caption_chamfer double")
