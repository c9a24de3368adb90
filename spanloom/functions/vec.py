"""Scalar functions on array columns: vectors, sets and hash words, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
#: Smallest variance that the diagonal Bhattacharyya distance uses.
VAR_FLOOR = 1e-6


def r6(x: Column) -> Column:
    """Rounded to six decimals without negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def r6_scaled(x: Column) -> Column:
    """The same as SQL rounds a double: the double times a million decides, not its decimal text, which differs half way between two values."""
    return F.round(x * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    # a one-element array binds the norm, which would else be computed again for every element
    return F.get(F.transform(F.array(norm(v) + F.lit(EPS)), lambda n: F.transform(doubles(v), lambda x: x / n)), 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPS)) * (norm(b) + F.lit(EPS)))


def whiten(v: Column, mu: Column, sd: Column) -> Column:
    """(v - mu) / sd, then unit length; a vector of another width than the statistics is refused (null)."""
    z = F.zip_with(F.zip_with(doubles(v), mu, lambda x, m: x - m), sd, lambda x, s: x / s)
    return F.when(F.size(v) == F.size(mu), l2_normalise(z))


def bhattacharyya_similarity(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    """exp(-distance) of two diagonal Gaussians, the distance averaged over the dimensions."""
    floor = lambda v: F.transform(doubles(v), lambda x: F.greatest(x, F.lit(VAR_FLOOR)))
    gap = F.zip_with(doubles(mean_a), doubles(mean_b), lambda x, y: (x - y) * (x - y))
    var = F.arrays_zip(floor(var_a).alias("p"), floor(var_b).alias("q"))
    term = F.zip_with(gap, var, lambda d, v: d / (8 * (v["p"] + v["q"]) / 2) + 0.5 * F.log((v["p"] + v["q"]) / 2 / F.sqrt(v["p"] * v["q"])))
    return F.exp(-total(term) / F.size(mean_a))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit words."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def period_agreement(p: Column, q: Column, s: Column, t: Column, width: float = 0.15) -> Column:
    """Agreement of two periods, allowing for the double and the triple, weighted by both strengths."""
    ratio = F.greatest(p, q) / F.least(p, q)
    off = F.least(*[F.abs(ratio - k) / k for k in (1.0, 2.0, 3.0)])
    fits = (p > 0) & (q > 0)
    return F.when(fits, F.exp(-(off / width) * (off / width)) * F.sqrt(F.greatest(s * t, F.lit(0.0)))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def hellinger_cosine(a: Column, b: Column) -> Column:
    """Cosine of square roots of two spectra; 0 if either has no mass."""
    root = lambda v: F.transform(doubles(v), lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))
    return F.when((total(doubles(a)) > 0) & (total(doubles(b)) > 0), dot(root(a), root(b)) / ((norm(root(a)) + F.lit(EPS)) * (norm(root(b)) + F.lit(EPS)))).otherwise(0.0)


def pack_bits(v: Column) -> Column:
    """64-bit word of 64 coefficients: bit k is set where coefficient k exceeds the median of 1..63; bit 0 stays clear."""
    rest = F.array_sort(F.slice(v, 2, 63))
    median = F.element_at(rest, 32)
    bits = F.transform(v, lambda x, i: F.when((x > median) & (i > 0), F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i.cast("int"))), F.expr("0L"), lambda s, b: s.bitwiseOR(b))


def even_sample(v: Column, k: int) -> Column:
    """At most ``k`` elements at evenly spaced places, the first and the last among them."""
    n = F.size(v)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("int") + 1)
    return F.when(n <= k, v).otherwise(F.transform(at, lambda i: F.element_at(v, i)))


def grid_place(x: Column, grid: Column) -> Column:
    """Place of ``x`` in a sorted grid of percentiles, 0..1, interpolated; of equal knots the last counts.  Null for no reading (null, NaN) or no grid."""
    n = F.size(grid)
    below = F.size(F.filter(grid, lambda g: g <= x))
    lo, hi = F.element_at(grid, below), F.element_at(grid, F.least(below + 1, n))
    inside = (below - 1 + (x - lo) / (hi - lo)) / (n - 1)
    return F.when(x.isNull() | F.isnan(x) | grid.isNull(), F.lit(None).cast("double")).when(below == 0, 0.0).when(below >= n, 1.0).otherwise(inside)


def grid_percentile(x: Column, grid: Column) -> Column:
    """That place as a percentile, 0..100."""
    return grid_place(x, grid) * 100.0


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Standardised value; null without spread and for no reading (null, NaN)."""
    return F.when((std > 0) & ~F.isnan(x), (x - mean) / std)


def parse_seconds(text: Column) -> Column:
    """Seconds from ``hh:mm:ss.s``, ``mm:ss.s`` or plain seconds; null if it is none of these."""
    t = F.trim(text)
    parts = F.transform(F.split(t, ":"), lambda p: p.try_cast("double"))
    folded = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)
    return F.coalesce(t.try_cast("double"), F.when(t.contains(":"), folded))


def clean_token(text: Column) -> Column:
    """Lower-case token without outer blanks and marks; the usual spellings of nothing become empty."""
    t = F.btrim(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.lit(" .,;:"))
    return F.when(F.coalesce(t, F.lit("")).isin("", "none", "n/a", "na", "null", "unknown", "nan", "-"), "").otherwise(t)
