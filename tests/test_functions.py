from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import vec as V
from spanloom.functions.identity import row_identity, without_repeats
from spanloom.operators import features as FE
from spanloom.operators.calibrate import fit_weights
from spanloom.operators.text import stems


def test_row_identity_tells_nulls_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None), ("x", "x"), (None, None)], "a string, b string")
    assert df.select(*row_identity(df)).distinct().count() == 4
    assert sorted(str(r[0]) for r in without_repeats(df, "a").collect()) == ["None", "None", "x", "x"]


def test_vector_functions_match_numpy(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=8), r.normal(size=8)
    va, vb = r.random(8), r.random(8)
    one = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b], [float(x) for x in va], [float(x) for x in vb], [0.0] * 8, [1, 2, 3], [2, 3, 4])], "a array<double>, b array<double>, va array<double>, vb array<double>, z array<double>, s array<int>, t array<int>")
    c = F.col
    got = one.select(V.cosine(c("a"), c("b")), V.bhattacharyya_similarity(c("a"), c("va"), c("b"), c("vb")), V.hellinger_cosine(c("va"), c("vb")), V.hellinger_cosine(c("va"), c("z")), V.jaccard(c("s"), c("t")), V.norm(V.l2_normalise(c("a"))), V.cosine(c("a"), c("z"))).first()
    v = (va + vb) / 2
    bhat = math.exp(-np.mean((a - b) ** 2 / (8 * v) + 0.5 * np.log(v / np.sqrt(va * vb))))
    hell = np.sqrt(va) @ np.sqrt(vb) / np.linalg.norm(np.sqrt(va)) / np.linalg.norm(np.sqrt(vb))
    assert list(got) == pytest.approx([a @ b / np.linalg.norm(a) / np.linalg.norm(b), bhat, hell, 0.0, 0.5, 1.0, 0.0], abs=1e-6)


def test_period_agreement_knows_multiples(spark):
    pairs = [(4.0, 4.05), (4.0, 8.0), (4.0, 6.3), (0.0, 4.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "p double, q double").select(V.period_agreement(F.col("p"), F.col("q"), F.lit(0.8), F.lit(0.8))).collect()]
    assert got[0] > 0.7 and got[1] > 0.7 and got[2] < 0.3 and got[3] == 0.0


def test_whitening_refuses_other_widths_and_centres(spark):
    r = np.random.default_rng(1)
    frames = [[[float(x) for x in r.normal(size=4) + [5, 0, 0, 0]] for _ in range(3)] for _ in range(30)]
    df = spark.createDataFrame([("e", f) for f in frames], "g string, f array<array<float>>")
    w = FE.whitener_rows(FE.fit_whitener(df, "g", "f"), "g").first()
    flat = np.concatenate(frames)
    n = len(flat)
    var = n / (n + 40) * flat.var(axis=0) + 40 / (n + 40) * flat.var(axis=0).mean()
    assert w["mu"] == pytest.approx(flat.mean(axis=0).tolist(), abs=1e-5) and w["sd"] == pytest.approx(np.sqrt(var).tolist(), abs=1e-5)
    z = spark.createDataFrame([([1.0] * 4,), ([1.0] * 5,)], "v array<double>").select(V.whiten(F.col("v"), F.array(*[F.lit(x) for x in w["mu"]]), F.array(*[F.lit(x) for x in w["sd"]])).alias("z")).collect()
    assert z[0]["z"] is not None and z[1]["z"] is None


def test_fused_scores_and_weights(spark):
    r = np.random.default_rng(2)
    rows = [(float(y + r.normal()), float(-y + r.normal()), float(r.normal()), bool(y)) for y in r.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "p double, q double, n double, y boolean")
    w = fit_weights(df, ["p", "q", "n"], "y")
    assert w["q"] == 0.0 and w["p"] > 0.8 and sum(w.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        fit_weights(df.filter("y"), ["p", "q", "n"], "y")
    x = spark.createDataFrame([(0.5, None, 0.2)], "env_cos double, env_chamfer double, env_bhat_sim double").select(FE.fuse()).first()[0]
    assert x == pytest.approx(0.5 * 0.5 + 0.15 * 0.2)


def test_stems(spark):
    texts = ["The worker is Inserting boxes, pressed & stacked; seeing gas", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stems(F.col("t"))).collect()]
    assert got == [["insert", "boxe", "press", "stack", "seeing", "gas"], [], []]
