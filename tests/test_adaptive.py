import numpy as np
import pandas as pd
import pytest

from tidemark.operators import adaptive
from tidemark.operators.series import Series
from tidemark.sources import synthetic

S = Series(("series",), ("i",))


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 300])
def test_kernels_decode_exactly(seed, n):
    x = np.random.default_rng(seed).integers(-40_000, 40_000, n).cumsum()
    for how in ("sums", "gradient"):
        assert (adaptive.online_regress(adaptive.online_regress(x, how), how, decode=True) == x).all()
    residuals, picks = adaptive.online_codebook(x, k=3)
    assert (adaptive.online_codebook(residuals, k=3, picks=picks)[0] == x).all()


def test_kernels_learn():
    ramp = np.cumsum(np.full(400, 7))
    assert (adaptive.online_regress(ramp, "sums")[16:] == 0).all()
    assert abs(adaptive.online_regress(np.cumsum(np.full(4_000, 700)), "gradient")[-8:]).max() < 100
    two = np.tile(np.concatenate([np.arange(8) * 50, np.full(8, 900)]), 20)
    assert (adaptive.online_codebook(two, k=2)[0][16:] == 0).all()


def test_nearest_earlier(spark):
    a, b = [5, 9, 2, 7, 5, 3, 8, 1], [90, 80, 70, 60, 50, 40, 30, 20]
    x = a + b + [v + 1 for v in a] + [v - 2 for v in b] + [1, 2]
    got = adaptive.nearest_earlier(spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "series int, i int, x long"), S, "x").orderBy("block").collect()
    assert [(r.back, list(r.residual)) for r in got] == [(0, a), (1, [p - q for p, q in zip(b, a)]), (2, [1] * 8), (2, [-2] * 8)]


def test_filter_bank_finds_planted_filters(spark):
    rng, rows = np.random.default_rng(1), []
    for s, (c, d) in enumerate([(0.9, -0.5), (-0.8, 0.1)] * 3):
        v = [0.0, 0.0]
        for _ in range(398):
            v.append(c * v[-1] + d * v[-2] + rng.normal())
        rows += [(s, i, float(x)) for i, x in enumerate(v)]
    out, bank = adaptive.filter_bank(spark.createDataFrame(rows, "series int, i int, x double"), S, "x", k=2, steps=20)
    assert out.count() == 6 * 50
    assert min(max(abs(np.array(w) - t)) for w in bank for t in ([0.9, -0.5],)) < 0.35 and min(max(abs(np.array(w) - t)) for w in bank for t in ([-0.8, 0.1],)) < 0.35
    one = adaptive.filter_bank(spark.createDataFrame(rows, "series int, i int, x double"), S, "x", k=1)[0]
    total = lambda df: df.selectExpr("sum(error)").first()[0]
    assert total(out) < 0.9 * total(one)


def test_synthetic_series(spark):
    def frame(df) -> pd.DataFrame:
        return df.toPandas().sort_values(["series", "i"], ignore_index=True)

    walks = frame(synthetic.walks(spark, 5, 400))
    assert len(walks) == 2000 and walks.equals(frame(synthetic.walks(spark, 5, 400).repartition(3)))
    steps = walks.groupby("series")["x"].diff().dropna()
    assert abs(steps.mean()) < 0.1 and abs(steps.std() - 1) < 0.1
    bits = frame(synthetic.uniform_bits(spark, 4, 160))
    assert bits["x"].between(0, 255).all() and set(bits["bits"]) <= set(range(9))
    z = np.where(bits["delta"] < 0, -2 * bits["delta"] - 1, 2 * bits["delta"])
    assert (z < 2.0 ** bits["bits"]).all() and (z.max() > 64)
    shapes = frame(synthetic.shapes(spark, 9))
    assert set(shapes["label"]) == {0, 1, 2} and shapes["x"].abs().max() < 16
    sines = frame(synthetic.sines(spark, 3, 128, noise=0.0))
    assert sines["x"].abs().max() <= 1
    motif = spark.createDataFrame([(0, 100.0), (1, -100.0)], "at long, x double")
    laid = frame(synthetic.with_motifs(synthetic.sines(spark, 2, 64), 16, motif))
    assert len(laid) == 128 and (laid.loc[laid["i"] % 16 == 0, "x"] == 100).all() and (laid["x"] == -100).sum() == 8
