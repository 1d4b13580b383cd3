from itertools import combinations

import numpy as np
import pytest

from tidemark.operators import codecs, learned
from tidemark.operators.series import Series


@pytest.mark.parametrize("seed", range(30))
def test_dynamic_programs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 11)), int(rng.integers(1, 4))
    x = rng.integers(-9, 10, n).astype(float)
    got = learned.best_placement(x, m)
    best = max((sum(x[list(c)]) for r in range(n + 1) for c in combinations(range(n), r) if all(b - a >= m for a, b in zip(c, c[1:]))), default=0)
    assert x[got].sum() == best and (np.diff(got) >= m).all()

    def loss(anchors):
        return sum(((x[a : b + 1] - np.linspace(x[a], x[b], b - a + 1)) ** 2).sum() + 5 for a, b in zip(anchors, anchors[1:]))

    anchors, total = learned.piecewise_linear(x, 5.0)
    inner = range(1, n - 1)
    least = min((loss((0, *c, n - 1)) for r in range(n) for c in combinations(inner, r)), default=0) if n > 1 else 0
    assert total == pytest.approx(least, abs=1e-6) and (n < 2 or loss(anchors.tolist()) == pytest.approx(least, abs=1e-6))


def test_known_placements():
    assert learned.best_placement(np.array([2, 1, 3, 4]), 2).tolist() == [0, 3]
    assert learned.best_placement(np.array([1, 2, 3, 2, 5, 1]), 2).tolist() == [0, 2, 4]
    assert learned.best_placement(np.array([-1, 2, 3, 2, 5, 1]), 2).tolist() == [2, 4]
    assert learned.best_placement(np.array([-1, -2]), 2).tolist() == [] == learned.best_placement(np.array([]), 2).tolist()
    assert learned.greedy_apart([0, 1, 2, 3, 9], 3).tolist() == [0, 3, 9]


@pytest.mark.parametrize("n", (0, 1, 7, 8, 9, 300))
def test_kernels_come_back(n):
    x = np.random.default_rng(n).integers(0, 65536, n)
    residuals, used = learned.context_predict(x)
    assert (learned.context_predict(residuals, decode=used)[0] == x).all()
    assert (learned.adaptive_ranks(learned.adaptive_ranks(x % 256), decode=True) == x % 256).all()
    assert (abs(learned.linearise(x, 0.1)[0] - x) <= 0.1 * 65536).all()


def test_codecs_come_back(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, int(rng.integers(-99, 99)), int(rng.integers(0, 9)), float(rng.integers(0, 999)) / 4) for k in range(3) for i in range(20)]
    d, s = spark.createDataFrame(rows, "k int, i int, a int, b int, f double"), Series(("k",), ("i",))
    chain = [codecs.Quantise(["f"]), codecs.ColumnSum("a", {"b": 3}), codecs.DoubleDelta(["a"]), codecs.Delta(["b"]), codecs.Zigzag(["a", "b"]), codecs.Lambda(lambda c: c + 1, lambda c: c - 1, ["b"])]
    coded, headers = codecs.encode(d, s, chain)
    back = codecs.decode(coded, s, chain, headers).select(d.columns)
    assert back.schema == d.schema or back.dtypes == d.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert codecs.select_columns(d, None, ("anyint",)) == ["a", "b", "i", "k"] and codecs.select_columns(d, None, (), ("anyint",)) == ["f"]
