"""Filters, block codes, context predictors, dynamic programs and clustering over series.

What one window reaches is a column expression. Dynamic programs and adaptive tables have an
order that no window holds: they are numpy kernels, one series in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bits
from tidemark.operators.series import Series, delta, with_blocks

# ---- column expressions ----------------------------------------------------------------


def bilateral(df: DataFrame, s: Series, x: str, share: float = 0.1) -> DataFrame:
    """Column smooth: a three-tap mean (weights 1/4, 1/2, 1/4) whose outer taps fade as the neighbour differs by up to `share` of the series' range."""
    gap = (F.max(x).over(s.whole) - F.min(x).over(s.whole)) * share + 1e-10
    rows = df.withColumns({"__a": F.lag(x).over(s.window), "__b": F.lead(x).over(s.window), "__gap": gap})
    tap = lambda c: F.coalesce(0.25 * (1 - F.least(F.abs(F.col(x) - F.col(c)) / F.col("__gap"), F.lit(1.0))), F.lit(0.0))
    near = lambda c: tap(c) * F.coalesce(F.col(c), F.lit(0))
    return rows.withColumn("smooth", (0.5 * F.col(x) + near("__a") + near("__b")) / (0.5 + tap("__a") + tap("__b"))).drop("__a", "__b", "__gap")


def clamp_change(s: Series, x: str, changed: str, share: float = 0.005) -> Column:
    """`changed`, moved back to within `share` of the series' range of x."""
    most = (F.max(x).over(s.whole) - F.min(x).over(s.whole) + 1e-10) * share
    return F.col(x) + F.greatest(-most, F.least(most, F.col(changed) - F.col(x)))


#: Hashes of a block's array of 16-bit values.
BLOCK_HASHES: dict[str, Callable[[Column], Column]] = {
    "below_mean": lambda v: F.aggregate(F.transform(v, lambda e, i: F.when(e * F.size(v) < F.aggregate(v, F.lit(0).cast("bigint"), lambda a, b: a + b), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, b: a + b),
    "leading": lambda v: F.shiftright(F.element_at(v, -1), 8),
    "bits_shape": lambda v: F.shiftright(F.element_at(v, -1), 13) + F.when(F.element_at(v, 1) <= F.element_at(v, -1), 8).otherwise(0),
    "first_last": lambda v: F.shiftright(F.element_at(v, -1), 10).bitwiseAND(F.lit(~7)) + F.shiftright(F.element_at(v, 1), 13),
    "difference": lambda v: F.shiftright(F.element_at(v, -1) - F.element_at(v, 1), 8),
    "difference_place": lambda v: F.shiftright(F.element_at(v, -1) - F.element_at(v, 1), 10) + F.shiftright(F.element_at(v, -1), 14) * 64,
}


def block_arrays(df: DataFrame, s: Series, x: str, size: int = 8) -> DataFrame:
    """keys, block, values (in order) of each full block."""
    rows = with_blocks(df, s, size).groupBy(*s.keys, "block").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(x).alias("v")))).alias("a"))
    return rows.where(F.size("a") == size).select(*s.keys, "block", F.transform("a", lambda e: e.v).alias("values"))


def code_costs(df: DataFrame, s: Series, x: str, most: int = 15) -> DataFrame:
    """keys, block, uniform (8 values at the widest's bits), rice (bits under the best Rice parameter), parameter of the zigzagged deltas of each block."""
    rows = with_blocks(df.withColumn("z", bits.zigzag(delta(s, x))), s)
    costs = rows.groupBy(*s.keys, "block").agg((F.count("*") * F.max(bits.bit_length(F.col("z")))).cast("bigint").alias("uniform"), *[F.sum(F.shiftright("z", k) + 1 + k).alias(f"r{k}") for k in range(most + 1)])
    least = F.array_min(F.array(*[F.struct(F.col(f"r{k}").alias("cost"), F.lit(k).alias("k")) for k in range(most + 1)]))
    return costs.select(*s.keys, "block", "uniform", least.cost.alias("rice"), least.k.alias("parameter"))


def one_tap(df: DataFrame, s: Series, x: str) -> DataFrame:
    """keys, sxy, sxx, coefficient (in 256ths, rounded down) of the least-squares prediction of a delta from the last one."""
    rows = df.withColumn("y", delta(s, x)).withColumn("x1", F.coalesce(F.lag("y").over(s.window), F.lit(0)))
    sums = rows.groupBy(*s.keys).agg(F.sum(F.col("x1") * F.col("y")).alias("sxy"), F.sum(F.col("x1") * F.col("x1")).alias("sxx"))
    return sums.withColumn("coefficient", F.when(F.col("sxx") > 0, F.floor(F.col("sxy") * 256 / F.col("sxx"))).otherwise(F.lit(256)).cast("bigint"))


def learn_filter(df: DataFrame, s: Series, x: str, taps: int = 3) -> list[float]:
    """Least-squares weights of the last `taps` values of all series together: one aggregation for the normal equations."""
    lags = df.select(F.col(x).cast("double").alias("y"), *[F.coalesce(F.lag(x, k + 1).over(s.window), F.lit(0)).cast("double").alias(f"x{k}") for k in range(taps)])
    row = lags.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i in range(taps) for j in range(taps)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(taps)]).first()
    m = np.array([[row[f"m{i}_{j}"] or 0.0 for j in range(taps)] for i in range(taps)])
    return np.linalg.lstsq(m, np.array([row[f"b{i}"] or 0.0 for i in range(taps)]), rcond=None)[0].tolist()


def kmeans(rows: DataFrame, k: int, seed: int = 123, steps: int = 20) -> DataFrame:
    """id, cluster, residual (vector less its centre) of rows (id, vec), by distributed Lloyd steps."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rows.select("id", F.col("vec").cast("array<double>").alias("vec")).withColumn("features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, maxIter=steps).fit(points)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    return model.transform(points).select("id", F.col("prediction").alias("cluster"), F.zip_with("vec", F.get(centres, F.col("prediction")), lambda a, b: a - b).alias("residual"))


# ---- kernels: one series, in order -----------------------------------------------------


def best_placement(scores: np.ndarray, length: int) -> np.ndarray:
    """Indexes at least `length` apart with the greatest sum of positive scores; none if no score is positive."""
    n = len(scores)
    best, took = np.zeros(n + 1), np.zeros(n, bool)
    for i, v in enumerate(np.asarray(scores, float).tolist()):
        with_it = v + best[max(0, i + 1 - length)]
        took[i] = v > 0 and with_it > best[i]
        best[i + 1] = with_it if took[i] else best[i]
    out, i = [], n - 1
    while i >= 0:
        if took[i]:
            out.append(i)
            i -= length
        else:
            i -= 1
    return np.array(out[::-1], np.int64)


def piecewise_linear(x: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Anchors (first and last included) of the chain of straight lines with the least squared error plus `penalty` a line, and that loss. Quadratic in time, linear in memory, by running sums."""
    x = np.asarray(x, float)
    n, k = len(x), np.arange(len(x))
    if n < 2:
        return k, 0.0
    x = x - x.mean()
    s1, s2, sk = (np.concatenate(([0.0], np.cumsum(v))) for v in (x, x * x, k * x))
    loss, parent = np.zeros(n), np.full(n, -1)
    for j in range(1, n):
        i = k[:j]
        m = (j - i).astype(float)
        slope = (x[j] - x[i]) / m
        a = s1[j] - s1[i + 1]  # sums over what lies between i and j
        at = sk[j] - sk[i + 1] - i * a
        ones, steps, squares = m - 1, m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
        error = s2[j] - s2[i + 1] - 2 * (x[i] * a + slope * at) + x[i] ** 2 * ones + 2 * x[i] * slope * steps + slope**2 * squares
        total = loss[:j] + np.maximum(error, 0) + penalty
        parent[j] = int(total.argmin())
        loss[j] = total[parent[j]]
    out, i = [], n - 1
    while i >= 0:
        out.append(i)
        i = int(parent[i])
    return np.array(out[::-1], np.int64), float(loss[-1])


def greedy_apart(starts: np.ndarray, length: int) -> np.ndarray:
    """Of sorted match starts the leftmost ones that do not overlap."""
    out, free = [], None
    for v in np.asarray(starts).tolist():
        if free is None or v >= free:
            out.append(v)
            free = v + length
    return np.array(out, np.int64)


def linearise(x: np.ndarray, share: float = 0.002, block: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Values moved by at most `share` of the range so that deltas or double deltas get small, and which of them (1, 2) each block took."""
    x = np.asarray(x, float)
    most = share * float(np.ptp(x)) if len(x) else 0.0
    out, order = np.empty_like(x), np.empty(-(-len(x) // block), np.int64)
    prev, slope = 0.0, 0.0
    for b, at in enumerate(range(0, len(x), block)):
        tries = []
        for d in (1, 2):
            p, s, cost, own = prev, slope, 0.0, []
            for v in x[at : at + block].tolist():
                guess = p + (s if d == 2 else 0.0)
                now = min(max(guess, v - most), v + most)
                cost += abs(now - guess)
                p, s = now, now - p
                own.append(now)
            tries.append((cost, d, own, p, s))
        _, order[b], own, prev, slope = min(tries, key=lambda t: t[:2])
        out[at : at + block] = own
    return out, order


def context_predict(x: np.ndarray, shift: int = 2, block: int = 8, decode: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of deltas from a table of running means by context (the leading bits of the last value and of the last change over a block), and whether the table was used. With decode (those flags), x are residuals and the values come back."""
    x = np.asarray(x, np.int64)
    out, used = np.empty(len(x), np.int64), np.zeros(len(x), bool)
    table: dict[int, int] = {}
    values = out if decode is not None else x
    for i in range(len(x)):
        if i < block:
            out[i] = x[i]
            continue
        last, first = int(values[i - 1]), int(values[i - block])
        key = ((last - first) >> 10) % 64 + 64 * ((last >> 14) % 4)
        guess = table.get(key, 0) >> shift
        if decode is not None:
            used[i] = decode[i]
            err = int(x[i])
            change = err + guess if used[i] else err
            out[i] = last + change
        else:
            change = int(x[i]) - last
            err = change - guess
            used[i] = abs(err) <= abs(change)
            out[i] = err if used[i] else change
        table[key] = table.get(key, 0) + change - guess
    return out, used


def adaptive_ranks(x: np.ndarray, decode: bool = False) -> np.ndarray:
    """Each symbol (a number from 0, of any size) as its rank by how often it came before (of equal ones the lesser symbol first), or the symbols from ranks."""
    x, out = np.asarray(x, np.int64), np.empty(len(x), np.int64)
    if len(x) and x.min() < 0:
        raise ValueError("symbols and ranks are numbers from 0")
    symbols, times, n = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0  # the n symbols so far, ascending; all others have come 0 times
    for i, v in enumerate(x.tolist()):
        seen, counts = symbols[:n], times[:n]
        if not decode:
            symbol = v
        elif v < n:
            symbol = seen.item(np.lexsort((seen, -counts))[v])
        else:
            symbol = v - n + int((seen - np.arange(n)).searchsorted(v - n, "right"))
        at = int(seen.searchsorted(symbol))
        known = at < n and seen.item(at) == symbol
        if decode:
            out[i] = symbol
        else:
            out[i] = np.count_nonzero(counts > counts[at]) + np.count_nonzero(counts[:at] == counts[at]) if known else n + symbol - at
        if known:
            counts[at] += 1
        else:
            symbols[at + 1 : n + 1], times[at + 1 : n + 1] = symbols[at:n].copy(), times[at:n].copy()
            symbols[at], times[at], n = symbol, 1, n + 1
    return out


def zstd_size(x: np.ndarray, level: int = 3) -> int:
    """Compressed bytes of 16-bit residuals."""
    import zstandard

    return len(zstandard.ZstdCompressor(level=level).compress(np.asarray(x).astype("<i2").tobytes()))


def over_series(df: DataFrame, s: Series, columns: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each series in order; f gives the columns of `schema`, the keys are put before them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(list(s.order), ignore_index=True))
        for i, k in enumerate(s.keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in s.keys)
    return df.select(*dict.fromkeys((*s.keys, *s.order, *columns))).groupBy(*s.keys).applyInPandas(run, f"{keys}, {schema}")
