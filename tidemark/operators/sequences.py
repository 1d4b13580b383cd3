"""Sequence functions: gathering, padding, splitting, index ranges, block transforms, signed ranks. Column expressions and windows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.series import Series

#: Named tests of a number. NaN is the greatest number, as in Spark's ordering.
PREDICATES = {
    "true": lambda x: x != 0, "false": lambda x: x == 0, "nan": lambda x: F.isnan(x), "finite": lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")), "inf": lambda x: F.abs(x) == float("inf"),
    "negative": lambda x: x < 0, "nonnegative": lambda x: x >= 0, "positive": lambda x: x > 0, "nonpositive": lambda x: x <= 0,
}


def series_array(df: DataFrame, s: Series, x: str) -> DataFrame:
    """keys, values: each series as one array, in order. For series that fit a row."""
    return df.groupBy(*s.keys).agg(F.array_sort(F.collect_list(F.struct(*s.order, F.col(x).alias("__x")))).alias("a")).select(*s.keys, F.transform("a", lambda e: e["__x"]).alias("values"))


def gather(values: Column, places: Sequence[int]) -> Column:
    """The elements at places (from 0); null where there is none."""
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(values, i))


def fold(values: Column, init: Column, f) -> Column:
    return F.aggregate(values, init, f)


def pad(values: Column, n: int, how: str = "zero", constant: int = 0) -> Column:
    """n elements more at both ends: zeros, a constant, the other end's elements (wrap), or the end's own (edge)."""
    size = F.size(values)
    if how == "wrap":
        before, after = F.slice(values, size - n + 1, n), F.slice(values, 1, n)
    elif how == "edge":
        before, after = (F.array_repeat(F.element_at(values, i), n) for i in (1, -1))
    elif how in ("zero", "constant"):
        before = after = F.array_repeat(F.lit(constant if how == "constant" else 0).cast("bigint"), n)
    else:
        raise ValueError(how)
    return F.concat(before, values, after)


def deinterleave(values: Column, d: int) -> list[Column]:
    """d arrays of every d-th element."""
    return [_every(values, d, k) for k in range(d)]


def _every(values: Column, d: int, k: int) -> Column:
    return F.filter(values, lambda x, i: i % d == k)


def transposed(values: Column, d: int) -> Column:
    """Rows of d elements as d columns, one after another."""
    return F.concat(*[_every(values, d, k) for k in range(d)])


def inside_intervals(df: DataFrame, s: Series, intervals: DataFrame) -> DataFrame:
    """Rows whose index lies in one of the intervals (keys, start_idx, end_idx) of their series, which do not overlap. One window over both, no range join."""
    rows = df.withColumn("__i", s.index()).withColumn("__end", F.lit(None).cast("long")).withColumn("__row", F.lit(1))
    starts = intervals.select(*s.keys, F.col("start_idx").cast("int").alias("__i"), F.col("end_idx").cast("long").alias("__end"), F.lit(0).alias("__row"))
    w = W.partitionBy(*s.keys).orderBy("__i", "__row").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("__reach", F.last("__end", ignorenulls=True).over(w))
    return both.where((F.col("__row") == 1) & (F.col("__i") < F.col("__reach"))).drop("__i", "__end", "__row", "__reach")


def interval_index_range(intervals: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """keys, first, last (exclusive) of the places, in order of start, of the intervals inside [low, high); -1, -1 where there is none."""
    placed = intervals.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("start_idx")) - 1)
    own = F.when((F.col("start_idx") >= low) & (F.col("end_idx") <= high), F.col("place"))
    return placed.groupBy(*keys).agg(F.coalesce(F.min(own), F.lit(-1)).alias("first"), F.coalesce(F.max(own) + 1, F.lit(-1)).alias("last"))


def ranges_between(df: DataFrame, s: Series, match: Column) -> DataFrame:
    """keys, start_idx, end_idx of what lies between matches: runs of rows without one."""
    rows = df.withColumn("i", s.index()).withColumn("__m", match.cast("int"))
    rows = rows.withColumn("__run", F.sum("__m").over(s.running)).where("__m = 0")
    return rows.groupBy(*s.keys, "__run").agg(F.min("i").alias("start_idx"), (F.max("i") + 1).alias("end_idx")).drop("__run")


def level_out(block: Column, size: int = 8) -> Column:
    """A block sorted from greatest to least, then each value levelled with those behind it: what a value stands over the next is spread over the rest."""
    v = [F.element_at(F.sort_array(block, asc=False), i + 1).cast("double") for i in range(size)]
    raised, out = F.lit(0.0), []
    for i in range(size - 1):
        # A value and the next were raised alike before, so only their difference counts.
        raised = raised + (v[i] - v[i + 1]) / (size - i)
        out.append(v[i + 1] + raised)
    return F.array(*out, out[-1])


def pair_pattern(block: Column) -> Column:
    """0 to 31 for a block of eight: the rank order of its four sums of pairs (0 to 23, orders counted as permutations in order), or, where the first in that order is over twice the second, 24 and its place, or, where the last is under twice the one before, 28 and its place."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(block, 2 * i) + F.get(block, 2 * i + 1))
    s = lambda i: F.get(sums, i)
    above = lambda a, b: s(F.lit(a)) > s(F.lit(b))
    pairs = list(itertools.combinations(range(4), 2))
    code = sum((F.when(above(a, b), 1 << (5 - k)).otherwise(0) for k, (a, b) in enumerate(pairs)), F.lit(0))
    orders = {sum((p[a] > p[b]) << (5 - k) for k, (a, b) in enumerate(pairs)): (i, p) for i, p in enumerate(itertools.permutations(range(4)))}
    table = F.array(*[F.array(*[F.lit(v) for v in (orders[c][0], *orders[c][1])]) if c in orders else F.lit(None).cast("array<int>") for c in range(64)])
    row = F.get(table, code)
    p = lambda k: F.get(row, F.lit(k + 1))
    return F.when(s(p(0)) > 2 * s(p(1)), 24 + p(0)).when(s(p(3)) < 2 * s(p(2)), 28 + p(3)).otherwise(F.get(row, F.lit(0)))


def inflected(s: Series, x: str) -> Column:
    """Each value less or plus the one before it, whichever is smaller in size; the first stays."""
    before = F.coalesce(F.lag(x).over(s.window), F.lit(0))
    return F.when(F.abs(F.col(x) - before) <= F.abs(F.col(x) + before), F.col(x) - before).otherwise(F.col(x) + before)


def lifted(a: Column, b: Column) -> tuple[Column, Column]:
    """Two lifting steps of a pair: b less half of a, then a less half of that."""
    b = b - F.shiftright(a, 1)
    return a - F.shiftright(b, 1), b


def lowered(a: Column, b: Column) -> tuple[Column, Column]:
    """The inverse of `lifted`."""
    a = a + F.shiftright(b, 1)
    return a, b + F.shiftright(a, 1)


def signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, w_plus, w_minus of a paired signed-rank test: ranks of the sizes of differences (equal ones share their mean rank), pairs without a difference left out. Ranks come from counts of equal differences, so that only one row for each meets in one task."""
    diff = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    sizes = diff.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("above"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    return ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("above")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("above"))).alias("w_minus"))


def best_of_grid(df: DataFrame, s: Series, x: str, grid: Sequence[Sequence[float]], size: int = 8) -> DataFrame:
    """filter (place in grid), loss: the sum of absolute errors of each filter (weights of the values before), all in one aggregation."""
    taps = max(map(len, grid))
    rows = df.select(F.col(x).alias("v0"), *[F.coalesce(F.lag(x, k + 1).over(s.window), F.lit(0)).alias(f"v{k + 1}") for k in range(taps)])
    sums = rows.agg(*[F.sum(F.abs(F.col("v0") - sum((F.col(f"v{k + 1}") * c for k, c in enumerate(w)), F.lit(0)))).alias(f"f{j}") for j, w in enumerate(grid)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(j).alias("filter"), F.col(f"f{j}").alias("loss")) for j in range(len(grid))])))


def dynamic_delta(x: np.ndarray, block: int = 8, modes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Residuals, each block by delta or double delta (1, 2), whichever has the smaller greatest residual, and the modes. With modes, x are residuals and the values come back."""
    x = np.asarray(x, np.int64)
    p = np.concatenate(([0, 0], x))
    one, two = x - p[1:-1], x - 2 * p[1:-1] + p[:-2]
    if modes is None:
        at = np.arange(0, len(x), block)
        modes = 1 + (np.maximum.reduceat(np.abs(two), at) < np.maximum.reduceat(np.abs(one), at)).astype(np.int64)
        return np.where(np.repeat(modes, block)[: len(x)] == 1, one, two), modes
    out, a, b = np.empty_like(x), 0, 0
    for i, r in enumerate(x.tolist()):
        a, b = b, r + (b if modes[i // block] == 1 else 2 * b - a)
        out[i] = b
    return out, modes


def dynamic_frame(series: pd.DataFrame, x: str = "q", block: int = 8) -> pd.DataFrame:
    """event_id, mode, residual, back (decoded again) of a series."""
    r, modes = dynamic_delta(series[x].to_numpy(), block)
    return pd.DataFrame({"event_id": series["event_id"], "mode": modes.repeat(block)[: len(r)], "residual": r, "back": dynamic_delta(r, block, modes)[0]})


def orthonormal(d: int, seed: int = 123) -> np.ndarray:
    """A random rotation: orthonormal rows."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def rotated(vec: Column, matrix: np.ndarray) -> Column:
    """A vector column times a small matrix of literals."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, vec.cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def _mapped(f):
    def run(v: pd.Series) -> pd.Series:
        return v.map(f, na_action="ignore")

    return run


def _by_element(f) -> Callable[[str | Column], Column]:
    """A column function of a number's function, in Arrow batches; nulls stay. (Made on use: a worker has no session.)"""
    return lambda x: F.pandas_udf(_mapped(f), "double")(x)


log_gamma, gamma, erf, erfc = (_by_element(f) for f in (math.lgamma, math.gamma, math.erf, math.erfc))
