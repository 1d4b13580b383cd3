"""Predictors that learn as they go: earlier windows, online regression, online codebooks, filter banks.

Kernels on one series use whole numbers only, so that decoding repeats them exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.learned import block_arrays
from tidemark.operators.series import Series, with_blocks


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + F.abs(v))


def nearest_earlier(df: DataFrame, s: Series, x: str, reach: int = 16, size: int = 8) -> DataFrame:
    """keys, block, back, residual of each full block.

    residual is the block less the nearest (least sum of absolute differences; of equal ones the latest) of
    the last `reach` blocks, `back` blocks before; back is 0 and the block stays as it is where none is nearer than zero.
    """
    blocks = block_arrays(df, s, x, size)
    earlier = F.collect_list(F.struct("block", "values")).over(W.partitionBy(*s.keys).orderBy("block").rowsBetween(-reach, -1))
    less = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    choice = lambda e: F.struct(_total(less(F.col("values"), e.values)).alias("cost"), (F.col("block") - e.block).alias("back"), less(F.col("values"), e.values).alias("residual"))
    raw = F.struct(_total(F.col("values")).alias("cost"), F.lit(0).cast("bigint").alias("back"), F.col("values").alias("residual"))
    tried = blocks.withColumn("earlier", earlier)
    return tried.select(*s.keys, "block", F.array_min(F.concat(F.array(raw), F.transform("earlier", choice))).alias("best")).select(*s.keys, "block", "best.back", "best.residual")


def online_regress(x: np.ndarray, how: str = "sums", shift: int = 8, block: int = 8, decode: bool = False) -> np.ndarray:
    """Residuals of deltas after a one-tap prediction from the last delta; with decode the values from residuals.

    The coefficient (in 2**-shift) changes after each block: "sums" takes the least-squares one of all blocks so far,
    halved whenever the sums pass 2**40; "gradient" moves one step in the direction of the block's signed errors.
    """
    if how not in ("sums", "gradient"):
        raise ValueError(how)
    out, prev, last, c = np.empty(len(x), np.int64), 0, 0, 0
    sxy, sxx, push = 0, 0, 0
    for i, v in enumerate(np.asarray(x, np.int64).tolist()):
        guess = (c * last) >> shift
        change = v + guess if decode else v - prev
        out[i] = prev + change if decode else change - guess
        sxy, sxx = sxy + last * change, sxx + last * last
        err = change - guess
        push += (err > 0) * (last > 0) + (err < 0) * (last < 0) - (err > 0) * (last < 0) - (err < 0) * (last > 0)
        prev, last = prev + change, change
        if i % block == block - 1:
            if how == "sums":
                while sxx > 1 << 40:
                    sxy, sxx = sxy >> 1, sxx >> 1
                c = (sxy << shift) // sxx if sxx else 0
            else:
                c += (push > 0) - (push < 0)
            push = 0
    return out


def online_codebook(x: np.ndarray, k: int = 8, size: int = 8, picks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks less the nearest of k running means of the blocks that picked it, and the picks; with `picks`, x are residuals and the values come back.

    Mean j begins as block j. What is left after the last full block stays as it is.
    """
    x = np.asarray(x, np.int64)
    n = len(x) // size
    out, own = x.copy(), np.empty(n, np.int64)
    sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
    for b in range(n):
        v = x[b * size : (b + 1) * size]
        centres = sums // np.maximum(counts, 1)[:, None]
        if b < k:
            j = b
        else:
            j = int(picks[b]) if picks is not None else int(np.abs(centres - v).sum(1).argmin())
        values = v + centres[j] if picks is not None else v
        out[b * size : (b + 1) * size] = values if picks is not None else v - centres[j]
        own[b] = j
        sums[j] += values
        counts[j] += 1
    return out, own


def _moments(df: DataFrame, s: Series, x: str, taps: int, size: int) -> DataFrame:
    """keys, block and the sums of products of the value (p0) and the `taps` before it (p1, ...): all that a block's error under any filter needs."""
    v = lambda i: F.col(f"p{i}")
    rows = with_blocks(df, s, size).withColumns({f"p{i}": F.coalesce(F.lag(x, i).over(s.window), F.lit(0)).cast("double") if i else F.col(x).cast("double") for i in range(taps + 1)})
    return rows.groupBy(*s.keys, "block").agg(*[F.sum(v(i) * v(j)).alias(f"m{i}_{j}") for i in range(taps + 1) for j in range(i, taps + 1)])


def _error(w: list[float]) -> Column:
    full = [1.0, *[-c for c in w]]
    terms = [F.col(f"m{i}_{j}") * (full[i] * full[j] * (1 if i == j else 2)) for i in range(len(full)) for j in range(i, len(full))]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def filter_bank(df: DataFrame, s: Series, x: str, k: int = 4, taps: int = 2, steps: int = 8, size: int = 8) -> tuple[DataFrame, list[list[float]]]:
    """keys, block, filter, error of each block under the best of k filters, and the filters.

    Each step gives every block its best filter, and every filter the least-squares weights of its blocks: one
    aggregation with a row for each filter. A filter without blocks stays as it is. The first filters are 0, the last value,
    straight lines, and damped last values.
    """
    start = [[0.0] * taps, [1.0] + [0.0] * (taps - 1), [2.0, -1.0] + [0.0] * (taps - 2) if taps > 1 else [0.5], *[[1 / (j + 2)] + [0.0] * (taps - 1) for j in range(k)]]
    bank = start[:k]
    table = _moments(df, s, x, taps, size).persist(StorageLevel.MEMORY_AND_DISK)
    best = lambda: F.array_min(F.array(*[F.struct(_error(w).alias("error"), F.lit(j).alias("filter")) for j, w in enumerate(bank)]))
    names = [c for c in table.columns if c.startswith("m")]
    before = None
    for _ in range(steps):
        rows = table.withColumn("best", best()).groupBy("best.filter").agg(F.sum("best.error").alias("error"), *[F.sum(c).alias(c) for c in names]).collect()
        now = sum(r.error for r in rows)
        if before is not None and now >= before * (1 - 1e-6):
            break
        before = now
        for r in rows:
            m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(taps + 1)] for i in range(taps + 1)])
            bank[r["filter"]] = np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0].tolist()
    out = table.withColumn("best", best()).select(*s.keys, "block", "best.filter", "best.error")
    table.unpersist()
    return out, bank
