"""Streaming versions: predictors, block assembly, runs and sliding means with state by series, and event-time windows.

A series has to come in order across micro-batches. A row that is older than one already seen cannot
be predicted: it comes out with `late` set and no residual, and does not touch the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import predictors as P


def _stateful(stream: DataFrame, key: str, order: str, x: str, start: tuple, step, columns: str) -> DataFrame:
    """key, order and `columns` by step(state, values) -> (rows of values, next state) for each series and micro-batch, rows in order. The state is start's ints and the last order."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    if kinds[order] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{order} has to be a whole number")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, last = state.get if state.exists else (*start, None)
        pdf = pd.concat(list(batches)).sort_values(order, ignore_index=True)
        late = pdf[order] <= last if last is not None else pdf[order] != pdf[order]
        rows, new = step(tuple(int(v) for v in own), [int(v) for v in pdf[x][~late]])
        out = pd.DataFrame(rows, columns=names[:-1], index=pdf.index[~late], dtype="object").reindex(pdf.index)
        if not late.all():
            state.update((*new, int(pdf[order][~late].max())))
        yield pd.concat([pdf[[key, order]], out, late.rename("late")], axis=1)

    kept = ", ".join([*(f"s{i} long" for i in range(len(start))), "last long"])
    return stream.select(key, order, x).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {columns}", kept, "append", GroupStateTimeout.NoTimeout)


def stream_residuals(stream: DataFrame, key: str, order: str, x: str, predictor: P.Predictor, bits: int | None = None) -> DataFrame:
    """key, order, residual, late: residuals of any predictor, across micro-batches."""

    def step(state, values):
        r, state = P.encode(predictor, values, state, bits)
        return [(int(v),) for v in r], state

    return _stateful(stream, key, order, x, predictor.start(), step, "residual long, late boolean")


def stream_delta(stream: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """key, order, residual: each value less the one before in its series; late rows are left out."""
    return stream_residuals(stream, key, order, x, P.Difference(1)).where("NOT late").drop("late")


def stream_means(stream: DataFrame, key: str, order: str, x: str, n: int = 8) -> DataFrame:
    """key, order, mean (rounded down, of the last n values; null before there are n), late."""

    def step(state, values):
        count, seen = state[0], list(state[1:])
        rows = []
        for v in values:
            seen, count = [*seen[1:], v], min(n, count + 1)
            rows.append((sum(seen) // n if count == n else None,))
        return rows, (count, *seen)

    return _stateful(stream, key, order, x, (0,) * (n + 1), step, "mean long, late boolean")


def stream_blocks(stream: DataFrame, key: str, order: str, x: str, size: int = 8) -> DataFrame:
    """key, order (of its last value), block (the values), zero_blocks (how many blocks of zeros in a row end here) of each block as it fills up. Less than a block stays in the state."""

    def step(state, values):
        zeros, held, seen = state[0], state[1], list(state[2 : 2 + state[1]])
        rows = []
        for v in values:
            seen.append(v)
            full = len(seen) == size
            zeros = (zeros + 1 if not any(seen) else 0) if full else zeros
            rows.append((list(seen) if full else None, zeros if full else None))
            seen = [] if full else seen
        return rows, (zeros, len(seen), *seen, *[0] * (size - len(seen)))

    out = _stateful(stream, key, order, x, (0,) * (size + 2), step, "block array<long>, zero_blocks long, late boolean")
    return out.where("block IS NOT NULL").drop("late")


def windowed(stream: DataFrame, time: str, x: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or, with slide, sliding) event-time sums: start, n, total. Rows later than `late` are dropped by the watermark."""
    t = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return t.groupBy(F.window("__t", length, slide)).agg(F.count("*").alias("n"), F.sum(x).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions by key that a gap ends: key, start, n."""
    t = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return t.groupBy(key, F.session_window("__t", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
