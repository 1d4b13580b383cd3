"""Column codecs and window operators over ordered series.

A series is the rows of equal `keys`, in the order `order`, which must be total. Each
operator adds columns by window expressions, with one shuffle by key; the operators share it
if they follow one another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import bits

BLOCK = 8


@dataclass(frozen=True)
class Series:
    """How a table is cut into series and ordered."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def running(self) -> WindowSpec:
        return self.window.rowsBetween(W.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return W.partitionBy(*self.keys)

    def index(self) -> Column:
        """Place in the series, from 0."""
        return F.row_number().over(self.window) - 1


# ---- predictors ------------------------------------------------------------------------


def lagged(s: Series, x: str, n: int = 1) -> Column:
    """The value n places before, 0 before the beginning."""
    return F.coalesce(F.lag(x, n).over(s.window), F.lit(0))


def delta(s: Series, x: str) -> Column:
    return F.col(x) - lagged(s, x)


def double_delta(s: Series, x: str) -> Column:
    return F.col(x) - 2 * lagged(s, x) + lagged(s, x, 2)


def triple_delta(s: Series, x: str) -> Column:
    return F.col(x) - 3 * lagged(s, x) + 3 * lagged(s, x, 2) - lagged(s, x, 3)


def fir(s: Series, x: str, weights: Sequence[float]) -> Column:
    """Residual of a linear prediction from the last len(weights) values."""
    return F.col(x) - sum((lagged(s, x, k + 1) * w for k, w in enumerate(weights)), F.lit(0))


def undo_delta(s: Series, d: str) -> Column:
    return F.sum(d).over(s.running)


# ---- blocks ----------------------------------------------------------------------------


def with_blocks(df: DataFrame, s: Series, size: int = BLOCK) -> DataFrame:
    """Columns block and pos."""
    i = s.index()
    return df.withColumn("i", i).withColumn("block", F.floor(F.col("i") / size).cast("bigint")).withColumn("pos", (F.col("i") % size).cast("int"))


def block_table(df: DataFrame, s: Series, x: str, width: int = 16, size: int = BLOCK) -> DataFrame:
    """One row for each block: rows, first value, least, greatest, sum, bits of the widest zigzagged delta, and its stored width."""
    rows = with_blocks(df.withColumn("residual", bits.zigzag(delta(s, x))), s, size)
    table = rows.groupBy(*s.keys, "block").agg(
        F.count("*").alias("n_rows"), F.min_by(x, "pos").alias("first_value"), F.min(x).alias("min_value"), F.max(x).alias("max_value"),
        F.sum(x).alias("sum_value"), F.max(bits.bit_length(F.col("residual"))).alias("bits"),
    )
    return table.withColumn("stored_bits", bits.escaped_width(F.col("bits"), width))


def zero_runs(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of blocks whose residuals are all zero: keys, start_block, n_blocks."""
    w = W.partitionBy(*keys).orderBy("block")
    flat = blocks.where("bits = 0").withColumn("island", F.col("block") - F.row_number().over(w))
    return flat.groupBy(*keys, "island").agg(F.min("block").alias("start_block"), F.count("*").alias("n_blocks")).drop("island")


def packed_size(blocks: DataFrame, keys: Sequence[str], width: int = 16, row_major: bool = True, size: int = BLOCK) -> DataFrame:
    """Bytes of a packed column: header, payload of full blocks, a byte or two for each run of zero blocks, the raw tail.

    Row-major payload is padded to whole bytes in each row, low-dimensional payload is not.
    """
    header_bits = 3 if width == 8 else 4
    full = blocks.where(F.col("n_rows") == size)
    w = W.partitionBy(*keys).orderBy("block")
    full = full.withColumn("begins_run", (F.col("bits") == 0) & (F.coalesce(F.lag("bits").over(w), F.lit(-1)) != 0))
    payload = size * F.ceil(F.col("stored_bits") / 8) if row_major else F.col("stored_bits")
    sums = full.groupBy(*keys).agg(F.sum(payload).alias("payload"), F.count_if(F.col("bits") > 0).alias("packed"), F.count_if("begins_run").alias("runs"))
    totals = blocks.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.when(F.col("n_rows") < size, F.col("n_rows")).otherwise(0)).alias("tail"))
    joined = totals.join(sums, list(keys), "left").fillna(0, ["payload", "packed", "runs"])
    packed = 8 + F.col("payload") + F.ceil((F.col("packed") + F.col("runs")) * header_bits / 8) + F.col("runs") + F.col("tail") * (width // 8)
    return joined.select(*keys, "n_rows", (F.col("n_rows") * (width // 8)).alias("raw_bytes"), packed.cast("bigint").alias("packed_bytes"))


def reduce_blocks(blocks: DataFrame, keys: Sequence[str], op: str) -> DataFrame:
    """MAX or SUM from block summaries, without decoding a value."""
    value = {"max": F.max("max_value"), "min": F.min("min_value"), "sum": F.sum("sum_value"), "count": F.sum("n_rows")}[op]
    return blocks.groupBy(*keys).agg(value.alias(f"{op}_value"))


def reduce_encoded(df: DataFrame, s: Series, residual: str, op: str) -> DataFrame:
    """MAX or SUM of a series given its deltas."""
    decoded = df.withColumn("decoded", undo_delta(s, residual))
    return decoded.groupBy(*s.keys).agg({"max": F.max("decoded"), "min": F.min("decoded"), "sum": F.sum("decoded")}[op].alias(f"{op}_value"))


LOSSES = {
    "l1": lambda e: F.sum(F.abs(e)),
    "l2": lambda e: F.sum(e * e),
    "linf": lambda e: F.max(F.abs(e)),
    "logabs": lambda e: F.sum(F.log1p(F.abs(e).cast("double"))),
    "bits": lambda e: F.sum(bits.bit_length(bits.zigzag(e))),
}


def best_of_blocks(df: DataFrame, s: Series, candidates: dict[str, Column], loss: str = "linf", size: int = BLOCK) -> DataFrame:
    """For each block the candidate residual of least loss, the first of equal ones: keys, block, choice, loss."""
    rows = with_blocks(df.withColumns({f"c_{k}": c for k, c in candidates.items()}), s, size)
    table = rows.groupBy(*s.keys, "block").agg(*[LOSSES[loss](F.col(f"c_{k}")).alias(k) for k in candidates])
    least = F.least(*[F.col(k) for k in candidates])
    choice = F.coalesce(*[F.when(F.col(k) == least, F.lit(k)) for k in candidates])
    return table.select(*s.keys, "block", choice.alias("choice"), least.alias("loss"))


def search_codec(df: DataFrame, s: Series, columns: Sequence[str], candidates: dict, loss: str = "l1") -> DataFrame:
    """The candidate of least loss for each column, all losses in one aggregation: column, choice, loss. candidates: name -> f(series, column)."""
    made = df.withColumns({f"{c}__{k}": f(s, c) for c in columns for k, f in candidates.items()})
    row = made.agg(*[LOSSES[loss](F.col(f"{c}__{k}")).alias(f"{c}__{k}") for c in columns for k in candidates])
    cells = [F.struct(F.lit(c).alias("column"), F.array(*[F.struct(F.col(f"{c}__{k}").alias("loss"), F.lit(n).alias("rank"), F.lit(k).alias("choice")) for n, k in enumerate(candidates)]).alias("all")) for c in columns]
    return row.select(F.inline(F.array(*cells))).select("column", F.array_min("all").alias("best")).select("column", "best.choice", "best.loss")


# ---- quantisation ----------------------------------------------------------------------


def quantise(x: Column, offset: float, scale: float, null_code: int | None = None) -> Column:
    """Nearest code, ties to even; nulls, NaN and infinities take null_code."""
    code = F.bround((x - offset) * scale).cast("bigint")
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.when(finite, code).otherwise(F.lit(null_code).cast("bigint"))


def dequantise(code: Column, offset: float, scale: float, null_code: int | None = None) -> Column:
    value = code / F.lit(float(scale)) + offset
    return value if null_code is None else F.when(code != null_code, value)


def infer_quantisation(df: DataFrame, x: str, most: int = 6, tolerance: float = 0.01) -> DataFrame:
    """offset (least value), scale (smallest power of ten with rounding errors under the tolerance, else the greatest tried), n_nulls, bits (8, 16, 32 or 64; the top code is kept for nulls if there are any)."""
    v = F.when(~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x).cast("double")) != float("inf")), F.col(x).cast("double"))
    low = df.select(v.alias("v")).agg(F.min("v").alias("offset"), F.max("v").alias("top"), F.count_if(F.col("v").isNull()).alias("n_nulls"))
    errors = df.select(v.alias("v")).crossJoin(F.broadcast(low.select("offset"))).agg(*[F.max(F.abs(F.bround((F.col("v") - F.col("offset")) * 10**k) / 10**k - (F.col("v") - F.col("offset")))).alias(f"e{k}") for k in range(most + 1)])
    scale = F.coalesce(*[F.when(F.col(f"e{k}") < tolerance, F.lit(10**k)) for k in range(most + 1)], F.lit(10**most))
    out = low.crossJoin(errors).withColumn("scale", F.when(F.col("top") == F.col("offset"), F.lit(1)).otherwise(scale))
    levels = F.bround((F.col("top") - F.col("offset")) * F.col("scale")) + F.when(F.col("n_nulls") > 0, 1).otherwise(0)
    return out.select("offset", "scale", "n_nulls", F.when(levels < 256, 8).when(levels < 65536, 16).when(levels < 2**32, 32).otherwise(64).alias("bits"))


# ---- runs, extrema, sliding windows ----------------------------------------------------


def constant_runs(df: DataFrame, s: Series, x: str) -> DataFrame:
    """Maximal runs of equal values: keys, start_idx, end_idx (exclusive), value. Nulls are equal to each other."""
    rows = df.withColumn("i", s.index()).withColumn("change", F.when((F.col("i") == 0) | ~F.col(x).eqNullSafe(F.lag(x).over(s.window)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("change").over(s.running))
    return rows.groupBy(*s.keys, "run").agg(F.min("i").alias("start_idx"), (F.max("i") + 1).alias("end_idx"), F.first(x).alias("value")).drop("run")


def local_extrema(df: DataFrame, s: Series, x: str, maxima: bool = True, allow_equal: bool = False) -> DataFrame:
    """Rows beyond both neighbours; the ends have one neighbour."""
    before, after = F.lag(x).over(s.window), F.lead(x).over(s.window)
    beyond = (lambda a: a.isNull() | ((F.col(x) >= a) if allow_equal else (F.col(x) > a))) if maxima else (lambda a: a.isNull() | ((F.col(x) <= a) if allow_equal else (F.col(x) < a)))
    return df.withColumn("i", s.index()).withColumns({"before": before, "after": after}).where(beyond(F.col("before")) & beyond(F.col("after"))).drop("before", "after")


def frame(s: Series, n: int) -> WindowSpec:
    """The last n rows."""
    return s.window.rowsBetween(-(n - 1), 0)


def sliding_arg(df: DataFrame, s: Series, x: str, n: int, least: bool = True) -> Column:
    """Index of the least (greatest) of the last n values, the later of equal ones."""
    key = F.struct(F.col(x) if least else -F.col(x), -F.col("i"))
    return F.min_by("i", key).over(frame(s, n))


def sliding_windows(df: DataFrame, s: Series, x: str, length: int, step: int = 1) -> DataFrame:
    """keys, i (start), win (array) of each full window."""
    rows = df.withColumn("i", s.index()).withColumn("win", F.collect_list(x).over(s.window.rowsBetween(0, length - 1)))
    return rows.where((F.size("win") == length) & (F.col("i") % step == 0)).select(*s.keys, "i", "win")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str) -> DataFrame:
    """left with found_time, the first time in right of equal keys at or after its own (null if none), by one window over both, without a range join."""
    both = left.withColumn("__t", F.col(left_time)).withColumn("__r", F.lit(None).cast(right.schema[right_time].dataType)).withColumn("__left", F.lit(1))
    other = right.select(*keys, F.col(right_time).alias("__t"), F.col(right_time).alias("__r"), F.lit(0).alias("__left"))
    both = both.unionByName(other, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col("__t"), F.desc("__left")).rowsBetween(0, W.unboundedFollowing)
    return both.withColumn("found_time", F.first("__r", ignorenulls=True).over(w)).where("__left = 1").drop("__t", "__r", "__left")


def union_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, pad: int = 0) -> DataFrame:
    """Padded intervals merged where they overlap; those that only touch stay apart. Starts are not below 0."""
    rows = df.select(*keys, F.greatest(F.col(start) - pad, F.lit(0)).alias("start_idx"), (F.col(end) + pad).alias("end_idx"))
    w = W.partitionBy(*keys).orderBy("start_idx", "end_idx")
    rows = rows.withColumn("reach", F.max("end_idx").over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("reach") > F.col("start_idx"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("island")


def remap_intervals(union: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged intervals with their place when only they are kept: new_start, new_end."""
    w = W.partitionBy(*keys).orderBy("start_idx")
    size = F.col("end_idx") - F.col("start_idx")
    return union.withColumn("new_end", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("new_start", F.col("new_end") - size)


def ngrams(df: DataFrame, s: Series, x: str, n: int, sep: str = ">") -> DataFrame:
    """keys, i, gram of each n consecutive values."""
    parts = [F.lead(x, k).over(s.window) for k in range(n)]
    rows = df.withColumns({f"g{k}": p for k, p in enumerate(parts)}).withColumn("i", s.index())
    return rows.where(" AND ".join(f"g{k} IS NOT NULL" for k in range(n))).select(*s.keys, "i", F.concat_ws(sep, *[f"g{k}" for k in range(n)]).alias("gram"))


def seams(df: DataFrame, s: Series, x: str, n: int = 5) -> DataFrame:
    """n values interpolated between the last value of each series and the first of the next (by key): keys of the earlier, step, value."""
    ends = df.groupBy(*s.keys).agg(F.min_by(x, F.struct(*s.order)).alias("first"), F.max_by(x, F.struct(*s.order)).alias("last"))
    ends = ends.withColumn("next", F.lead("first").over(W.partitionBy(F.lit(0)).orderBy(*s.keys))).where("next IS NOT NULL")
    return ends.select(*s.keys, "last", "next", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(*s.keys, "step", (F.col("last") + (F.col("next") - F.col("last")) * F.col("step") / (n + 1)).alias("value"))
