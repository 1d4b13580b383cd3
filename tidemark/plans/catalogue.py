"""The registered queries over time series, each with its SQL where there is one.

The main series are `events` by user in the order (ts, event_id), with q = value in cents.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import bits
from tidemark.operators import adaptive, codecs, learned
from tidemark.operators import recurrences as R
from tidemark.operators import series as S
from tidemark.operators import similarity as N
from tidemark.sources import synthetic


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
USER = S.Series(("user_id",), ("ts", "event_id"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("q", F.bround(F.col("value") * 100).cast("bigint"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


E = """WITH e0 AS (SELECT *, CAST(round_even(value * 100, 0) AS BIGINT) AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
e AS (SELECT *, i // 8 AS block, i % 8 AS pos, q - coalesce(lag(q) OVER w, 0) AS d1, q - 2 * coalesce(lag(q) OVER w, 0) + coalesce(lag(q, 2) OVER w, 0) AS d2,
q - 3 * coalesce(lag(q) OVER w, 0) + 3 * coalesce(lag(q, 2) OVER w, 0) - coalesce(lag(q, 3) OVER w, 0) AS d3 FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""
ZZ = "CASE WHEN {0} < 0 THEN -2 * {0} - 1 ELSE 2 * {0} END"
NB = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"
B = E + f""", b0 AS (SELECT user_id, block, count(*) AS n_rows, min_by(q, pos) AS first_value, min(q) AS min_value, max(q) AS max_value, CAST(sum(q) AS BIGINT) AS sum_value, max({NB.format("(" + ZZ.format("d1") + ")")}) AS bits FROM e GROUP BY user_id, block),
b AS (SELECT *, CASE WHEN bits = 15 THEN 16 ELSE bits END AS stored_bits FROM b0)
"""


def _simple(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = Query(lambda spark, d: f(events(spark, d)), sql)


# ---- scans, projections, predicates ----------------------------------------------------

_simple("scan_project", lambda e: e.select("event_id", "user_id", "q"), E + "SELECT event_id, user_id, q FROM e")
_simple("file_sizes", lambda e: e.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), s.cast("bigint").alias("bytes")) for c, s in (("event_type", F.octet_length("event_type")), ("props", F.octet_length("props")), ("value", F.lit(8)), ("user_id", F.lit(8)))]))).groupBy("col").agg(F.sum("bytes").alias("bytes")),
        "SELECT col, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT 'event_type' AS col, strlen(event_type) AS b FROM events UNION ALL SELECT 'props', strlen(props) FROM events UNION ALL SELECT 'value', 8 FROM events UNION ALL SELECT 'user_id', 8 FROM events) GROUP BY col")
_simple("filter_index", lambda e: e.withColumn("i", USER.index()).where((F.col("q") > 25_000) & (F.col("i") % 2 == 0)).select("user_id", "i", "q"), E + "SELECT user_id, i, q FROM e WHERE q > 25000 AND i % 2 = 0")
_simple("nonzero_idx", lambda e: e.withColumn("i", USER.index()).where(F.col("q") % 10 != 0).select("user_id", "i"), E + "SELECT user_id, i FROM e WHERE q % 10 <> 0")
_simple("find_first_last", lambda e: e.withColumn("i", USER.index()).where("event_type = 'purchase'").groupBy("user_id").agg(F.min("i").alias("first_idx"), F.max("i").alias("last_idx"), F.count("*").alias("n")), E + "SELECT user_id, min(i) AS first_idx, max(i) AS last_idx, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY user_id")
_simple("sentinel_null", lambda e: e.select("event_id", F.nullif(F.col("q") % 7, F.lit(0)).alias("x")), E + "SELECT event_id, nullif(q % 7, 0) AS x FROM e")
_simple("backfill", lambda e: e.withColumn("x", F.nullif(F.col("q") % 3, F.lit(0))).select("event_id", F.first("x", ignorenulls=True).over(USER.window.rowsBetween(0, W.unboundedFollowing)).alias("x")),
        E + "SELECT event_id, first_value(nullif(q % 3, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM e")
_simple("fill_zero", lambda e: e.select("event_id", F.coalesce(F.nullif(F.col("q") % 3, F.lit(1)), F.lit(0)).alias("x")), E + "SELECT event_id, coalesce(nullif(q % 3, 1), 0) AS x FROM e")
_simple("boolean_reductions", lambda e: e.groupBy("user_id").agg(F.every(F.col("q") >= 0).alias("all_nonnegative"), F.some(F.col("q") > 49_000).alias("any_large"), (F.max("q") - F.min("q") <= 10).alias("all_equal")), E + "SELECT user_id, bool_and(q >= 0) AS all_nonnegative, bool_or(q > 49000) AS any_large, max(q) - min(q) <= 10 AS all_equal FROM e GROUP BY user_id")

# ---- predictors and scalar kernels -----------------------------------------------------

_simple("delta", lambda e: e.select("event_id", S.delta(USER, "q").alias("residual")), E + "SELECT event_id, d1 AS residual FROM e")
_simple("double_delta", lambda e: e.select("event_id", S.double_delta(USER, "q").alias("residual")), E + "SELECT event_id, d2 AS residual FROM e")
_simple("triple_delta", lambda e: e.select("event_id", S.triple_delta(USER, "q").alias("residual")), E + "SELECT event_id, d3 AS residual FROM e")
_simple("fir_predict", lambda e: e.select("event_id", S.fir(USER, "q", (2, -1)).alias("residual")), E + "SELECT event_id, d2 AS residual FROM e")


@query(E + "SELECT user_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM e GROUP BY user_id")
def delta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("r", S.delta(USER, "q")).withColumn("back", S.undo_delta(USER, "r"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("back") != F.col("q")).alias("mismatches"))


@query(E + "SELECT user_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM e GROUP BY user_id")
def double_delta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("r", S.double_delta(USER, "q")).withColumn("r", S.undo_delta(USER, "r")).withColumn("back", S.undo_delta(USER, "r"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("back") != F.col("q")).alias("mismatches"))


_simple("zigzag", lambda e: e.select("event_id", bits.zigzag(S.delta(USER, "q")).alias("z")), E + f"SELECT event_id, {ZZ.format('d1')} AS z FROM e")
_simple("zigzag_roundtrip", lambda e: e.select("event_id", bits.unzigzag(bits.zigzag(S.delta(USER, "q"))).alias("x")), E + "SELECT event_id, d1 AS x FROM e")
_simple("nbits_unsigned", lambda e: e.select("event_id", bits.bits_unsigned(F.col("q")).alias("n")), E + f"SELECT event_id, CAST({NB.format('q')} AS INT) AS n FROM e")
_simple("nbits_signed", lambda e: e.select("event_id", bits.bits_signed(S.delta(USER, "q")).alias("n")), E + f"SELECT event_id, CAST(CASE WHEN d1 = 0 THEN 0 ELSE 1 + {NB.format('(CASE WHEN d1 < 0 THEN -d1 - 1 ELSE d1 END)')} END AS INT) AS n FROM e")
_simple("wrap8", lambda e: e.select("event_id", bits.wrap_signed(S.delta(USER, "q"), 8).alias("x")), E + "SELECT event_id, ((d1 + 128) & 255) - 128 AS x FROM e")
_simple("wrap16", lambda e: e.select("event_id", bits.wrap_signed(S.delta(USER, "q"), 16).alias("x")), E + "SELECT event_id, ((d1 + 32768) & 65535) - 32768 AS x FROM e")
_simple("sign_extend", lambda e: e.select("event_id", bits.sign_extend(F.col("q").bitwiseAND(F.lit(255)), 8).alias("x")), E + "SELECT event_id, xor(q & 255, 128::BIGINT) - 128 AS x FROM e")
_simple("bitwise", lambda e: e.select("event_id", F.col("q").bitwiseAND(F.lit(12)).alias("a"), F.col("q").bitwiseOR(F.lit(12)).alias("o"), F.col("q").bitwiseXOR(F.lit(12)).alias("x"), F.bitwise_not("q").alias("n")), E + "SELECT event_id, q & 12 AS a, q | 12 AS o, xor(q, 12::BIGINT) AS x, -q - 1 AS n FROM e")
_simple("math_functions", lambda e: e.select("event_id", *[F.round(f(F.col("value")), 6).alias(n) for n, f in (("r_sqrt", F.sqrt), ("r_cbrt", F.cbrt), ("r_log", bits.logarithm), ("r_log2", lambda x: bits.logarithm(x, F.log2)), ("r_sin", F.sin), ("r_atan", F.atan), ("r_ceil", F.ceil), ("r_floor", F.floor))]),
        "SELECT event_id, round(sqrt(value), 6) AS r_sqrt, round(cbrt(value), 6) AS r_cbrt, round(ln(value), 6) AS r_log, round(log2(value), 6) AS r_log2, round(sin(value), 6) AS r_sin, round(atan(value), 6) AS r_atan, CAST(ceil(value) AS BIGINT) AS r_ceil, CAST(floor(value) AS BIGINT) AS r_floor FROM events")

# ---- blocks, runs, sizes, reductions ---------------------------------------------------


@query(B + "SELECT user_id, block, n_rows, first_value, min_value, max_value, sum_value, CAST(bits AS INT) AS bits, CAST(stored_bits AS INT) AS stored_bits FROM b")
def block_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.block_table(events(spark, d), USER, "q")


SIZE = B + """, f AS (SELECT *, CASE WHEN bits = 0 AND coalesce(lag(bits) OVER (PARTITION BY user_id ORDER BY block), -1) <> 0 THEN 1 ELSE 0 END AS br FROM b WHERE n_rows = 8),
s AS (SELECT user_id, sum({0}) AS payload, sum(CASE WHEN bits > 0 THEN 1 ELSE 0 END) AS packed, sum(br) AS runs FROM f GROUP BY user_id),
t AS (SELECT user_id, sum(n_rows) AS n_rows, sum(CASE WHEN n_rows < 8 THEN n_rows ELSE 0 END) AS tail FROM b GROUP BY user_id)
SELECT t.user_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_rows * 2 AS BIGINT) AS raw_bytes, CAST(8 + coalesce(payload, 0) + ceil((coalesce(packed, 0) + coalesce(runs, 0)) * 4 / 8) + coalesce(runs, 0) + tail * 2 AS BIGINT) AS packed_bytes FROM t LEFT JOIN s ON t.user_id = s.user_id
"""


@query(SIZE.format("8 * ceil(stored_bits / 8)"))
def packed_size_rowmajor(spark: SparkSession, d: str) -> DataFrame:
    return S.packed_size(S.block_table(events(spark, d), USER, "q"), ("user_id",))


@query(SIZE.format("stored_bits"))
def packed_size_lowdim(spark: SparkSession, d: str) -> DataFrame:
    return S.packed_size(S.block_table(events(spark, d), USER, "q"), ("user_id",), row_major=False)


@query("""WITH x AS (SELECT user_id, i // 2 AS block, c - coalesce(lag(c) OVER (PARTITION BY user_id ORDER BY i), 0) AS r FROM (SELECT user_id, CAST(floor(value / 250) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)),
b AS (SELECT user_id, block FROM x GROUP BY user_id, block HAVING max(abs(r)) = 0), g AS (SELECT *, block - row_number() OVER (PARTITION BY user_id ORDER BY block) AS island FROM b)
SELECT user_id, min(block) AS start_block, count(*) AS n_blocks FROM g GROUP BY user_id, island""")
def zero_block_runs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("c", F.floor(F.col("value") / 250))
    return S.zero_runs(S.block_table(e, USER, "c", size=2), ("user_id",))


@query(E + "SELECT user_id, max(q) AS max_value FROM e GROUP BY user_id")
def reduce_max(spark: SparkSession, d: str) -> DataFrame:
    return S.reduce_encoded(events(spark, d).withColumn("r", S.delta(USER, "q")), USER, "r", "max")


@query(E + "SELECT user_id, CAST(sum(q) AS BIGINT) AS sum_value FROM e GROUP BY user_id")
def reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    return S.reduce_encoded(events(spark, d).withColumn("r", S.delta(USER, "q")), USER, "r", "sum")


@query(E + "SELECT user_id, max(q) AS max_value FROM e GROUP BY user_id")
def summary_max(spark: SparkSession, d: str) -> DataFrame:
    return S.reduce_blocks(S.block_table(events(spark, d), USER, "q"), ("user_id",), "max")


@query(E + "SELECT user_id, CAST(sum(q) AS BIGINT) AS sum_value FROM e GROUP BY user_id")
def summary_sum(spark: SparkSession, d: str) -> DataFrame:
    return S.reduce_blocks(S.block_table(events(spark, d), USER, "q"), ("user_id",), "sum")


@query(B + "SELECT user_id, CAST(sum(sum_value) AS BIGINT) AS sum_value, max(max_value) AS max_value, CAST(sum(stored_bits) AS BIGINT) AS payload_bytes FROM b GROUP BY user_id")
def encoded_sum_max(spark: SparkSession, d: str) -> DataFrame:
    """Delta and zigzag encode, summarise by block, answer SUM and MAX and the payload's size from the summaries."""
    blocks = S.block_table(events(spark, d), USER, "q")
    return blocks.groupBy("user_id").agg(F.sum("sum_value").alias("sum_value"), F.max("max_value").alias("max_value"), F.sum("stored_bits").cast("bigint").alias("payload_bytes"))


_simple("reduce_noop", lambda e: e.withColumn("r", S.delta(USER, "q")).select("event_id", S.undo_delta(USER, "r").alias("q")), E + "SELECT event_id, q FROM e")


@query(E + "SELECT user_id, CAST(sum(length(event_type)) AS BIGINT) AS total FROM e GROUP BY user_id")
def rle_sum(spark: SparkSession, d: str) -> DataFrame:
    runs = S.constant_runs(events(spark, d), USER, "event_type")
    return runs.groupBy("user_id").agg(F.sum(F.length("value") * (F.col("end_idx") - F.col("start_idx"))).alias("total"))


CHOICE = E + """, c AS (SELECT user_id, block, {0} FROM e GROUP BY user_id, block) SELECT user_id, block, {1} AS choice, {2} AS loss FROM c"""


@query(CHOICE.format("max(abs(d1)) AS a, max(abs(d2)) AS b", "CASE WHEN a <= b THEN 'delta' ELSE 'double' END", "least(a, b)"))
def dyn_delta_choice(spark: SparkSession, d: str) -> DataFrame:
    return S.best_of_blocks(events(spark, d), USER, {"delta": S.delta(USER, "q"), "double": S.double_delta(USER, "q")}, "linf")


@query(CHOICE.format("sum(abs(d1)) AS a, sum(abs(d2)) AS b, sum(abs(d3)) AS t", "CASE WHEN a <= b AND a <= t THEN 'delta' WHEN b <= t THEN 'double' ELSE 'triple' END", "CAST(least(a, b, t) AS BIGINT)"))
def best_of_filters(spark: SparkSession, d: str) -> DataFrame:
    return S.best_of_blocks(events(spark, d), USER, {"delta": S.delta(USER, "q"), "double": S.double_delta(USER, "q"), "triple": S.triple_delta(USER, "q")}, "l1")


LINES = S.Series(("l_suppkey",), ("l_orderkey", "l_linenumber", "l_partkey"))


def lineitems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("qty"), F.bround(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), F.bround(F.col("l_discount") * 100).cast("bigint").alias("disc"))


_W = "WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)"
_SEARCH = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum(abs({c})) AS raw, sum(abs({c} - coalesce(p_{c}, 0))) AS d1, sum(abs({c} - 2 * coalesce(p_{c}, 0) + coalesce(pp_{c}, 0))) AS d2 FROM l" for c in ("qty", "price", "disc"))


@query(f"""WITH l0 AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS qty, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS price, CAST(round_even(l_discount * 100, 0) AS BIGINT) AS disc FROM lineitem),
l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c}, lag({c}, 2) OVER w AS pp_{c}" for c in ("qty", "price", "disc"))} FROM l0 {_W}), s AS ({_SEARCH})
SELECT "column", CASE WHEN raw <= d1 AND raw <= d2 THEN 'raw' WHEN d1 <= d2 THEN 'delta' ELSE 'double' END AS choice, CAST(least(raw, d1, d2) AS BIGINT) AS loss FROM s""")
def codec_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_codec(lineitems(spark, d), LINES, ("qty", "price", "disc"), {"raw": lambda s, c: F.col(c), "delta": S.delta, "double": S.double_delta})


@query("SELECT l_suppkey, CAST(sum(abs(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) - 150000 * CAST(l_quantity AS BIGINT))) AS BIGINT) AS loss FROM lineitem GROUP BY l_suppkey")
def colsum_predict(spark: SparkSession, d: str) -> DataFrame:
    return lineitems(spark, d).groupBy("l_suppkey").agg(F.sum(F.abs(F.col("price") - 150_000 * F.col("qty"))).alias("loss"))


# ---- quantisation, losses, digits ------------------------------------------------------

_simple("quantize_fixed", lambda e: e.select("event_id", S.quantise(F.col("value"), 0.0, 10.0, 65535).alias("code")), "SELECT event_id, CAST(round_even(value * 10, 0) AS BIGINT) AS code FROM events")
_simple("dequantize", lambda e: e.select("event_id", F.bround(S.dequantise(S.quantise(F.col("value"), 0.0, 10.0), 0.0, 10.0) * 10).cast("bigint").alias("tenths")), "SELECT event_id, CAST(round_even(value * 10, 0) AS BIGINT) AS tenths FROM events")
_simple("quant_error", lambda e: e.select("value", (S.dequantise(S.quantise(F.col("value"), 0.0, 1.0), 0.0, 1.0) - F.col("value")).alias("err")).agg(F.round(F.avg(F.col("err") * F.col("err")) / F.var_pop("value") * 1e6, 3).alias("error_ppm")), "SELECT round(avg(pow(round_even(value, 0) - value, 2)) / var_pop(value) * 1e6, 3) AS error_ppm FROM events")


@query("""WITH v AS (SELECT c_acctbal - (SELECT min(c_acctbal) FROM customer) AS x FROM customer), k AS (SELECT unnest(range(7)) AS k),
e AS (SELECT k, max(abs(round_even(x * 10**k, 0) / 10**k - x)) AS err FROM v, k GROUP BY k), s AS (SELECT coalesce(min(k) FILTER (WHERE err < 0.01), 6) AS k FROM e)
SELECT (SELECT min(c_acctbal) FROM customer) AS "offset", CAST(10**k AS INT) AS scale, CAST(0 AS BIGINT) AS n_nulls, CAST(CASE WHEN (SELECT round_even(max(x) * 10**k, 0) FROM v) < 256 THEN 8 WHEN (SELECT round_even(max(x) * 10**k, 0) FROM v) < 65536 THEN 16 WHEN (SELECT round_even(max(x) * 10**k, 0) FROM v) < 4294967296 THEN 32 ELSE 64 END AS INT) AS bits FROM s""")
def quantize_infer(spark: SparkSession, d: str) -> DataFrame:
    return S.infer_quantisation(table(spark, d, "customer"), "c_acctbal")


def _minmax(levels: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = events(spark, d)
        row = e.agg(F.min("q").alias("lo"), F.greatest(F.lit(1), F.max("q") - F.min("q")).alias("span"))
        return e.join(F.broadcast(row), F.lit(True)).select("event_id", F.floor((F.col("q") - F.col("lo")) * levels / F.col("span")).alias("code"))

    return run


for _n, _levels in (("minmax_u8", 255), ("minmax_u16", 65535)):
    QUERIES[_n] = Query(_minmax(_levels), E + f"SELECT event_id, CAST(floor((q - (SELECT min(q) FROM e)) * {_levels} / (SELECT greatest(1, max(q) - min(q)) FROM e)) AS BIGINT) AS code FROM e")
_simple("losses", lambda e: e.withColumn("r", S.delta(USER, "q")).groupBy("user_id").agg(S.LOSSES["l1"](F.col("r")).alias("l1"), S.LOSSES["l2"](F.col("r")).alias("l2"), S.LOSSES["linf"](F.col("r")).alias("linf"), F.round(S.LOSSES["logabs"](F.col("r")), 6).alias("logabs"), S.LOSSES["bits"](F.col("r")).alias("n_bits")),
        E + f"SELECT user_id, CAST(sum(abs(d1)) AS BIGINT) AS l1, CAST(sum(d1 * d1) AS BIGINT) AS l2, max(abs(d1)) AS linf, round(sum(ln(1 + abs(d1))), 6) AS logabs, CAST(sum({NB.format('(' + ZZ.format('d1') + ')')}) AS BIGINT) AS n_bits FROM e GROUP BY user_id")


@query("WITH t AS (SELECT regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '^0+|0+$', '', 'g') AS t FROM part) SELECT CAST(max(CASE WHEN instr(t, '.') = 0 THEN length(t) ELSE instr(t, '.') - 1 END) AS INT) AS before_point, CAST(max(CASE WHEN instr(t, '.') = 0 THEN 0 ELSE length(t) - instr(t, '.') END) AS INT) AS after_point FROM t")
def digit_stats(spark: SparkSession, d: str) -> DataFrame:
    before, after = bits.digits_around_point(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    return table(spark, d, "part").agg(F.max(before).alias("before_point"), F.max(after).alias("after_point"))


# The greatest value that comes first, as the SQL finds it in its window's order.
_simple("moments", lambda e: e.groupBy("user_id").agg(F.sum("q").alias("total"), F.round(F.avg("q"), 6).alias("mean"), F.round(F.var_pop("q"), 3).alias("variance"), F.round(F.stddev_pop("q"), 6).alias("stdev"), F.min_by("event_id", F.when(F.col("q").isNotNull(), F.struct(-F.col("q"), "ts", "event_id"))).alias("argmax"), F.sum(F.col("q") * F.col("q")).alias("sumsq")),
        E + "SELECT user_id, CAST(sum(q) AS BIGINT) AS total, round(avg(q), 6) AS mean, round(var_pop(q), 3) AS variance, round(stddev_pop(q), 6) AS stdev, max_by(event_id, q) AS argmax, CAST(sum(q * q) AS BIGINT) AS sumsq FROM e GROUP BY user_id")

# ---- runs, intervals, windows ----------------------------------------------------------

RUNS = E + """, r AS (SELECT *, CASE WHEN i = 0 OR event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS c FROM e), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM r),
runs AS (SELECT user_id, min(i) AS start_idx, max(i) + 1 AS end_idx, first(event_type) AS value FROM g GROUP BY user_id, run)
"""


@query(RUNS + "SELECT * FROM runs")
def label_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.constant_runs(events(spark, d), USER, "event_type")


@query(RUNS + "SELECT end_idx - start_idx AS run_length, count(*) AS n FROM runs GROUP BY 1")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return S.constant_runs(events(spark, d), USER, "event_type").groupBy((F.col("end_idx") - F.col("start_idx")).alias("run_length")).agg(F.count("*").alias("n"))


UNION = RUNS + """, p AS (SELECT user_id, greatest(start_idx - 1, 0) AS start_idx, end_idx + 1 AS end_idx FROM runs WHERE value = 'purchase'),
q AS (SELECT *, max(end_idx) OVER (PARTITION BY user_id ORDER BY start_idx, end_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
h AS (SELECT *, sum(CASE WHEN reach > start_idx THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_idx, end_idx ROWS UNBOUNDED PRECEDING) AS island FROM q),
u AS (SELECT user_id, min(start_idx) AS start_idx, max(end_idx) AS end_idx FROM h GROUP BY user_id, island)
"""


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    return S.union_intervals(S.constant_runs(events(spark, d), USER, "event_type").where("value = 'purchase'"), ("user_id",), "start_idx", "end_idx", 1)


QUERIES["interval_union"] = Query(_purchases, UNION + "SELECT * FROM u")


@query(UNION + "SELECT *, CAST(sum(end_idx - start_idx) OVER (PARTITION BY user_id ORDER BY start_idx) AS BIGINT) AS new_end, CAST(sum(end_idx - start_idx) OVER (PARTITION BY user_id ORDER BY start_idx) - (end_idx - start_idx) AS BIGINT) AS new_start FROM u")
def interval_remap(spark: SparkSession, d: str) -> DataFrame:
    return S.remap_intervals(_purchases(spark, d), ("user_id",))


@query(UNION + "SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM u WHERE u.user_id = e.user_id AND e.i >= u.start_idx AND e.i < u.end_idx)")
def near_annotations(spark: SparkSession, d: str) -> DataFrame:
    e, u = events(spark, d).withColumn("i", USER.index()), _purchases(spark, d).withColumnRenamed("user_id", "u_user")
    return e.join(u, (F.col("user_id") == F.col("u_user")) & (F.col("i") >= F.col("start_idx")) & (F.col("i") < F.col("end_idx")), "left_semi").select("event_id")


@query(UNION + "SELECT user_id, count(*) AS n FROM u WHERE start_idx >= 5 AND end_idx <= 40 GROUP BY user_id")
def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    return _purchases(spark, d).where("start_idx >= 5 AND end_idx <= 40").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) AS found_time FROM orders")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), "o_orderdate")
    return S.as_of(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate"), ("k",), "o_orderdate", "l_shipdate").select("o_orderkey", "found_time")


_F8 = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_simple("sliding_stats", lambda e: e.select("event_id", F.round(F.avg("q").over(S.frame(USER, 8)), 6).alias("mean"), F.round(F.var_pop("q").over(S.frame(USER, 8)), 2).alias("variance"), F.min("q").over(S.frame(USER, 8)).alias("least"), F.max("q").over(S.frame(USER, 8)).alias("most")),
        E + f"SELECT event_id, round(avg(q) {_F8}, 6) AS mean, round(var_pop(q) {_F8}, 2) AS variance, min(q) {_F8} AS least, max(q) {_F8} AS most FROM e")
_simple("sliding_median", lambda e: e.select("event_id", F.percentile("q", 0.5).over(S.frame(USER, 5)).alias("median")), E + f"SELECT event_id, quantile_cont(q, 0.5) {_F8.replace('7', '4')} AS median FROM e")
for _n, _least, _f in (("sliding_min_idx", True, "q * 1000 - i"), ("sliding_max_idx", False, "-q * 1000 - i")):
    _simple(_n, lambda e, least=_least: e.withColumn("i", USER.index()).select("event_id", S.sliding_arg(e, USER, "q", 6, least).alias("at")), E + f"SELECT event_id, min_by(i, {_f}) {_F8.replace('7', '5')} AS at FROM e")
_simple("sliding_windows", lambda e: S.sliding_windows(e, USER, "q", 4).select("user_id", "i", F.array_join("win", ",").alias("win")), E + "SELECT user_id, i, win FROM (SELECT user_id, i, string_agg(CAST(q AS VARCHAR), ',') OVER w AS win, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4")
_simple("strided_windows", lambda e: S.sliding_windows(e, USER, "q", 4, 4).select("user_id", "i", F.array_join("win", ",").alias("win")), E + "SELECT user_id, i, win FROM (SELECT user_id, i, string_agg(CAST(q AS VARCHAR), ',') OVER w AS win, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4 AND i % 4 = 0")
_GRAM = E + ", g AS (SELECT user_id, i, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))\n"
_simple("subseq_match", lambda e: S.ngrams(e, USER, "event_type", 2).where("gram = 'view>purchase' OR gram = 'click>purchase'").select("user_id", "i"), _GRAM + "SELECT user_id, i FROM g WHERE b = 'purchase' AND a IN ('view', 'click')")
_simple("ngram_counts", lambda e: S.ngrams(e, USER, "event_type", 3).groupBy("gram").agg(F.count("*").alias("n")), _GRAM + "SELECT a || '>' || b || '>' || c AS gram, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY 1")


@query(_GRAM + ", t AS (SELECT a, count(*) AS total FROM g WHERE b IS NOT NULL GROUP BY a) SELECT g.a AS before, count(*) AS n, max(total) AS total FROM g JOIN t ON g.a = t.a WHERE b = 'purchase' GROUP BY g.a")
def predecessor_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = events(spark, d).select(F.col("event_type").alias("before"), F.lead("event_type").over(USER.window).alias("after")).where("after IS NOT NULL")
    return pairs.groupBy("before").agg(F.count_if(F.col("after") == "purchase").alias("n"), F.count("*").alias("total")).where("n > 0")


_simple("surrounding", lambda e: e.withColumns({"around": F.array_join(F.collect_list("q").over(USER.window.rowsBetween(-2, 2)), ",")}).where("event_type = 'purchase'").select("event_id", "around"), E + "SELECT event_id, around FROM (SELECT event_id, event_type, string_agg(CAST(q AS VARCHAR), ',') OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM e) WHERE event_type = 'purchase'")
_EX = E + "SELECT user_id, i, q FROM (SELECT user_id, i, q, lag(q) OVER w AS a, lead(q) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE (a IS NULL OR q {0} a) AND (b IS NULL OR q {0} b)"
_simple("local_maxima", lambda e: S.local_extrema(e, USER, "q").select("user_id", "i", "q"), _EX.format(">"))
_simple("local_minima", lambda e: S.local_extrema(e, USER, "q", maxima=False).select("user_id", "i", "q"), _EX.format("<"))
_RUN = "OVER (PARTITION BY user_id ORDER BY i)"
_simple("running_stats", lambda e: e.select("event_id", F.sum("q").over(USER.running).alias("cumsum"), F.round(F.avg("q").over(USER.running), 6).alias("cummean"), F.round(F.var_pop("q").over(USER.running) * F.count("*").over(USER.running), 1).alias("cumsxx")), E + f"SELECT event_id, CAST(sum(q) {_RUN} AS BIGINT) AS cumsum, round(avg(q) {_RUN}, 6) AS cummean, round(var_pop(q) {_RUN} * count(*) {_RUN}, 1) AS cumsxx FROM e")

# ---- grouping, sorting, sets -----------------------------------------------------------

_simple("group_positions", lambda e: e.withColumn("i", USER.index()).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("positions")), E + "SELECT user_id, event_type, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM e GROUP BY user_id, event_type")
_simple("chunk_groups", lambda e: e.withColumn("chunk", F.floor(USER.index() / 10)).groupBy("user_id", "chunk").agg(F.sum("q").alias("total")), E + "SELECT user_id, i // 10 AS chunk, CAST(sum(q) AS BIGINT) AS total FROM e GROUP BY 1, 2")
_simple("pivot_counts", lambda e: e.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count("q")).fillna(0), E + "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS \"view\" FROM e GROUP BY user_id")
_simple("top_k", lambda e: e.orderBy(F.desc("q"), "event_id").limit(10).select("event_id", "q"), E + "SELECT event_id, q FROM e ORDER BY q DESC, event_id LIMIT 10")
_simple("argsort", lambda e: e.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("q", "event_id")).alias("place")), E + "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY q, event_id) AS INT) AS place FROM e")
_simple("reverse_series", lambda e: e.select("event_id", (F.count("*").over(USER.whole) - 1 - USER.index()).alias("i")), E + "SELECT event_id, count(*) OVER (PARTITION BY user_id) - 1 - i AS i FROM e")
_simple("rank_recode", lambda e: e.join(F.broadcast(e.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("code", F.row_number().over(W.orderBy(F.desc("n"), "event_type")) - 1)), "event_type").select("event_id", "code"), E + "SELECT event_id, CAST(code AS INT) AS code FROM e JOIN (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS code FROM events GROUP BY event_type) USING (event_type)")
_simple("seam_interpolate", lambda e: S.seams(e, USER, "q").select("user_id", "step", F.round("value", 6).alias("value")), E + ", f AS (SELECT user_id, min_by(q, i) AS a, max_by(q, i) AS z FROM e GROUP BY user_id), n AS (SELECT user_id, z, lead(a) OVER (ORDER BY user_id) AS nx FROM f) SELECT user_id, CAST(k AS INT) AS step, round(z + (nx - z) * k / 6, 6) AS value FROM n, (SELECT unnest(range(1, 6)) AS k) WHERE nx IS NOT NULL")
_simple("block_hashes", lambda e: S.with_blocks(e.withColumn("up", (S.delta(USER, "q") > 0).cast("bigint")), USER).groupBy("user_id", "block").agg(F.sum(F.expr("shiftleft(up, pos)")).alias("code")), E + "SELECT user_id, block, CAST(sum(CASE WHEN d1 > 0 THEN 1 << CAST(pos AS INT) ELSE 0 END) AS BIGINT) AS code FROM e GROUP BY user_id, block")
_simple("resample", lambda e: e.withColumn("i", USER.index()).withColumn("n", F.count("*").over(USER.whole)).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(15)))).where(F.floor(F.col("to") * F.col("n") / 16) == F.col("i")).select("user_id", "to", "q"), E + ", n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) SELECT user_id, CAST(k AS INT) AS \"to\", q FROM n JOIN e USING (user_id), (SELECT unnest(range(16)) AS k) WHERE e.i = k * n // 16")

# ---- normalisation and trend -----------------------------------------------------------

_WH = "OVER (PARTITION BY user_id)"
_simple("znorm", lambda e: e.select("event_id", F.round((F.col("q") - F.avg("q").over(USER.whole)) / F.greatest(F.stddev_pop("q").over(USER.whole), F.lit(0.001)), 6).alias("z")), E + f"SELECT event_id, round((q - avg(q) {_WH}) / greatest(stddev_pop(q) {_WH}, 0.001), 6) AS z FROM e")
_simple("mean_norm", lambda e: e.select("event_id", F.round(F.col("q") - F.avg("q").over(USER.whole), 4).alias("x")), E + f"SELECT event_id, round(q - avg(q) {_WH}, 4) AS x FROM e")
_simple("zero_one", lambda e: e.select("event_id", F.round((F.col("q") - F.min("q").over(USER.whole)) / F.greatest(F.lit(1), F.max("q").over(USER.whole) - F.min("q").over(USER.whole)), 8).alias("x")), E + f"SELECT event_id, round((q - min(q) {_WH}) / greatest(1, max(q) {_WH} - min(q) {_WH}), 8) AS x FROM e")
_simple("slope", lambda e: e.withColumn("i", USER.index()).groupBy("user_id").agg(F.round(F.regr_slope("q", "i"), 4).alias("slope"), F.round(F.corr("q", "i"), 6).alias("corr")), E + "SELECT user_id, round(regr_slope(q, i), 4) AS slope, round(corr(q, i), 6) AS corr FROM e GROUP BY user_id")
_simple("detrend", lambda e: e.withColumn("i", USER.index()).withColumns({"b": F.covar_pop("q", "i").over(USER.whole) / F.var_pop("i").over(USER.whole), "mq": F.avg("q").over(USER.whole), "mi": F.avg("i").over(USER.whole)}).select("event_id", F.round(F.col("q") - F.col("mq") - F.col("b") * (F.col("i") - F.col("mi")), 3).alias("x")), E + f"SELECT event_id, round(q - avg(q) {_WH} - covar_pop(q, i) {_WH} / var_pop(i) {_WH} * (i - avg(i) {_WH}), 3) AS x FROM e")

# ---- similarity ------------------------------------------------------------------------

V = """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), x AS (SELECT q.id AS query_id, r.id AS id, list_sum(list_transform(list_zip(r.vec, q.vec), lambda p: {0})) AS dist FROM v r, v q WHERE q.id % 50 = 0)
"""
_SQ, _L1, _DOT = "(p[1] - p[2]) * (p[1] - p[2])", "abs(p[1] - p[2])", "p[1] * p[2]"


def _distances(spark: SparkSession, d: str, measure: str = "squared") -> DataFrame:
    v = vectors(spark, d)
    return N.distances(v, v.where(F.col("id") % 50 == 0), measure)


for _n, _m, _s in (("dist_sq", "squared", _SQ), ("dist_l1", "manhattan", _L1), ("dot", "dot", _DOT)):
    QUERIES[_n] = Query(lambda spark, d, m=_m: _distances(spark, d, m).select("query_id", "id", F.round("dist", 6).alias("dist")), V.format(_s) + "SELECT query_id, id, round(dist, 6) AS dist FROM x")
QUERIES["hamming"] = Query(lambda spark, d: _distances(spark, d, "hamming"), V.format("CASE WHEN p[1] <> p[2] THEN 1.0 ELSE 0.0 END") + "SELECT query_id, id, CAST(dist AS DOUBLE) AS dist FROM x")
QUERIES["cosine"] = Query(lambda spark, d: _distances(spark, d, "cosine").select("query_id", "id", F.round("dist", 6).alias("dist")), V.format(_DOT) + ", n AS (SELECT id, sqrt(list_sum(list_transform(vec, lambda a: a * a))) AS n FROM v) SELECT query_id, x.id, round(dist / (a.n * b.n), 6) AS dist FROM x JOIN n a ON a.id = x.id JOIN n b ON b.id = query_id")
_TOP = V.format(_SQ) + "SELECT query_id, CAST(rank AS INT) AS rank, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM x {1}) WHERE rank <= {0}"
QUERIES["onenn"] = Query(lambda spark, d: N.nearest(_distances(spark, d).where("id <> query_id"), 1).select("query_id", "rank", "id"), _TOP.replace("{0}", "1").replace("{1}", "WHERE id <> query_id"))
QUERIES["knn_batch"] = Query(lambda spark, d: N.nearest(_distances(spark, d), 5).select("query_id", "rank", "id"), _TOP.replace("{0}", "5").replace("{1}", ""))
for _n, _inc, _op in (("radius", False, "<"), ("radius_incl", True, "<=")):
    QUERIES[_n] = Query(lambda spark, d, inc=_inc: N.within(_distances(spark, d), 1.2, inc).select("query_id", "id"), V.format(_SQ) + f"SELECT query_id, id FROM x WHERE dist {_op} 1.2")
QUERIES["outside_radius"] = Query(lambda spark, d: _distances(spark, d).where("dist >= 1.2").groupBy("query_id").agg(F.count("*").alias("n")), V.format(_SQ) + "SELECT query_id, count(*) AS n FROM x WHERE dist >= 1.2 GROUP BY query_id")


@query(E + """, w AS (SELECT user_id, i, list(q) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS win FROM e), x AS (SELECT user_id, i, list_sum(list_transform(list_zip(win, [10000, 20000, 30000, 40000]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM w WHERE len(win) = 4)
SELECT user_id, i, CAST(dist AS BIGINT) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dist, i) AS r FROM x) WHERE r <= 2""")
def windowed_knn(spark: SparkSession, d: str) -> DataFrame:
    wins = S.sliding_windows(events(spark, d), USER, "q", 4)
    dist: Column = F.aggregate(F.zip_with("win", F.array(*[F.lit(x).cast("bigint") for x in (10_000, 20_000, 30_000, 40_000)]), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    ranked = wins.withColumn("dist", dist).withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("dist", "i")))
    return ranked.where("r <= 2").select("user_id", "i", "dist")


# ---- recurrences and bytes (round trips) -----------------------------------------------

_EXACT = E + "SELECT user_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM e GROUP BY user_id"


def _mismatches(column: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = R.forecast_series(events(spark, d), USER, "q")
        return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col(column) != F.col("q")).alias("mismatches"))

    return run


QUERIES["fire_roundtrip"] = Query(_mismatches("residual_back"), _EXACT)
QUERIES["moving_avg_roundtrip"] = Query(_mismatches("average_back"), _EXACT)
QUERIES["fire_encode"] = Query(lambda spark, d: R.forecast_series(events(spark, d), USER, "q").select("user_id", "event_id", "residual"), None)
QUERIES["binary_codec_roundtrip"] = Query(lambda spark, d: R.encode_series(events(spark, d), USER, ["q"]).select("user_id", "n_rows", "raw_bytes", "exact"), E + "SELECT user_id, count(*) AS n_rows, count(*) * 2 AS raw_bytes, true AS exact FROM e GROUP BY user_id")
QUERIES["byte_sizes"] = Query(lambda spark, d: R.encode_series(events(spark, d), USER, ["q"]).select("user_id", "packed_bytes", "bzip2_bytes"), None)

# ---- filters, block codes, learned and dynamic operators -------------------------------

_BIL = E + """, g AS (SELECT event_id, q, lag(q) OVER w AS a, lead(q) OVER w AS b, max(q) OVER p - min(q) OVER p AS span FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i), p AS (PARTITION BY user_id)),
t AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.25 * (1 - least(abs(q - a) / (span * 0.1 + 1e-10), 1)) END AS ta, CASE WHEN b IS NULL THEN 0 ELSE 0.25 * (1 - least(abs(q - b) / (span * 0.1 + 1e-10), 1)) END AS tb FROM g),
s AS (SELECT *, (0.5 * q + ta * coalesce(a, 0) + tb * coalesce(b, 0)) / (0.5 + ta + tb) AS smooth FROM t)
"""
_simple("bilateral", lambda e: learned.bilateral(e, USER, "q").select("event_id", F.round("smooth", 3).alias("smooth")), _BIL + "SELECT event_id, round(smooth, 3) AS smooth FROM s")
_simple("clamp_change", lambda e: learned.bilateral(e, USER, "q").select("event_id", F.round(learned.clamp_change(USER, "q", "smooth"), 3).alias("x")), _BIL + "SELECT event_id, round(q + greatest(-0.005 * (span + 1e-10), least(0.005 * (span + 1e-10), smooth - q)), 3) AS x FROM s")
_simple("block_hash_family", lambda e: learned.block_arrays(e, USER, "q").select("user_id", "block", *[f(F.col("values")).cast("bigint").alias(n) for n, f in learned.BLOCK_HASHES.items()]),
        E + """, a AS (SELECT user_id, block, list(q ORDER BY pos) AS v FROM e GROUP BY user_id, block HAVING count(*) = 8), m AS (SELECT user_id, block, sum(CASE WHEN q < mean THEN power(2, pos) ELSE 0 END) AS c FROM (SELECT *, avg(q) OVER (PARTITION BY user_id, block) AS mean FROM e) GROUP BY user_id, block)
SELECT user_id, block, CAST(c AS BIGINT) AS below_mean, v[8] // 256 AS leading, CAST(v[8] // 8192 + CASE WHEN v[1] <= v[8] THEN 8 ELSE 0 END AS BIGINT) AS bits_shape, v[8] // 1024 - (v[8] // 1024) % 8 + v[1] // 8192 AS first_last, CAST(floor((v[8] - v[1]) / 256) AS BIGINT) AS difference, CAST(floor((v[8] - v[1]) / 1024) + 64 * (v[8] // 16384) AS BIGINT) AS difference_place FROM a JOIN m USING (user_id, block)""")  # fmt: skip
_simple("code_costs", lambda e: learned.code_costs(e, USER, "q"),
        E + f""", z AS (SELECT user_id, block, {ZZ.format("d1")} AS z FROM e), u AS (SELECT user_id, block, CAST(count(*) * max({NB.format("z")}) AS BIGINT) AS uniform FROM z GROUP BY user_id, block), r AS (SELECT user_id, block, k, sum((z >> CAST(k AS INT)) + 1 + k) * 100 + k AS m FROM z, (SELECT unnest(range(16)) AS k) GROUP BY user_id, block, k)
SELECT user_id, block, any_value(uniform) AS uniform, CAST(min(m) // 100 AS BIGINT) AS rice, CAST(min(m) % 100 AS INT) AS parameter FROM r JOIN u USING (user_id, block) GROUP BY user_id, block""")  # fmt: skip
_simple("one_tap_regression", lambda e: learned.one_tap(e, USER, "q"), E + ", o AS (SELECT user_id, d1 AS y, coalesce(lag(d1) OVER (PARTITION BY user_id ORDER BY i), 0) AS x FROM e), t AS (SELECT user_id, CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(x * x) AS BIGINT) AS sxx FROM o GROUP BY user_id) SELECT *, CAST(floor(sxy * 256 / sxx) AS BIGINT) AS coefficient FROM t")
_simple("codec_pipeline", lambda e: codecs.measure(e, USER, [codecs.Delta(["q"]), codecs.Zigzag(["q"])], "q"), E + f"SELECT user_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS mismatches, CAST(sum(CASE WHEN q = 0 THEN 0 ELSE length(bin(2 * q)) END) AS BIGINT) AS raw_bits, CAST(sum(CASE WHEN d1 = 0 THEN 0 ELSE length(bin(2 * ({ZZ.format('d1')}))) END) AS BIGINT) AS code_bits FROM e GROUP BY user_id")
_simple("mean_rank", lambda e: e.select("user_id", S.delta(USER, "q").alias("d1"), S.double_delta(USER, "q").alias("d2"), S.triple_delta(USER, "q").alias("d3")).groupBy("user_id").agg(*[F.sum(F.abs(c)).alias(c) for c in ("d1", "d2", "d3")]).select("user_id", F.inline(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(c).alias("loss")) for c in ("d1", "d2", "d3")])))
        .withColumn("r", F.rank().over(W.partitionBy("user_id").orderBy("loss"))).groupBy("predictor").agg(F.round(F.avg("r"), 6).alias("mean_rank")),
        E + ", l AS (SELECT user_id, sum(abs(d1)) AS d1, sum(abs(d2)) AS d2, sum(abs(d3)) AS d3 FROM e GROUP BY user_id), u AS (SELECT user_id, 'd1' AS predictor, d1 AS loss FROM l UNION ALL SELECT user_id, 'd2', d2 FROM l UNION ALL SELECT user_id, 'd3', d3 FROM l) SELECT predictor, round(avg(r), 6) AS mean_rank FROM (SELECT predictor, rank() OVER (PARTITION BY user_id ORDER BY loss) AS r FROM u) GROUP BY predictor")
_simple("least_step", lambda e: e.select("user_id", "q").distinct().withColumn("gap", F.col("q") - F.lag("q").over(W.partitionBy("user_id").orderBy("q"))).groupBy("user_id").agg(F.min("gap").alias("step")), "WITH d AS (SELECT DISTINCT user_id, CAST(round_even(value * 100, 0) AS BIGINT) AS q FROM events), g AS (SELECT user_id, q - lag(q) OVER (PARTITION BY user_id ORDER BY q) AS gap FROM d) SELECT user_id, min(gap) AS step FROM g GROUP BY user_id")


def _per_series(name: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, sql: str | None = None) -> None:
    QUERIES[name] = Query(lambda spark, d: learned.over_series(events(spark, d), USER, ["q"], f, schema), sql)


def _back(mismatches: Callable) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda p: pd.DataFrame({"n": [len(p)], "mismatches": [int(mismatches(p["q"].to_numpy()))]})


def _context_mismatches(x):
    residuals, used = learned.context_predict(x)
    return (learned.context_predict(residuals, decode=used)[0] != x).sum()


_EXACT_SERIES = E + "SELECT user_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM e GROUP BY user_id"
_per_series("context_roundtrip", _back(_context_mismatches), "n long, mismatches long", _EXACT_SERIES)
_per_series("rank_roundtrip", _back(lambda x: (learned.adaptive_ranks(learned.adaptive_ranks(x // 256), decode=True) != x // 256).sum()), "n long, mismatches long", _EXACT_SERIES)
_per_series("linearise_bounds", _back(lambda x: (abs(learned.linearise(x)[0] - x) > 0.002 * (x.max() - x.min()) + 1e-6).sum()), "n long, mismatches long", _EXACT_SERIES)
_per_series("best_placement", lambda p: pd.DataFrame({"at": learned.best_placement(p["q"].to_numpy() - 25_000, 4)}), "at long")
_per_series("greedy_matches", lambda p: pd.DataFrame({"at": learned.greedy_apart((p["q"].to_numpy() > 25_000).nonzero()[0], 3)}), "at long")
_per_series("piecewise_linear", lambda p: pd.DataFrame({"anchor": learned.piecewise_linear(p["q"].to_numpy(), 2e8)[0]}), "anchor long")
_per_series("zstd_loss", lambda p: pd.DataFrame({"bytes": [learned.zstd_size(p["q"].diff().fillna(0))]}), "bytes long")
QUERIES["kmeans_residuals"] = Query(lambda spark, d: learned.kmeans(vectors(spark, d), 8), None)
_simple("learned_filter", lambda e: e.select("event_id", F.round(S.fir(USER, "q", learned.learn_filter(e, USER, "q")), 3).alias("residual")), None)

def _codebook_mismatches(x):
    residuals, picks = adaptive.online_codebook(x)
    return (adaptive.online_codebook(residuals, picks=picks)[0] != x).sum()


for _how in ("sums", "gradient"):
    _per_series(f"online_regress_{_how}", _back(lambda x, how=_how: (adaptive.online_regress(adaptive.online_regress(x, how), how, decode=True) != x).sum()), "n long, mismatches long", _EXACT_SERIES)
_per_series("online_codebook", _back(_codebook_mismatches), "n long, mismatches long", _EXACT_SERIES)
_simple("nearest_earlier", lambda e: adaptive.nearest_earlier(e, USER, "q").select("user_id", "block", "back", F.array_join("residual", ",").alias("residual")),
        E + """, v AS (SELECT user_id, block, list(q ORDER BY pos) AS a FROM e GROUP BY user_id, block HAVING count(*) = 8),
c AS (SELECT user_id, block, 0 AS back, a AS r FROM v UNION ALL SELECT n.user_id, n.block, n.block - o.block, [n.a[k] - o.a[k] FOR k IN range(1, 9)] FROM v n JOIN v o ON n.user_id = o.user_id AND o.block BETWEEN n.block - 16 AND n.block - 1)
SELECT user_id, block, back, array_to_string(r, ',') AS residual FROM (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY list_sum([abs(x) FOR x IN r]), back) AS p FROM c) WHERE p = 1""")  # fmt: skip
_simple("filter_bank", lambda e: adaptive.filter_bank(e, USER, "q")[0].select("user_id", "block", "filter", F.round("error", 2).alias("error")), None)
QUERIES["synthetic_walks"] = Query(lambda spark, d: synthetic.walks(spark, 16, 256), None)
QUERIES["synthetic_sines"] = Query(lambda spark, d: synthetic.sines(spark, 16, 256, warp=0.2), None)
QUERIES["synthetic_shapes"] = Query(lambda spark, d: synthetic.shapes(spark, 30), None)
QUERIES["synthetic_bits"] = Query(lambda spark, d: synthetic.uniform_bits(spark, 16, 256), None)

# ---- Spark's own operators, beyond the series ------------------------------------------

QUERIES["cube_counts"] = Query(lambda spark, d: table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
QUERIES["semi_join"] = Query(lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
QUERIES["anti_join"] = Query(lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
QUERIES["set_except"] = Query(lambda spark, d: table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
QUERIES["set_intersect"] = Query(lambda spark, d: table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")

from tidemark.plans import sequences  # noqa: E402, F401  (registers its queries)
