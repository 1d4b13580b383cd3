"""Synthetic series. Every draw is a hash of (seed, series, place), so rows do not depend on partitions and lost ones come back equal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sum(x: Column | str) -> Column:
    """Running sum of a series."""
    return F.sum(x).over(W.partitionBy("series").orderBy("i"))


def grid(spark: SparkSession, n_series: int, length: int) -> DataFrame:
    """series, i of each sample."""
    return spark.range(n_series * length).select(F.expr(f"id div {length}").alias("series"), (F.col("id") % length).alias("i"))


def uniform(seed: int, *columns: str) -> Column:
    """In [0, 1), a function of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def normal(seed: int, *columns: str) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *columns))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *columns))


def walks(spark: SparkSession, n_series: int, length: int, seed: int = 123) -> DataFrame:
    """series, i, x: sums of normal steps."""
    return grid(spark, n_series, length).select("series", "i", _sum(normal(seed, "series", "i")).alias("x"))


def sines(spark: SparkSession, n_series: int, length: int, period: float = 32, warp: float = 0.0, noise: float = 0.1, seed: int = 123) -> DataFrame:
    """series, i, x: a sine of random phase and normal noise; its time runs as a power of the place with an exponent of 1 +- warp at most."""
    power = 1 + warp * (2 * uniform(seed + 1, "series") - 1)
    at = F.pow(F.col("i") / length, power) * (length / period) + uniform(seed, "series")
    return grid(spark, n_series, length).select("series", "i", (F.sin(2 * math.pi * at) + noise * normal(seed + 2, "series", "i")).alias("x"))


def shapes(spark: SparkSession, n_series: int, length: int = 128, seed: int = 123) -> DataFrame:
    """series, i, label, x: a cylinder, bell or funnel of height 6 with normal noise, between a (an eighth to a quarter of the length) and b (a quarter to three quarters of it later)."""
    label = F.col("series") % 3
    a = F.lit(length / 8) * (1 + uniform(seed, "series"))
    width = F.lit(length / 4) * (1 + 2 * uniform(seed + 1, "series"))
    rows = grid(spark, n_series, length).withColumns({"label": label, "at": (F.col("i") - a) / width})
    form = F.when(F.col("label") == 0, F.lit(1.0)).when(F.col("label") == 1, F.col("at")).otherwise(1 - F.col("at"))
    shape = F.when(F.col("at").between(0, 1), (6 + normal(seed + 2, "series")) * form).otherwise(F.lit(0.0))
    return rows.select("series", "i", "label", (shape + normal(seed + 3, "series", "i")).alias("x"))


def with_motifs(df: DataFrame, every: int, motif: DataFrame) -> DataFrame:
    """df (series, i, x) with motif (at, x) laid over the beginning of each stretch of `every` samples. The motif is no longer than a stretch."""
    laid = df.withColumn("at", F.col("i") % every).join(F.broadcast(motif.select("at", F.col("x").alias("__m")).where(F.col("at") < every)), "at", "left")
    return laid.select("series", "i", F.coalesce("__m", "x").alias("x"))


def uniform_bits(spark: SparkSession, n_series: int, length: int, most: int = 8, block: int = 8, seed: int = 123) -> DataFrame:
    """series, i, bits, delta, x: each block has a random width of 0 to `most` bits, its deltas are uniform in it, and x is their sum modulo 2**most."""
    rows = grid(spark, n_series, length).withColumn("block", F.expr(f"i div {block}"))
    rows = rows.withColumn("bits", F.floor(uniform(seed, "series", "block") * (most + 1)).cast("int"))
    z = F.floor(uniform(seed + 1, "series", "i") * F.pow(F.lit(2.0), F.col("bits"))).cast("bigint")
    rows = rows.withColumn("z", z).withColumn("delta", F.when(F.col("z") % 2 == 1, -F.expr("(z + 1) div 2")).otherwise(F.expr("z div 2")))
    return rows.select("series", "i", "bits", "delta", F.pmod(_sum("delta"), F.lit(1 << most)).alias("x"))
