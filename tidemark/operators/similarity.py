"""Vector distances and neighbour search: queries in blocks against all rows.

Queries are a stated set and are sent to all rows in blocks of a bounded number of bytes; per query
the least distances are kept by a partial top-k before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def hamming(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is all zeros."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def correlation(a: Column, b: Column) -> Column:
    """The cosine of both less their means; 0 if either is constant."""
    centred = lambda v: F.transform(v.cast("array<double>"), lambda x: x - F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, y: s + y) / F.size(v))
    return cosine(centred(a), centred(b))


MEASURES = {"correlation": correlation, "squared": squared, "manhattan": manhattan, "dot": dot, "hamming": hamming, "cosine": cosine}


def distances(rows: DataFrame, queries: DataFrame, measure: str = "squared", block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, id, dist of rows (id, vec) against queries (id, vec). Queries of more than block_bytes go in blocks, each in a broadcast of its own."""
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    size = q.agg(F.sum(F.size("query") * 8 + 32).alias("b")).first().b or 0
    blocks = -(-size // block_bytes) or 1
    parts = [q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [q]
    out = None
    for part in parts:
        found = rows.join(F.broadcast(part), F.lit(True)).select("query_id", "id", MEASURES[measure](F.col("vec"), F.col("query")).alias("dist"))
        out = found if out is None else out.unionByName(found)
    return out


def nearest(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), id, dist of the k least distances of each query; of equal ones the lesser id. Spark cuts to k rows in each task before the shuffle."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)


def within(found: DataFrame, radius: float, inclusive: bool = False) -> DataFrame:
    return found.where(F.col("dist") <= radius if inclusive else F.col("dist") < radius)
