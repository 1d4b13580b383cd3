"""Session helpers: the shared folder, written tables and their removal, checked broadcasts, joins that hot keys don't stop."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may be broadcast, by count and by measured bytes; beyond it a table is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Keys that may count as hot in one join. Keys with over 1 / HOT_KEYS of all rows are fewer than that.
HOT_KEYS = 100_000
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. An enclosing `scratch` removes it, if it is not to be kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes and not keep:
        _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch():
    """Tables written inside are removed at the end, but for those to keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(F.transform(value, lambda x: _bytes_of(x, kind.elementType).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        return 24 + F.coalesce(inner, F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of df, by partial sums in every task."""
    row = df.agg(F.count("*").alias("n"), F.sum(sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8)).cast("long")).alias("b")).first()
    return row.n, row.b or 0


def is_small(df: DataFrame) -> bool:
    n, size = measured(df)
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Broadcast df if it is measured to be small in rows and bytes, else leave it to a shuffle join. df should be written or cheap: it is read once more for that."""
    return F.broadcast(df) if is_small(df) else df


def lookup(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to found (one row for each key, with `n`: how many of rows have it), without `n`. total: how many rows there are.

    A small table is broadcast. Of a larger one only the keys of many rows are: there are fewer than HOT_KEYS of them,
    and their rows stay where they are; all other keys are spread by a shuffle.
    """
    if is_small(found):
        return rows.join(F.broadcast(found.drop("n")), key)
    most = max(10_000, total // HOT_KEYS)
    hot = F.broadcast(found.where(F.col("n") > most).drop("n"))
    cold = rows.join(F.broadcast(found.where(F.col("n") > most).select(key)), key, "left_anti").join(found.where(F.col("n") <= most).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
