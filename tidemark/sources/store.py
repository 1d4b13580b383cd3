"""A store of tables by id: one Parquet dataset partitioned by id, with upsert, column pruning, removal and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """Tables `name` under a folder that all executors share. A table is replaced as a whole."""

    FORMATS = ("parquet", "orc", "json", "csv")

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", compression: str | None = None) -> None:
        if fmt not in self.FORMATS:
            raise ValueError(f"format {fmt} is none of {self.FORMATS}")
        self.spark, self.root, self.fmt, self.compression = spark, root.rstrip("/"), fmt, compression

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, name: str) -> str:
        if "/" in name or name.startswith((".", "_")):
            raise ValueError(f"bad table name {name}")
        return f"{self.root}/{name}"

    def ids(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().startswith("_")) if fs.exists(path) else []

    def __len__(self) -> int:
        return len(self.ids())

    def read(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The table, or those of the columns that it has."""
        df = self.spark.read.format(self.fmt).options(header=True, inferSchema=True).load(self._path(name))
        return df if columns is None else df.select([c for c in columns if c in df.columns])

    def write(self, name: str, df: DataFrame) -> None:
        writer = df.write.format(self.fmt).mode("overwrite").option("header", True)
        if self.compression:
            writer = writer.option("compression", self.compression)
        fs, _ = self._fs()
        # Written aside first, so that a table may be replaced by what is read from it.
        writer.save(f"{self.root}/_new_{name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        # The old table goes last: at any time one of the three folders is whole.
        old, own = at(f"{self.root}/_old_{name}"), at(self._path(name))
        if fs.exists(own):
            fs.delete(old, True)
            fs.rename(own, old)
        fs.rename(at(f"{self.root}/_new_{name}"), own)
        fs.delete(old, True)

    def upsert_columns(self, name: str, keys: Sequence[str], df: DataFrame) -> None:
        """Replace or add the columns of df, joined by keys; rows that only one of both has get nulls in the other's columns."""
        new = [c for c in df.columns if c not in keys]
        old = self.read(name).drop(*new)
        self.write(name, old.join(df, list(keys), "full"))

    def remove(self, name: str, columns: Sequence[str] | None = None) -> None:
        if columns is None:
            fs, _ = self._fs()
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name)), True)
        else:
            self.write(name, self.read(name).drop(*columns))

    def ingest_csv(self, folder: str) -> list[str]:
        """Every .csv file of a folder as a table of its name."""
        fs, _ = self._fs()
        files = [s.getPath() for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().endswith(".csv")]
        for f in files:
            self.write(f.getName()[:-4], self.spark.read.csv(f.toString(), header=True, inferSchema=True))
        return sorted(f.getName()[:-4] for f in files)

    def file_sizes(self) -> DataFrame:
        """id, nbytes on disk."""
        fs, _ = self._fs()
        rows = [(i, fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(i))).getLength()) for i in self.ids()]
        return self.spark.createDataFrame(rows, "id string, nbytes long")

    def copy_to(self, other: TableStore) -> None:
        for i in self.ids():
            other.write(i, self.read(i))

    def equals(self, other: TableStore) -> bool:
        """Equal ids, columns and rows (in any order)."""
        if self.ids() != other.ids():
            return False
        return all(same_rows(self.read(i), other.read(i)) for i in self.ids())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def all_close(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    """Equal nulls, and numbers within atol + rtol * abs(b), row by row of equal keys."""
    both = a.select(*keys, F.col(column).alias("x")).join(b.select(*keys, F.col(column).alias("y")), list(keys), "full")
    close = F.col("x").eqNullSafe(F.col("y")) | F.coalesce(F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y"), F.lit(False))
    return both.where(~close).isEmpty()
