"""Invertible column codecs, pipelines of them, and their sizes.

A codec picks columns by name and type, replaces them by codes, and gives a small header (a
dict) that its decoder needs. Encoders and decoders are column expressions, so a pipeline is
one plan; a codec that has to look at data first (`Quantise`) adds one aggregation. Nulls stay
null in all codecs but the differences, which are meant for columns without nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import bits
from tidemark.operators import series as S
from tidemark.operators.recurrences import as_dtype

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
#: Keywords that select columns by type.
KINDS: dict[str, Callable[[T.StructField], bool]] = {
    "numeric": lambda f: isinstance(f.dataType, INTS + FLOATS),
    "anyint": lambda f: isinstance(f.dataType, INTS),
    "signedint": lambda f: isinstance(f.dataType, INTS),
    "unsignedint": lambda f: False,  # Spark has none
    "anyfloat": lambda f: isinstance(f.dataType, FLOATS),
    "complex": lambda f: False,
    "nullable": lambda f: f.nullable,
    "nonnullable": lambda f: not f.nullable,
}


def select_columns(df: DataFrame, columns: Sequence[str] | None = None, allow: Sequence = (), deny: Sequence = ()) -> list[str]:
    """Names of df, sorted, that are among `columns` (None: all), of no kind in deny and of some kind in allow (empty: any). A kind is a keyword or a test of a field."""
    match = lambda f, kinds: any(k(f) if callable(k) else KINDS[k](f) for k in kinds)
    fields = [f for f in df.schema if columns is None or f.name in columns]
    return sorted(f.name for f in fields if not match(f, deny) and (not allow or match(f, allow)))


class Codec:
    """Base of all codecs: subclasses give `forward` and `backward`, and `train` if they look at data."""

    allow: tuple = ("numeric",)
    deny: tuple = ()

    def __init__(self, columns: Sequence[str] | None = None):
        self.columns = columns

    def train(self, df: DataFrame, s: S.Series, names: list[str]) -> dict:
        return {}

    def forward(self, s: S.Series, name: str, header: dict) -> Column:
        raise NotImplementedError

    def steps_back(self, s: S.Series, name: str, header: dict) -> list[Column]:
        """Columns that undo `forward`, one applied after another."""
        raise NotImplementedError

    def encode(self, df: DataFrame, s: S.Series) -> tuple[DataFrame, dict]:
        names = [n for n in select_columns(df, self.columns, self.allow, self.deny) if n not in s.keys + s.order]
        header = {"columns": names, "types": {n: df.schema[n].dataType.simpleString() for n in names}, **self.train(df, s, names)}
        return df.withColumns({n: self.forward(s, n, header) for n in names}) if names else df, header

    def decode(self, df: DataFrame, s: S.Series, header: dict) -> DataFrame:
        steps = {n: self.steps_back(s, n, header) for n in header["columns"]}
        for k in range(max(map(len, steps.values()), default=0)):
            df = df.withColumns({n: c[k] for n, c in steps.items()})
        return df.withColumns({n: F.col(n).cast(header["types"][n]) for n in steps}) if steps else df


class Delta(Codec):
    allow = ("anyint",)

    def forward(self, s, name, header):
        return S.delta(s, name)

    def steps_back(self, s, name, header):
        return [S.undo_delta(s, name)]


class DoubleDelta(Codec):
    allow = ("anyint",)

    def forward(self, s, name, header):
        return S.double_delta(s, name)

    def steps_back(self, s, name, header):
        return [S.undo_delta(s, name), S.undo_delta(s, name)]


class Zigzag(Codec):
    allow = ("anyint",)

    def forward(self, s, name, header):
        return bits.zigzag(F.col(name).cast("bigint"))

    def steps_back(self, s, name, header):
        return [bits.unzigzag(F.col(name))]


class Quantise(Codec):
    """Codes of floats; offset and scale are given for a column or inferred from its data."""

    allow = ("anyfloat",)

    def __init__(self, columns=None, params: dict[str, tuple[float, float]] | None = None):
        super().__init__(columns)
        self.params = params or {}

    def train(self, df, s, names):
        found = dict(self.params)
        for n in names:
            if n not in found:
                row = S.infer_quantisation(df.select(n), n).first()
                found[n] = (float(row["offset"]) if row["offset"] is not None else 0.0, float(row["scale"] or 1))
        return {"params": {n: found[n] for n in names}}

    def forward(self, s, name, header):
        return S.quantise(F.col(name), *header["params"][name])

    def steps_back(self, s, name, header):
        return [S.dequantise(F.col(name), *header["params"][name])]


class ColumnSum(Codec):
    """Residual of one integer column from a weighted sum of others, which stay as they are."""

    def __init__(self, target: str, weights: dict[str, int]):
        super().__init__([target])
        self.weights = weights

    def _sum(self) -> Column:
        return sum((F.col(c) * w for c, w in self.weights.items()), F.lit(0))

    def forward(self, s, name, header):
        return F.col(name) - self._sum()

    def steps_back(self, s, name, header):
        return [F.col(name) + self._sum()]


class Lambda(Codec):
    """A user's own pair of column functions."""

    allow = ()

    def __init__(self, encode: Callable[[Column], Column], decode: Callable[[Column], Column], columns: Sequence[str]):
        super().__init__(columns)
        self.pair = encode, decode

    def forward(self, s, name, header):
        return self.pair[0](F.col(name))

    def steps_back(self, s, name, header):
        return [self.pair[1](F.col(name))]


def encode(df: DataFrame, s: S.Series, codecs: Sequence[Codec]) -> tuple[DataFrame, list[dict]]:
    headers = []
    for c in codecs:
        df, header = c.encode(df, s)
        headers.append(header)
    return df, headers


def decode(df: DataFrame, s: S.Series, codecs: Sequence[Codec], headers: Sequence[dict]) -> DataFrame:
    for c, header in reversed(list(zip(codecs, headers, strict=True))):
        df = c.decode(df, s, header)
    return df


def measure(df: DataFrame, s: S.Series, codecs: Sequence[Codec], column: str) -> DataFrame:
    """keys, n_rows, mismatches after a round trip, raw_bits and code_bits (least bits of zigzagged values and of codes) of an integer column."""
    coded, headers = encode(df.withColumn("__raw", F.col(column)), s, [c for c in codecs])
    back = decode(coded.withColumn("__code", F.col(column)), s, codecs, headers)
    size = lambda c: F.sum(bits.bit_length(bits.zigzag(F.col(c).cast("bigint")))).cast("bigint")
    return back.groupBy(*s.keys).agg(F.count("*").alias("n_rows"), F.count_if(~F.col(column).eqNullSafe(F.col("__raw"))).alias("mismatches"), size("__raw").alias("raw_bits"), size("__code").alias("code_bits"))


class LearnedSum(ColumnSum):
    """Residual of an integer column from a weighted sum of others, whose weights (in 256ths) are the least-squares ones: one aggregation."""

    def __init__(self, target: str, sources: Sequence[str]):
        super().__init__(target, dict.fromkeys(sources, 0))

    def train(self, df, s, names):
        import numpy as np

        xs = list(self.weights)
        cells = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{a}*{b}") for a in xs for b in (*xs, *self.columns)]
        row = df.agg(*cells).first()
        m = np.array([[row[f"{a}*{b}"] or 0.0 for b in xs] for a in xs])
        y = np.array([row[f"{a}*{self.columns[0]}"] or 0.0 for a in xs])
        w = np.linalg.lstsq(m, y, rcond=None)[0]
        return {"weights": {c: int(round(256 * v)) for c, v in zip(xs, w, strict=True)}}

    def _guess(self, header: dict) -> Column:
        return F.floor(sum((F.col(c) * w for c, w in header["weights"].items()), F.lit(0)) / 256).cast("bigint")

    def forward(self, s, name, header):
        return F.col(name) - self._guess(header)

    def steps_back(self, s, name, header):
        return [F.col(name) + self._guess(header)]


class Best(Codec):
    """For each column the pipeline (a sequence of codecs on it) of least loss, the first of equal ones; all losses come from one aggregation. The header names the choice."""

    allow = ("anyint",)

    def __init__(self, pipelines: dict[str, Callable[[list[str]], Sequence[Codec]]], columns=None, loss: str = "l1"):
        super().__init__(columns)
        self.pipelines, self.loss = pipelines, loss

    def encode(self, df, s):
        names = [n for n in select_columns(df, self.columns, self.allow, self.deny) if n not in s.keys + s.order]
        copies = df.select(*dict.fromkeys((*s.keys, *s.order)), *[F.col(n).alias(f"{n}__{p}") for n in names for p in self.pipelines])
        for n in names:
            for p, make in self.pipelines.items():
                copies, _ = encode(copies, s, make([f"{n}__{p}"]))
        row = copies.agg(*[S.LOSSES[self.loss](F.col(f"{n}__{p}")).alias(f"{n}__{p}") for n in names for p in self.pipelines]).first() if names else {}
        chosen = {n: min(self.pipelines, key=lambda p: (row[f"{n}__{p}"] or 0, list(self.pipelines).index(p))) for n in names}
        headers = {}
        for n, p in chosen.items():
            df, headers[n] = encode(df, s, self.pipelines[p]([n]))
        return df, {"columns": names, "choice": chosen, "headers": headers}

    def decode(self, df, s, header):
        for n, p in reversed(header["choice"].items()):
            df = decode(df, s, self.pipelines[p]([n]), header["headers"][n])
        return df


class SeriesBytes:
    """A series' column as compressed bytes: shuffled by byte or not, then bzip2, zstd or nothing. `encode` gives keys, n_rows, payload; `decode` keys, i and the column. A value that dtype (if of integers) does not hold is an error."""

    def __init__(self, column: str, how: str = "zstd", shuffle: bool = True, dtype: str = "<i8"):
        if how not in ("none", "bzip2", "zstd"):
            raise ValueError(how)
        self.column, self.how, self.shuffle, self.dtype = column, how, shuffle, dtype

    def pack(self, x) -> bytes:
        import bz2

        import numpy as np

        raw = as_dtype(x, self.dtype)
        data = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes() if self.shuffle else raw.tobytes()
        if self.how == "zstd":
            import zstandard

            return zstandard.ZstdCompressor().compress(data)
        return bz2.compress(data) if self.how == "bzip2" else data

    def unpack(self, data: bytes):
        import bz2

        import numpy as np

        if self.how == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompress(data)
        elif self.how == "bzip2":
            data = bz2.decompress(data)
        size = np.dtype(self.dtype).itemsize
        raw = np.frombuffer(data, np.uint8)
        return np.ascontiguousarray(raw.reshape(size, -1).T if self.shuffle else raw.reshape(-1, size)).view(self.dtype).ravel()

    def encode(self, df: DataFrame, s: S.Series) -> DataFrame:
        import pandas as pd

        def run(pdf):
            x = pdf.sort_values(list(s.order))[self.column].to_numpy()
            return pd.DataFrame([[*pdf[list(s.keys)].iloc[0], len(x), self.pack(x)]], columns=[*s.keys, "n_rows", "payload"])

        keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in s.keys)
        return df.select(*dict.fromkeys((*s.keys, *s.order, self.column))).groupBy(*s.keys).applyInPandas(run, f"{keys}, n_rows long, payload binary")

    def decode(self, packed: DataFrame, s: S.Series) -> DataFrame:
        import pandas as pd

        def run(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    x = self.unpack(row.payload)
                    yield pd.DataFrame({**{k: [getattr(row, k)] * len(x) for k in s.keys}, "i": range(len(x)), self.column: x.astype("int64")})

        keys = ", ".join(f"{k} {packed.schema[k].dataType.simpleString()}" for k in s.keys)
        return packed.select(*s.keys, "payload").mapInPandas(run, f"{keys}, i long, {self.column} long")
