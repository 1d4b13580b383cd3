"""The packed byte format: zigzagged residuals of 8-bit or 16-bit columns in groups of two blocks of eight rows.

Header (8 bytes): groups as uint32, values after the last group as uint16, columns as uint16. A
group has the widths of its two blocks (3 bits a column at 8-bit values, 4 at 16-bit), then their
payloads. Payload of a block, row-major: each row's fields one after another, rows padded to
bytes; column-major: the eight values of each column in one piece. A width of one less than a
whole byte is raised to it. Blocks of zeros are counted: a run takes the place of one block, its
length follows in one or two bytes (7 bits, then 8). Values behind the last full group are raw, as is
an input of under 128 values.

Series are encoded by key, one in one task; payloads are decoded and queried batch by batch.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.operators.recurrences import _wrap, as_dtype, forecast
from tidemark.operators.series import Series

BLOCK, GROUP, LONGEST_RUN, LEAST = 8, 2, 0x7FFF, 128
PREDICTORS = ("raw", "delta", "adaptive")


def residuals(x: np.ndarray, bits: int, predictor: str, truncate: bool = True) -> np.ndarray:
    """Codes without a sign of rows x columns: the values themselves, or zigzagged residuals of a predictor."""
    if predictor == "raw":
        return x.astype(np.uint64)
    r = _wrap(np.diff(x, axis=0, prepend=np.zeros((1, x.shape[1]), np.int64)), bits) if predictor == "delta" else forecast(x, bits, truncate=truncate)
    return ((r << 1) ^ (r >> 63)).astype(np.uint64)


def restore(z: np.ndarray, bits: int, predictor: str, truncate: bool = True) -> np.ndarray:
    if predictor == "raw" or not len(z):
        return z.astype(np.int64)
    r = (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)
    return np.cumsum(r, 0) & ((1 << bits) - 1) if predictor == "delta" else forecast(r, bits, truncate=truncate, decode=True)


def widths(z: np.ndarray) -> np.ndarray:
    """Stored bits of each column in each full block of z."""
    most = np.bitwise_or.reduce(z.reshape(-1, BLOCK, z.shape[1]), 1)
    w = np.frompyfunc(int.bit_length, 1, 1)(most.astype(object)).astype(np.int64) if most.size else np.zeros(most.shape, np.int64)
    return w + (w % 8 == 7)


def _bits(fields: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The low bits of fields, one after another, least first: a row for each value."""
    return np.concatenate([(v[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1) for v, w in fields], 1).astype(np.uint8) if fields else np.zeros((BLOCK, 0), np.uint8)


def pack_block(z: np.ndarray, w: list[int], column_major: bool) -> bytes:
    """The payload of one block (8 rows) at the given widths."""
    fields = [(z[:, j], n) for j, n in enumerate(w) if n]
    if column_major:
        return b"".join(np.packbits(_bits([f]).ravel(), bitorder="little").tobytes() for f in fields)
    return np.packbits(_bits(fields), axis=1, bitorder="little").tobytes()


def unpack_block(data: bytes, at: int, w: list[int], column_major: bool) -> tuple[np.ndarray, int]:
    """The block at `at` and where it ends."""
    size = sum(w) if column_major else BLOCK * (-(-sum(w) // 8))
    flags = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").astype(np.uint64)
    z, place = np.zeros((BLOCK, len(w)), np.uint64), 0
    rows = flags if column_major else flags.reshape(BLOCK, -1)
    for j, n in enumerate(w):
        own = rows[BLOCK * place : BLOCK * (place + n)].reshape(BLOCK, n) if column_major else rows[:, place : place + n]
        z[:, j] = (own << np.arange(n, dtype=np.uint64)).sum(1)
        place += n
    return z, at + size


def low_dimensional(columns: int, bits: int) -> bool:
    return columns <= (4 if bits == 8 else 2)


def encode(x: np.ndarray, bits: int = 8, predictor: str = "delta", column_major: bool | None = None) -> bytes:
    """Rows x columns of unsigned values as bytes. column_major: as the number of columns says, if not given."""
    x = np.asarray(x, np.int64)
    x = x[:, None] if x.ndim == 1 else x
    n, d = x.shape
    raw = x.astype("<u1" if bits == 8 else "<u2")
    if n * d < LEAST:
        return struct.pack("<IHH", 0, n * d, d) + raw.tobytes()
    column_major = low_dimensional(d, bits) if column_major is None else column_major
    z = residuals(x[: n // BLOCK * BLOCK], bits, predictor, not column_major)
    w, field = widths(z), 3 if bits == 8 else 4
    out, groups, block, run = bytearray(), 0, 0, 0
    last = n - GROUP * BLOCK  # the last row at which a group may begin
    heads: list[list[int]] = []
    body = bytearray()

    def close() -> None:
        """Ends a group: its widths, then what it holds."""
        nonlocal groups, body, heads
        groups += 1
        zeros = [[0] * d] * (GROUP - len(heads))
        codes = np.array([v - (v == bits) for h in heads + zeros for v in h], np.uint64)
        out.extend(np.packbits(_bits([(codes, field)]).ravel(), bitorder="little").tobytes() + body)
        heads, body = [], bytearray()

    def end_run() -> None:
        nonlocal run
        body.extend(bytes([run]) if run < 128 else bytes([run & 0x7F | 0x80, run >> 7]))
        heads.append([0] * d)
        run = 0

    while block * BLOCK <= last or run:
        if not w[block].any() and run < LONGEST_RUN:
            run += 1
            block += 1
            if block * BLOCK < last:
                continue
            end_run()
            body.extend(bytes(GROUP - len(heads)))
            break
        if run:
            end_run()
            if len(heads) == GROUP:
                close()
            continue
        heads.append(w[block].tolist())
        body.extend(pack_block(z[BLOCK * block : BLOCK * (block + 1)], heads[-1], column_major))
        block += 1
        if len(heads) == GROUP:
            close()
        elif block * BLOCK > last:  # a group that is begun is finished
            last += BLOCK
    if heads:
        close()
    tail = raw[block * BLOCK :]
    return struct.pack("<IHH", groups, tail.size, d) + bytes(out) + tail.tobytes()


def decode(data: bytes, bits: int = 8, predictor: str = "delta", column_major: bool | None = None) -> np.ndarray:
    """The rows that `encode` took."""
    groups, rest, d = struct.unpack_from("<IHH", data)
    column_major = low_dimensional(d, bits) if column_major is None else column_major
    field, at, parts = 3 if bits == 8 else 4, 8, []
    for _ in range(groups):
        size = -(-GROUP * d * field // 8)
        flags = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: GROUP * d * field].reshape(GROUP, d, field)
        codes = (flags.astype(np.int64) << np.arange(field)).sum(2)
        at += size
        for w in (codes + (codes == bits - 1)).tolist():
            if any(w):
                z, at = unpack_block(data, at, w, column_major)
                parts.append(z)
                continue
            run, at = data[at], at + 1
            if run & 0x80:
                run, at = run & 0x7F | data[at] << 7, at + 1
            parts.append(np.zeros((BLOCK * run, d), np.uint64))
    kind = "<u1" if bits == 8 else "<u2"
    tail = np.frombuffer(data, kind, rest, at).reshape(-1, d).astype(np.int64)
    z = np.concatenate(parts) if parts else np.zeros((0, d), np.uint64)
    return np.concatenate((restore(z, bits, predictor, not column_major), tail))


def encode_columns(df: DataFrame, s: Series, columns: list[str], bits: int = 8, predictor: str = "delta") -> DataFrame:
    """keys, n_rows, payload of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(s.order))[columns].to_numpy(np.int64)
        return pd.DataFrame([[*pdf[list(s.keys)].iloc[0], len(x), encode(x, bits, predictor)]], columns=[*s.keys, "n_rows", "payload"])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in s.keys)
    return df.select(*dict.fromkeys((*s.keys, *s.order, *columns))).groupBy(*s.keys).applyInPandas(run, f"{keys}, n_rows long, payload binary")


def decode_columns(packed: DataFrame, keys: tuple[str, ...], columns: list[str], bits: int = 8, predictor: str = "delta") -> DataFrame:
    """keys, i, columns: one buffer to many rows, in batches."""
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = decode(batch.column("payload")[row].as_py(), bits, predictor)
                own = [pa.repeat(batch.column(k)[row], len(x)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(x))), *(pa.array(x[:, j]) for j in range(len(columns)))], names=[*keys, "i", *columns])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "i long", *(f"{c} long" for c in columns)])
    return packed.select(*keys, "payload").mapInArrow(run, schema)


#: Queries on packed data: value of a batch of rows, and how two values join.
OPS = {"max": (lambda x: x.max(0), np.maximum), "min": (lambda x: x.min(0), np.minimum), "sum": (lambda x: x.sum(0), np.add), "count": (lambda x: np.full(x.shape[1], len(x)), np.add)}


def query_packed(packed: DataFrame, keys: tuple[str, ...], columns: list[str], ops: tuple = ("max", "sum"), bits: int = 8, predictor: str = "delta") -> DataFrame:
    """keys and `op`_`column` of each payload; the values of a payload are never rows of a table. ops: names in OPS, or (name, f) with f from rows x columns to one number a column."""
    todo = [(o, OPS[o][0]) if isinstance(o, str) else o for o in ops]
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}

    def run(batches):
        for batch in batches:
            rows = [[f(decode(p, bits, predictor)) for _, f in todo] for p in batch.column("payload").to_pylist()]
            cells = [pa.array([int(r[k][j]) for r in rows], pa.int64()) for k in range(len(todo)) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cells], names=[*keys, *(f"{o}_{c}" for o, _ in todo for c in columns)])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{o}_{c} long" for o, _ in todo for c in columns)])
    return packed.select(*keys, "payload").mapInArrow(run, schema)


# ---- raw binary --------------------------------------------------------------------------


def write_simple(x: np.ndarray, bits: int = 8) -> bytes:
    """Length as uint32 and columns as uint16, then the values."""
    return struct.pack("<IH", x.size, x.shape[1]) + x.astype("<u1" if bits == 8 else "<u2").tobytes()


def read_simple(data: bytes, bits: int = 8) -> np.ndarray:
    size, d = struct.unpack_from("<IH", data)
    return np.frombuffer(data, "<u1" if bits == 8 else "<u2", size, 6).reshape(-1, d).astype(np.int64)


def raw_columns(df: DataFrame, s: Series, columns: list[str], dtype: str = "<u2", column_major: bool = False) -> DataFrame:
    """keys, payload: each series as bare values, rows or columns one after another. A value that dtype (if of integers) does not hold is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(s.order))[columns].to_numpy()
        return pd.DataFrame([[*pdf[list(s.keys)].iloc[0], as_dtype(x.T if column_major else x, dtype).tobytes()]], columns=[*s.keys, "payload"])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in s.keys)
    return df.select(*dict.fromkeys((*s.keys, *s.order, *columns))).groupBy(*s.keys).applyInPandas(run, f"{keys}, payload binary")


def read_raw(spark, path: str, columns: list[str], dtype: str = "<u2", column_major: bool = False) -> DataFrame:
    """path, i, columns of the raw files under a folder, read by Spark's binary file source."""
    schema = ", ".join(["path string", "i long", *(f"{c} double" for c in columns)])

    def run(batches):
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                x = x.reshape(len(columns), -1).T if column_major else x.reshape(-1, len(columns))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(x), pa.string()), pa.array(np.arange(len(x))), *(pa.array(x[:, j].astype(float)) for j in range(len(columns)))], names=["path", "i", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
