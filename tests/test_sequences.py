"""Sequence functions, packed bytes, predictors and streams against stated values and round trips."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import codecs, layout
from tidemark.operators import predictors as P
from tidemark.operators import recurrences as R
from tidemark.operators import sequences as Q
from tidemark.operators import similarity as N
from tidemark.operators.series import Series
from tidemark.plans import catalogue as C
from tidemark.sources.store import TableStore
from tidemark.streaming import online

SIZES = (0, 1, 7, 8, 15, 16, 17, 31, 33, 64, 71, 127, 128, 129, 135, 300)


@pytest.mark.parametrize("bits", (8, 16))
@pytest.mark.parametrize("predictor", layout.PREDICTORS)
def test_packed_bytes_come_back(bits, predictor):
    rng = np.random.default_rng(123)
    for d in (1, 2, 3, 4, 5, 9, 33):
        for n in SIZES:
            for top in (1 << bits, 20, 2, 1):
                x = rng.integers(0, top, (n, d))
                x[n // 3 : 2 * n // 3] = x[n // 3] if n else 0
                assert np.array_equal(layout.decode(layout.encode(x, bits, predictor), bits, predictor), x)


def test_packed_bytes_are_as_stated():
    # Under 128 values: groups 0, all values behind, columns, then the values.
    assert layout.encode(np.arange(5)) == struct.pack("<IHH", 0, 5, 1) + bytes(range(5))
    # A ramp of 1: the first block has deltas 0, 1, ... (zigzag 0, 2, 2, ...: 2 bits), all others 1 (zigzag 2).
    data = layout.encode(np.arange(130))
    ramp = sum(2 << 2 * i for i in range(8))
    assert data[:8] == struct.pack("<IHH", 8, 2, 1) and data[8] == 0b010010 and data[9:11] == struct.pack("<H", ramp - 2)
    assert data[11:13] == struct.pack("<H", ramp) and data[-2:] == bytes([128, 129]) and len(data) == 8 + 8 * 5 + 2
    # Zeros: one run of 300 blocks but for the values left behind.
    data = layout.encode(np.zeros(2400))
    assert struct.unpack_from("<IHH", data) == (1, 0, 1) or len(data) < 40
    # Widths of 7 are raised to 8, and written as 7.
    assert layout.widths(np.full((8, 1), 64, np.uint64)).tolist() == [[8]] and layout.widths(np.full((8, 1), 1 << 14, np.uint64)).tolist() == [[16]]
    z = np.arange(16, dtype=np.uint64).reshape(8, 2) % 4
    rows, columns = layout.pack_block(z, [2, 2], False), layout.pack_block(z, [2, 2], True)
    assert rows == bytes([0b0100, 0b1110] * 4) and columns == struct.pack("<HH", sum((v % 4) << 2 * i for i, v in enumerate(range(0, 16, 2))), sum((v % 4) << 2 * i for i, v in enumerate(range(1, 16, 2))))
    assert layout.read_simple(layout.write_simple(np.array([[1, 2], [3, 4]]))).tolist() == [[1, 2], [3, 4]]


def test_predictors_equal_kernels():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.integers(-300, 300, 333)) & 0xFFFF
    assert (P.encode(P.Adaptive(), x, bits=16)[0] == R.forecast(x)[:, 0]).all()
    assert (P.encode(P.MovingAverage(), x)[0] == R.moving_average(x)).all()
    assert P.encode(P.Difference(2), [7, 10, 13, 16])[0].tolist() == [7, -4, 0, 0] and P.encode(P.Difference(3), [7, 10, 13, 16])[0].tolist() == [7, -11, 4, 0]
    for p, bits in ((P.Adaptive(), 16), (P.Adaptive(16, 3, False), 16), (P.MovingAverage(), None), *((P.Difference(k), None) for k in (1, 2, 3))):
        a, state = P.encode(p, x[:100], bits=bits)
        b, _ = P.encode(p, x[100:], state, bits)
        assert (P.decode(p, [*a, *b], bits=bits) == x).all()
    m = P.OnlineMean(3, 2)
    m.start([[1, 10], [2, 20], [4, 40]])
    assert m.means().tolist() == [2, 23]
    m.add([6, 3])
    assert m.means().tolist() == [4, 21]
    m.reset()
    assert m.means().tolist() == [0, 0]


def test_block_transforms(spark):
    blocks = [[5, 1, 4, 4, 0, 9, 2, 2], [0] * 8, [100, 100, 1, 1, 1, 1, 1, 1], [1, 1, 50, 50, 51, 51, 52, 52]]
    d = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, v array<long>")
    got = [r.x for r in d.orderBy("i").select(Q.level_out(F.col("v")).alias("x")).collect()]
    for b, x in zip(blocks, got, strict=True):
        v = sorted(map(float, b), reverse=True)
        for i in range(7):
            up = (v[i] - v[i + 1]) / (8 - i)
            v[i + 1 :] = [y + up for y in v[i + 1 :]]
            v[i] = v[i + 1]
        assert x == pytest.approx(v)
    codes = [r.c for r in d.orderBy("i").select(Q.pair_pattern(F.col("v")).alias("c")).collect()]
    assert all(0 <= c < 32 for c in codes) and codes[1] == 0
    p = spark.createDataFrame([(7, -4), (-9, 2), (0, 0)], "a long, b long").select("a", "b", *[c.alias(n) for n, c in zip("xy", Q.lifted(F.col("a"), F.col("b")), strict=True)])
    assert all((r.a, r.b) == (r.p, r.q) for r in p.select("a", "b", *[c.alias(n) for n, c in zip("pq", Q.lowered(F.col("x"), F.col("y")), strict=True)]).collect())
    m = Q.orthonormal(4)
    assert np.allclose(m @ m.T, np.eye(4))
    e = spark.createDataFrame([(0.0,), (0.5,), (None,)], "x double").select(Q.erf("x").alias("e"), Q.erfc("x").alias("c")).collect()
    assert e[1].e == pytest.approx(0.5204998778) and e[1].c == pytest.approx(1 - 0.5204998778) and e[2].e is None


def test_inflection_and_padding(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate((2, -2, 1, 0))], "k int, i int, x long")
    assert [r.y for r in d.select("i", Q.inflected(Series(("k",), ("i",)), "x").alias("y")).orderBy("i").collect()] == [2, 0, -1, -1]
    with pytest.raises(ValueError):
        Q.pad(F.col("x"), 1, "other")


def test_codecs_that_learn(spark):
    rows = [(1, i, 3 * i + i % 2, i, i * i % 17) for i in range(60)]
    d, s = spark.createDataFrame(rows, "k int, i int, y long, a long, b long"), Series(("k",), ("i",))
    c = codecs.LearnedSum("y", ["a", "b"])
    coded, header = c.encode(d, s)
    assert coded.agg(F.max(F.abs("y"))).first()[0] <= 3 and sorted(c.decode(coded, s, header).collect()) == sorted(d.collect())
    best = codecs.Best({"raw": lambda n: [], "delta": lambda n: [codecs.Delta(n)], "double": lambda n: [codecs.DoubleDelta(n)]}, ["y", "a", "b"])
    coded, header = best.encode(d, s)
    assert header["choice"]["a"] == "double" and sorted(best.decode(coded, s, header).collect()) == sorted(d.collect())


def test_queries_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, -float(i)]) for i in range(40)], "id long, vec array<double>")
    one, many = (sorted(map(tuple, N.distances(v, v.where("id % 5 = 0"), "correlation", b).collect())) for b in (1 << 20, 100))
    assert one == many and len(one) == 320


def test_raw_files(spark, tmp_path):
    x = np.arange(12, dtype="<u2").reshape(6, 2)
    (tmp_path / "a.dat").write_bytes(x.tobytes())
    (tmp_path / "b.dat").write_bytes((x + 100).tobytes())
    got = layout.read_raw(spark, str(tmp_path), ["p", "q"]).collect()
    assert sorted((r.i, r.p, r.q) for r in got if r.path.endswith("a.dat")) == [(i, 2 * i, 2 * i + 1) for i in range(6)] and len(got) == 12


def test_store_keeps_new_rows(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "s"))
    s.write("t", spark.createDataFrame([(1, 5)], "k long, a long"))
    s.upsert_columns("t", ["k"], spark.createDataFrame([(1, 7), (2, 8)], "k long, b long"))
    assert sorted(map(tuple, s.read("t", ["k", "a", "b"]).collect()), key=str) == [(1, 5, 7), (2, None, 8)] and s.ids() == ["t"]


def test_streams(spark, sf_dir, tmp_path):
    """Predictors, means and blocks over micro-batches equal one pass over each series; rows that come late are marked."""
    e = C.events(spark, sf_dir).select("user_id", "event_id", "q").where("user_id < 6")
    parts = e.orderBy("event_id").toPandas()
    schema = "user_id long, event_id long, q long"
    for k in range(3):
        part = parts[parts.event_id % 1000 // 334 == k] if parts.event_id.max() < 1000 else parts.iloc[len(parts) * k // 3 : len(parts) * (k + 1) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).toPandas()

    got = run(online.stream_residuals(stream(), "user_id", "event_id", "q", P.Adaptive(), 16), "adaptive")
    means = run(online.stream_means(stream(), "user_id", "event_id", "q", 4), "means")
    blocks = run(online.stream_blocks(stream(), "user_id", "event_id", "q"), "blocks")
    assert not got.late.any() and len(got) == len(parts)
    for user, own in parts.groupby("user_id"):
        x = own.q.to_numpy()
        assert got[got.user_id == user].sort_values("event_id").residual.astype(int).tolist() == R.forecast(x)[:, 0].tolist()
        assert means[means.user_id == user].sort_values("event_id")["mean"].dropna().astype(int).tolist() == [int(x[i - 3 : i + 1].sum()) // 4 for i in range(3, len(x))]
        assert [list(b) for b in blocks[blocks.user_id == user].sort_values("event_id").block] == [x[i : i + 8].tolist() for i in range(0, len(x) // 8 * 8, 8)]
