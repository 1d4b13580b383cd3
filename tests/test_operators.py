import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import bits
from tidemark.operators import recurrences as R
from tidemark.operators import series as S
from tidemark.plans import catalogue as C
from tidemark.sources.store import TableStore, all_close
from tidemark.streaming import online

SIZES = (1, 2, 7, 8, 15, 16, 17, 31, 33, 64, 127, 128, 129, 1000)


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("top", (256, 16, 2, 1))
def test_bytes_and_recurrences_come_back(n, top):
    rng = np.random.default_rng(123)
    for d in (1, 3, 9):
        x = rng.integers(0, top, (n, d))
        assert (R.unpack(R.pack(x)) == x).all()
        assert (R.forecast(R.forecast(x), decode=True) == x).all()
        assert (R.forecast(R.forecast(x, 8, 1, False), 8, 1, False, decode=True) == x).all()
    assert (R.moving_average(R.moving_average(x[:, 0]), decode=True) == x[:, 0]).all()


def test_zero_blocks_are_short():
    assert len(R.pack(np.zeros(8000))) < 20


def test_scalars(spark):
    d = spark.createDataFrame([(x,) for x in (0, 1, -1, 2, -2, 3, -3)], "x long")
    assert [r[0] for r in d.select(bits.zigzag(F.col("x"))).collect()] == [0, 2, 1, 4, 3, 6, 5]
    s = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 5, 7, 8, 9, -1, -2, -3, -4, -5, -7, -8, -9)], "x long")
    assert [r[0] for r in s.select(bits.bits_signed(F.col("x"))).collect()] == [0, 2, 3, 3, 4, 4, 4, 5, 5, 1, 2, 3, 3, 4, 4, 4, 5]
    t = spark.createDataFrame([(x,) for x in ("123", "12.", ".12", "1.2", "09.04", "090.0400", "00.000", "0", ".", "")], "x string")
    assert [tuple(r) for r in t.select(*bits.digits_around_point(F.col("x"))).collect()] == [(3, 0), (2, 0), (0, 2), (1, 1), (1, 2), (2, 2), (0, 0), (0, 0), (0, 0), (0, 0)]


def test_intervals(spark):
    d = spark.createDataFrame([(1, 0, 4), (1, 6, 9), (1, 10, 15), (1, 20, 30)], "k int, s long, e long")
    assert sorted((r.start_idx, r.end_idx) for r in S.union_intervals(d, ("k",), "s", "e", 1).collect()) == [(0, 5), (5, 16), (19, 31)]


def test_series_of_events_come_back(spark, sf_dir):
    e = C.events(spark, sf_dir)
    assert R.encode_series(e, C.USER, ["q"]).where("NOT exact").count() == 0
    assert R.forecast_series(e, C.USER, "q").where("residual_back <> q OR average_back <> q").count() == 0


def test_store(spark, tmp_path):
    a = TableStore(spark, str(tmp_path / "a"))
    a.write("t", spark.createDataFrame([(1, 2.5, None), (2, 3.5, "x")], "k long, `foo/a` double, s string"))
    a.upsert_columns("t", ["k"], spark.createDataFrame([(1, 7)], "k long, n long"))
    assert a.ids() == ["t"] and len(a) == 1 and a.read("t", ["n", "missing"]).columns == ["n"]
    b = TableStore(spark, str(tmp_path / "b"), "orc")
    a.copy_to(b)
    assert a.equals(b) and all_close(a.read("t"), b.read("t"), ["k"], "foo/a".join("``"))
    b.remove("t", ["s"])
    assert not a.equals(b) and a.file_sizes().first().nbytes > 0
    a.remove("t")
    assert a.ids() == []


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    e = C.events(spark, sf_dir).select("user_id", "event_id", "ts", "q")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    got = drain(online.stream_delta(stream, "user_id", "event_id", "q"), "deltas", "append")
    want = e.withColumn("residual", S.delta(S.Series(("user_id",), ("event_id",)), "q")).select("user_id", "event_id", "residual")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sums = drain(online.windowed(stream, "ts", "q", "1 day"), "days", "complete")
    assert sums.agg(F.sum("n")).first()[0] == e.count()
