"""Queries on made-up events: zeros, values over 16 bits, ties."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.errors import PythonException

from tests.oracle import compare, connect
from tidemark.operators import codecs, layout, learned
from tidemark.operators import recurrences as R
from tidemark.plans import catalogue as C
from tidemark.plans.catalogue import QUERIES


@pytest.fixture
def made(tmp_path):
    """Writes events of the given cents, one list for each user, and gives their folder."""

    def write(*series: list[int]) -> str:
        rows = [(user, i, q) for user, own in enumerate(series) for i, q in enumerate(own)]
        values = ", ".join(f"({k}, TIMESTAMP '2024-01-01' + INTERVAL {i} MINUTE, {user}, 'view', {q} / 100.0::DOUBLE, '{{}}')" for k, (user, i, q) in enumerate(rows))
        duckdb.sql(f"COPY (SELECT col0::BIGINT AS event_id, col1 AS ts, col2::BIGINT AS user_id, col3 AS event_type, col4::DOUBLE AS value, col5 AS props FROM (VALUES {values})) TO '{tmp_path}/events.parquet'")
        return str(tmp_path)

    return write


def held(spark, d: str, name: str) -> None:
    compare(spark, d, QUERIES[name].run, QUERIES[name].sql)


def test_elementwise_divides_by_zero_and_below_it(spark, made):
    d = made([700, 500, 300, 0, 200, 100, 300], [-700, 5, 6, 2], [4])
    held(spark, d, "elementwise")  # the 0 lies where the SQL does not look
    got = QUERIES["elementwise"].run(spark, made([8, 9, 0])).first()
    assert (got["over"], got["plus"]) == ("1,0", "8,18,8")


def test_sliding_products_of_a_series_that_begins_with_zeros(spark, made):
    d = made([0, 0, 300, 100], [500, 0, 0, 0, 0, 0, 0, 0, 0])
    held(spark, d, "sliding_products")
    got = QUERIES["sliding_products"].run(spark, d)
    assert got.where("isnan(cosine)").count() == 2 + 3 and got.where("cosine IS NULL").count() == 0


def test_ranks_of_symbols_past_one_byte(spark, made):
    held(spark, made([70_000, 100, 70_000, 66_000, 0, 9_000_000_000]), "rank_roundtrip")
    x = np.array([3, 0, 3, 300, 1, 0, 10**12, 300])
    ranks = learned.adaptive_ranks(x)
    assert ranks.tolist() == [3, 1, 1, 300, 3, 1, 10**12, 3]
    assert learned.adaptive_ranks(ranks, decode=True).tolist() == x.tolist()


def test_ranks_are_those_of_a_fixed_alphabet():
    x = np.random.default_rng(1).integers(0, 40, 400)
    counts, want = np.zeros(256, np.int64), []
    for v in x:
        want.append((counts > counts[v]).sum() + (counts[:v] == counts[v]).sum())
        counts[v] += 1
    assert learned.adaptive_ranks(x).tolist() == want


def test_packed_bytes_of_values_past_their_bits(spark, made):
    d = made([70_000, 1, 65_536, 131_071, 0, 0, 0, 0, 0, 70_000], [9_000_000_000_000, *[5] * 16], [-100] * 20, [1, 2, 3])
    held(spark, d, "binary_codec_roundtrip")
    far = np.array([2**63 - 1, -(2**63), 0, 7, -1, 2**40, 65_535, 65_536, 3])
    for x, bits in ((far, 64), (abs(far[3:]), 64), (far[6:], 32), (far[6:7], 16)):
        data = R.pack(x)
        assert int.from_bytes(data[6:8], "little") == bits
        assert R.unpack(data).ravel().tolist() == x.tolist()


def test_forecast_of_values_past_its_bits(spark, made):
    d = made([70_000, 1, 65_536, 131_071, 0, 0, 0, 0, 0, 70_000], [9_000_000_000_000, *[5] * 16], [-100] * 20, [1, 2, 3])
    for name in ("fire_roundtrip", "fire_encode"):
        held(spark, d, name)


def same(spark, d: str, name: str) -> None:
    """Equal to the SQL in every bit, null and NaN apart."""
    got, want = QUERIES[name].run(spark, d).toArrow(), connect(d).sql(QUERIES[name].sql).to_arrow_table()
    key = next(c for c in ("event_id", "user_id") if c in got.column_names)
    for c in want.column_names:
        a, b = (t.sort_by(key)[c].to_pylist() for t in (got, want))
        assert list(map(repr, a)) == list(map(repr, b)), c


@pytest.mark.parametrize("name", ["math_functions", "math_more"])
def test_logarithms_of_zero_and_below(spark, made, name):
    same(spark, made([0, 100, 250, 50_000], [-100, 0, 70_000]), name)


WIDE = [70_000, 1, 65_536, 65_535, 0, 300, 9_000_000_000], [-100, 5, -70_000, 255, 256], [4]


@pytest.mark.parametrize("name", ["raw_bytes", "shuffled_digest"])
def test_digests_of_values_past_two_bytes(spark, made, name):
    same(spark, made(*WIDE), name)


def test_raw_columns_refuse_what_they_would_cut(spark, made):
    e = C.events(spark, made([70_000, 1]))
    assert layout.raw_columns(e, C.USER, ["q"], "<u4").first()["payload"] == bytes([0x70, 0x11, 1, 0, 1, 0, 0, 0])
    with pytest.raises(PythonException, match="does not hold"):
        layout.raw_columns(e, C.USER, ["q"]).collect()


def test_series_bytes_refuse_what_they_would_cut():
    assert codecs.SeriesBytes("q", "none", dtype="<u2").pack([258, 1]) == bytes([2, 1, 1, 0])
    for x in ([70_000, 1], [-1]):
        with pytest.raises(ValueError, match="does not hold"):
            codecs.SeriesBytes("q", "none", dtype="<u2").pack(x)


def test_moments_take_the_first_of_equal_maxima(spark, made):
    same(spark, made([5, 900, 1, 900, 900, 3], [-4, -4], [0, 0, 7]), "moments")
    got = QUERIES["moments"].run(spark, made([5, 900, 1, 900, 900, 3], [-4, -4])).orderBy("user_id").collect()
    assert [r["argmax"] for r in got] == [1, 6]


def test_fused_rounds_once():
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=20_000) * 2.0 ** rng.integers(-20, 20, 20_000) for _ in range(2))
    c = np.where(rng.random(20_000) < 0.5, -a * b * (1 + rng.integers(-3, 4, 20_000) * 2.0**-52), rng.normal(size=20_000) * 2.0 ** rng.integers(-60, 60, 20_000))
    a[:9], b[9:18], c[18:27] = 0, 0, 0
    want = [float(Fraction(x) * Fraction(y) + Fraction(z)) for x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
    assert R.fused(a, b, c).tolist() == want


def test_sliding_covariances_at_ties(spark, made):
    """Half of the fourth rows end in half a cent: before, 8 of these 2,100 rows were 0.01 from the SQL."""
    same(spark, made(*np.random.default_rng(3).integers(0, 20_000, (300, 7)).tolist()), "sliding_products")
