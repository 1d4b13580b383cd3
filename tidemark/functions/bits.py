"""Bit and digit functions and logarithms as columns. All arithmetic is in BIGINT and masked, because ANSI casts raise on overflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_unsigned(x: Column, bits: int) -> Column:
    return x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def wrap_signed(x: Column, bits: int) -> Column:
    half = 1 << (bits - 1)
    return wrap_unsigned(x.cast("bigint") + F.lit(half).cast("bigint"), bits) - F.lit(half).cast("bigint")


def sign_extend(x: Column, bits: int) -> Column:
    """The value whose two's complement of `bits` bits is x."""
    top = F.lit(1 << (bits - 1)).cast("bigint")
    return x.cast("bigint").bitwiseXOR(top) - top


def zigzag(x: Column) -> Column:
    x = x.cast("bigint")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    z = z.cast("bigint")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("bigint")))


def bit_length(z: Column) -> Column:
    """Bits of a non-negative number; 0 for 0."""
    return F.when(z == 0, F.lit(0)).otherwise(F.length(F.bin(z)))


def bits_unsigned(x: Column) -> Column:
    return bit_length(x.cast("bigint"))


def bits_signed(x: Column) -> Column:
    """Bits of a signed number: a sign bit and the magnitude; -1 takes one bit, 0 none."""
    x = x.cast("bigint")
    return F.when(x == 0, F.lit(0)).otherwise(bit_length(F.when(x < 0, -x - 1).otherwise(x)) + 1)


def escaped_width(bits: Column, width: int) -> Column:
    """Width headers have no code for width - 1: it is stored as width."""
    return F.when(bits == width - 1, F.lit(width)).otherwise(bits)


def digits_around_point(text: Column) -> tuple[Column, Column]:
    """Digits before and after the decimal point, zeros at either end of the text not counted."""
    t = F.regexp_replace(text, "^0+|0+$", "")
    at = F.instr(t, ".")
    return F.when(at == 0, F.length(t)).otherwise(at - 1), F.when(at == 0, F.lit(0)).otherwise(F.length(t) - at)


def logarithm(x: Column, f: Callable[[Column], Column] = F.log) -> Column:
    """f, a logarithm, where Spark has null: -infinity of 0, NaN below."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(f(x))
