"""Unsigned 64-bit values kept in BIGINT columns: the same bits, read without a sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(2**63)
#: Fixed values of the band hash: offset basis and prime (2^40 + 435).
FNV_BASIS, FNV_LOW = 0xCBF29CE484222325, 435


def signed(x: int) -> int:
    """The BIGINT with the bits of the unsigned `x`."""
    return x - 2**64 if x >= 2**63 else x


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def from_hex16(c: Column) -> Column:
    return F.conv(c, 16, -10).cast("bigint")


def ordered(c: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of `c`; its own inverse."""
    return c.bitwiseXOR(F.lit(SIGN))


def from_decimal(c: Column) -> Column:
    """BIGINT bits of an unsigned DECIMAL(20,0)."""
    return F.when(c > F.lit(2**63 - 1).cast("decimal(20,0)"), c - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c).cast("bigint")


def to_decimal(c: Column) -> Column:
    d = c.cast("decimal(21,0)")
    return F.when(c < 0, d + F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(d).cast("decimal(20,0)")


def fnv_words(words: Column) -> Column:
    """Folds a BIGINT array: h = (h xor word) * prime modulo 2^64, without overflow.

    The product is taken in 32-bit limbs; the prime's high part only shifts.
    """

    def step(h: Column, w: Column) -> Column:
        x = h.bitwiseXOR(w)
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
        product = low * FNV_LOW
        carry = high * FNV_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(carry.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(product.bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.aggregate(words, F.lit(signed(FNV_BASIS)), step)
