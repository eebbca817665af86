"""Bit-level functions, all evaluated in the JVM.

Float bits come through reflect(), which Catalyst takes for non-deterministic: project them into a column before
aggregating or joining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_bits(c: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), c.cast("double")).cast("bigint")


def bits_double(c: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), c.cast("bigint")).cast("double")


def float_bits(c: Column) -> Column:
    return F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), c.cast("float")).cast("int")


def bits_float(c: Column) -> Column:
    return F.reflect(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), c.cast("int")).cast("float")


def bit_width(c: Column) -> Column:
    """Bits that an unsigned value needs; 0 for 0."""
    return F.when(c == 0, F.lit(0)).otherwise(F.length(F.bin(c.cast("bigint"))))


def trailing_zeros(c: Column) -> Column:
    """Of a non-zero value."""
    return F.bit_count(c.bitwiseAND(F.negate(c)) - F.lit(1).cast("bigint"))


def nibbles(c: Column) -> Column:
    """Half bytes that an unsigned value needs."""
    return F.floor((bit_width(c) + 3) / 4)
