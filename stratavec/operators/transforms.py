"""Element-wise, delta and XOR transforms.

Lags and running totals over a whole vector go in two levels: within blocks of BLOCK positions, then over one row per
block. So a vector of any length is spread over tasks. Positions must be dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import lane, section, whole

BLOCK_BITS = 16


def add_constant(df: DataFrame, constant) -> DataFrame:
    """v + constant; a null gives the constant."""
    return whole(df).withColumn("v", F.col("v") + F.lit(constant))


def add_constant_wrapping(df: DataFrame, constant: int, bits: int) -> DataFrame:
    """v + constant modulo 2**bits, for unsigned elements of up to 64 bits (those of 64 as bit patterns, see
    model.unsigned). The halves of 32 bits are added one after the other, so nothing overflows."""
    low = F.lit(2**32 - 1).cast("bigint")
    v, c = F.col("v").cast("bigint"), constant % 2**64
    right = v.bitwiseAND(low) + F.lit(c & 2**32 - 1).cast("bigint")
    left = F.shiftrightunsigned(v, 32) + F.lit(c >> 32).cast("bigint") + F.shiftright(right, 32)
    total = F.shiftleft(left.bitwiseAND(low), 32).bitwiseOR(right.bitwiseAND(low))
    return whole(df).withColumn("v", total if bits == 64 else total.bitwiseAND(F.lit(2**bits - 1).cast("bigint")))


def widen(df: DataFrame) -> DataFrame:
    return whole(df).withColumn("v", F.col("v").cast("bigint"))


def _block() -> Column:
    return F.shiftright("pos", BLOCK_BITS)


def with_previous(df: DataFrame, value: str = "v", out: str = "prev", first=0) -> DataFrame:
    """df with the value at the position before; `first` at a vector's first position."""
    kind = dict(df.dtypes)[value]
    start = F.lit(first).cast(kind)
    rows = whole(df, value).withColumn("_block", _block())
    ends = rows.groupBy("vec", "_block").agg(F.max_by(value, "pos").alias("_end")).select("vec", (F.col("_block") + 1).alias("_block"), "_end")
    inside = F.lag(value).over(W.partitionBy("vec", "_block").orderBy("pos"))
    at_first = F.row_number().over(W.partitionBy("vec", "_block").orderBy("pos")) == 1
    rows = rows.withColumn(out, inside).withColumn("_first", at_first).join(ends, ["vec", "_block"], "left")
    return rows.withColumn(out, F.when(F.col("_first"), F.coalesce("_end", start)).otherwise(F.col(out))).drop("_block", "_end", "_first")


def _running(df: DataFrame, value: str, out: str, aggregate, combine) -> DataFrame:
    rows = whole(df, value).withColumn("_block", _block())
    totals = rows.groupBy("vec", "_block").agg(aggregate(value).alias("_t"))
    before = W.partitionBy("vec").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("vec", "_block", F.coalesce(aggregate("_t").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("vec", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(out, aggregate(value).over(inside)).join(totals, ["vec", "_block"])
    return rows.withColumn(out, combine(F.col(out), F.col("_before"))).drop("_block", "_before")


def running_sum(df: DataFrame, value: str = "v", out: str = "v") -> DataFrame:
    return _running(df, value, out, F.sum, lambda a, b: a + b)


def running_xor(df: DataFrame, value: str = "v", out: str = "v") -> DataFrame:
    return _running(df, value, out, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def delta_from_least(df: DataFrame) -> DataFrame:
    """vec, pos, base, v: each section's elements less its least one."""
    base = F.min("v").over(W.partitionBy("vec", section()))
    return whole(df).select("vec", "pos", base.alias("base"), (F.col("v") - base).alias("v"))


def undo_delta_from_least(df: DataFrame) -> DataFrame:
    return df.select("vec", "pos", (F.col("v") + F.col("base")).alias("v"))


def successive_delta(df: DataFrame) -> DataFrame:
    """v less the one before, 0 where the series falls; the next difference is still to the raw value."""
    return with_previous(whole(df)).select("vec", "pos", F.greatest(F.col("v") - F.col("prev"), F.lit(0).cast("bigint")).alias("v"))


def xor_previous(df: DataFrame, bits: str = "v") -> DataFrame:
    """Bit patterns XOR those before."""
    return with_previous(df, bits).select("vec", "pos", F.col(bits).bitwiseXOR(F.col("prev")).alias("v"))


def xor_octets(df: DataFrame) -> DataFrame:
    """Within each section, bit patterns XOR those eight positions before."""
    kind = dict(df.dtypes)["v"]
    before = F.coalesce(F.lag("v", 8).over(W.partitionBy("vec", section()).orderBy("pos")), F.lit(0).cast(kind))
    return whole(df).select("vec", "pos", F.col("v").bitwiseXOR(before).alias("v"))


def undo_xor_octets(df: DataFrame) -> DataFrame:
    running = W.partitionBy("vec", section(), lane()).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return df.select("vec", "pos", F.bit_xor("v").over(running).alias("v"))


def section_arrays(df: DataFrame) -> DataFrame:
    """vec, sect, values: each section's elements in order."""
    return whole(df).groupBy("vec", section().alias("sect")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))
