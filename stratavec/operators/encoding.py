"""The encoding advisor: which section type suits each section, and how many bytes it takes, without encoding any.

Everything is partitioned by (vec, sect): statistics come from windows over a section, and octets and sections are
aggregated on the same partitioning, so there is a single shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import float_bits, nibbles, trailing_zeros
from ..functions.model import OCTET, SECTION, octet, section, whole

HEADER_BYTES = 16


def section_type(mn: Column, mx: Column) -> Column:
    return (
        F.when((mn == mx) & (mn == 0), "Null").when(mn == mx, "Constant")
        .when(nibbles(mx - mn) < nibbles(mx), "DeltaNPMedium").otherwise("NibblePackedMedium")
    )


def _typed(df: DataFrame) -> DataFrame:
    """vec, pos, v, sect, mn, t: with each row its section's least element and type."""
    rows = whole(df).select("vec", "pos", F.col("v").cast("bigint").alias("v"), section().alias("sect"))
    w = W.partitionBy("vec", "sect")
    n, mn, mx = F.count("*").over(w), F.min("v").over(w), F.max("v").over(w)
    rows = rows.withColumn("mn", F.when(n < SECTION, F.least(mn, F.lit(0).cast("bigint"))).otherwise(mn)).withColumn("mx", mx)
    return rows.withColumn("t", section_type(F.col("mn"), F.col("mx")))


def section_types(stats: DataFrame) -> DataFrame:
    """vec, sect, t, from section statistics of integers."""
    return stats.select("vec", "sect", section_type(F.col("mn"), F.col("mx")).alias("t"))


def _float_type() -> Column:
    plain = (F.col("mn") == F.col("mx")) & ~F.col("has_nan")
    return F.when(plain & (F.col("mn") == 0), "Null").when(plain, "Constant").otherwise("XorNPMedium")


def float_section_types(stats: DataFrame) -> DataFrame:
    """vec, sect, t, from section statistics of floats; a section that has a NaN is never Null or Constant."""
    return stats.select("vec", "sect", _float_type().alias("t"))


def _octets(rows: DataFrame) -> DataFrame:
    """Per octet of rows (vec, sect, t, pos, d, real): see octets()."""
    per = rows.groupBy("vec", "sect", "t", octet().alias("oct")).agg(F.bit_or("d").alias("ob"), F.count_if(F.col("d") != 0).alias("nz"), F.count_if("real").alias("n"))
    low = F.when(F.col("ob") == 0, F.lit(0)).otherwise(F.floor(trailing_zeros(F.col("ob")) / 4)).cast("bigint")
    width = F.when(F.col("ob") == 0, F.lit(0)).otherwise(nibbles(F.col("ob")) - low).cast("bigint")
    return per.select("vec", "sect", "t", "oct", "n", "nz", low.alias("low_nibbles"), width.alias("width"))


def octets(df: DataFrame) -> DataFrame:
    """vec, sect, t, oct, n, nz, low_nibbles, width: per octet its elements, the non-zero ones, trailing zero nibbles and
    nibbles kept, after the section's own delta."""
    v = F.when(F.col("t") == "DeltaNPMedium", F.col("v") - F.col("mn")).otherwise(F.col("v"))
    return _octets(_typed(df).withColumn("d", v).withColumn("real", F.lit(True)))


def float_octets(df: DataFrame) -> DataFrame:
    """The same of f32 vectors, after XOR with the bits eight positions before in the section. The zeros that pad a
    vector's last section take part, as they differ from what is before them."""
    rows = whole(df).select("vec", "pos", "v", F.lit(True).alias("real"))
    ends = rows.groupBy("vec").agg((F.max("pos") + 1).alias("n")).where(F.col("n") % SECTION != 0)
    last = F.shiftleft(section(F.col("n")) + 1, 8) - 1
    padding = ends.select("vec", F.explode(F.sequence("n", last)).alias("pos"), F.lit(0).cast("float").alias("v"), F.lit(False).alias("real"))
    rows = rows.unionByName(padding).select("vec", "pos", "v", "real", section().alias("sect"), float_bits(F.col("v")).cast("bigint").bitwiseAND(F.lit(2**32 - 1).cast("bigint")).alias("b"))
    w = W.partitionBy("vec", "sect")
    plain = F.when(~F.isnan("v"), F.col("v"))
    rows = rows.withColumn("mn", F.min(plain).over(w)).withColumn("mx", F.max(plain).over(w)).withColumn("has_nan", F.bool_or(F.isnan("v")).over(w))
    before = F.coalesce(F.lag("b", OCTET).over(w.orderBy("pos")), F.lit(0).cast("bigint"))
    return _octets(rows.withColumn("d", F.col("b").bitwiseXOR(before)).withColumn("t", _float_type()))


def _section_sizes(per_octet: DataFrame, width: int) -> DataFrame:
    size = F.when(F.col("nz") == 0, F.lit(1)).otherwise(2 + F.ceil(F.col("nz") * F.col("width") / 2))
    body = F.sum(size) + F.lit(SECTION // OCTET) - F.count("*")
    total = F.when(F.col("t") == "Null", F.lit(1)).when(F.col("t") == "Constant", F.lit(1 + width)).when(F.col("t") == "DeltaNPMedium", 12 + body).otherwise(3 + body)
    return per_octet.groupBy("vec", "sect", "t").agg(F.sum("n").alias("n"), total.cast("bigint").alias("bytes"))


def section_bytes(df: DataFrame, width: int = 8) -> DataFrame:
    """vec, sect, t, n, bytes, for integer elements of `width` bytes."""
    return _section_sizes(octets(df), width)


def float_section_bytes(df: DataFrame) -> DataFrame:
    """vec, sect, t, n, bytes, for f32 elements."""
    return _section_sizes(float_octets(df), 4)


def _vector_sizes(sections: DataFrame) -> DataFrame:
    return sections.groupBy("vec").agg(
        F.sum("n").alias("n"), (F.sum("bytes") + HEADER_BYTES).alias("bytes"), F.count("*").alias("n_sections"), F.count_if(F.col("t") == "Null").alias("null_sections")
    )


def vector_stats(df: DataFrame, width: int = 8) -> DataFrame:
    """vec, n, bytes, n_sections, null_sections."""
    return _vector_sizes(section_bytes(df, width))


def float_vector_stats(df: DataFrame) -> DataFrame:
    """The same of f32 vectors."""
    return _vector_sizes(float_section_bytes(df))


def summary(stats: DataFrame) -> DataFrame:
    """vec, summary: one line of text per vector."""
    each = F.col("bytes") / F.col("n")
    return stats.select("vec", F.format_string("%d elements, %d bytes (%.2f per element), %d sections, %d null", "n", "bytes", each, "n_sections", "null_sections").alias("summary"))


def type_histogram(types: DataFrame) -> DataFrame:
    return types.groupBy("vec", "t").agg(F.count("*").alias("n"))
