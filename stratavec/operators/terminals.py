"""Counting, positions, masks, folds and section statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bit_width
from ..functions.model import SECTION, section, whole
from ..functions.predicates import true_where


def count_hits(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: n."""
    return df.where(predicate).agg(F.count("*").alias("n"))


def padded_hits(df: DataFrame, predicate: Column, matches_zero: bool) -> DataFrame:
    """The hits over whole sections: the zeros that pad each vector's last section count if the predicate matches 0."""
    hits = F.sum(true_where(predicate).cast("bigint"))
    padding = (F.ceil(F.count("*") / SECTION) * SECTION - F.count("*")).cast("bigint") if matches_zero else F.lit(0).cast("bigint")
    return df.groupBy("vec").agg((hits + padding).alias("n"))


def match_positions(df: DataFrame, predicate: Column) -> DataFrame:
    """vec, pos, in order."""
    return df.where(predicate).select("vec", "pos").orderBy("vec", "pos")


def matching_rows(*vectors: tuple[DataFrame, Column]) -> DataFrame:
    """pos at which all of several separate vectors match: each is filtered first, then they are joined on pos, in the
    order given, the most selective first. Positions that a shorter vector does not have cannot match."""
    (df, p), *rest = vectors
    out = df.where(p).select("pos")
    for df, p in rest:
        out = out.join(df.where(p).select("pos"), "pos", "left_semi")
    return out


def section_masks(df: DataFrame, predicate: Column) -> DataFrame:
    """vec, sect, word (0..7), mask: 32 positions to a word, low bit first; words without a hit included."""
    bit = F.when(true_where(predicate), F.expr("shiftleft(1L, CAST(pos & 31 AS INT))")).otherwise(F.lit(0).cast("bigint"))
    word = F.shiftright("pos", 5).bitwiseAND(F.lit(7).cast("bigint"))
    return df.groupBy("vec", section().alias("sect"), word.alias("word")).agg(F.bit_or(bit).alias("mask"))


def mask_hits(masks: DataFrame) -> DataFrame:
    """vec, sect, hits, from masks."""
    return masks.groupBy("vec", "sect").agg(F.sum(F.bit_count("mask").cast("bigint")).alias("hits"))


def mask_positions(masks: DataFrame) -> DataFrame:
    """vec, pos, from masks: every word counts 32 positions, whether it has hits or not."""
    bits = masks.where("mask <> 0").select("vec", "sect", "word", "mask", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("b"))
    return bits.where(F.expr("mask & shiftleft(1L, b)") != 0).select("vec", (F.col("sect") * SECTION + F.col("word") * 32 + F.col("b")).alias("pos"))


def masks_and(masks: DataFrame, *others: DataFrame) -> DataFrame:
    """vec, sect, word, mask: what all of the masks match; words that one of them does not have match nothing and go."""
    for other in others:
        both = masks.join(other.withColumnRenamed("mask", "_other"), ["vec", "sect", "word"])
        masks = both.select("vec", "sect", "word", F.col("mask").bitwiseAND(F.col("_other")).alias("mask"))
    return masks


def masks_or(masks: DataFrame, *others: DataFrame) -> DataFrame:
    """vec, sect, word, mask: what any of the masks matches."""
    for other in others:
        masks = masks.unionByName(other)
    return masks.groupBy("vec", "sect", "word").agg(F.bit_or("mask").alias("mask"))


def filter_masks(masks: DataFrame, each: Callable[[Column], Column]) -> DataFrame:
    """The masks after a filter that makes a new word of 32 bits from each word."""
    return masks.withColumn("mask", each(F.col("mask")).bitwiseAND(F.lit(2**32 - 1).cast("bigint")))


def fold(df: DataFrame, *aggregates: Column) -> DataFrame:
    return whole(df).groupBy("vec").agg(*aggregates)


def section_stats(df: DataFrame) -> DataFrame:
    """vec, sect, n, mn, mx over padded sections; NaN takes no part (a section of NaN only has null bounds)."""
    df = whole(df)
    floating = dict(df.dtypes)["v"] in ("float", "double")
    v = F.when(~F.isnan("v"), F.col("v")) if floating else F.col("v")
    zero = F.lit(0).cast(dict(df.dtypes)["v"])
    n = F.count("*")
    return df.groupBy("vec", section().alias("sect")).agg(
        n.alias("n"),
        F.when(n < SECTION, F.least(F.min(v), zero)).otherwise(F.min(v)).alias("mn"),
        F.when(n < SECTION, F.greatest(F.max(v), zero)).otherwise(F.max(v)).alias("mx"),
        *([F.bool_or(F.isnan("v")).alias("has_nan")] if floating else []),
    )


def section_bits(stats: DataFrame) -> DataFrame:
    """The statistics of integer sections with range, the bits of range and of maximum, and the range that these allow."""
    span = F.col("mx") - F.col("mn")
    with_bits = stats.withColumn("span", span).withColumn("span_bits", bit_width(span)).withColumn("max_bits", bit_width(F.col("mx")))
    return with_bits.withColumn("delta_range", F.when(F.col("span_bits") < 63, F.expr("shiftleft(1L, span_bits)")))


def null_sections(stats: DataFrame) -> DataFrame:
    """vec, n_sections, null_sections."""
    return stats.groupBy("vec").agg(F.count("*").alias("n_sections"), F.count_if((F.col("mn") == 0) & (F.col("mx") == 0)).alias("null_sections"))
