"""Time series of bucketed counters: (series, ts, bucket, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import whole

#: Units of ts that one task of a series takes at a time.
SPAN = 1024


def bounds(initial: float, multiplier: float, buckets: int) -> list[float]:
    """Upper bounds of geometric buckets: initial * multiplier**i; the last bucket takes the rest."""
    return [initial * multiplier**i for i in range(buckets)]


def bucket_of(value: Column, upper: list[float]) -> Column:
    """The first bucket whose bound is not below the value."""
    out = F.lit(0)
    for b in upper[:-1]:
        out = out + (value > F.lit(b)).cast("int")
    return out


def bucketed(df: DataFrame, series: Column, ts: Column, value: Column, upper: list[float]) -> DataFrame:
    return df.groupBy(series.alias("series"), ts.alias("ts"), bucket_of(value, upper).alias("bucket")).agg(F.count("*").alias("n"))


def complete(histograms: DataFrame, buckets: int) -> DataFrame:
    """All buckets of every (series, ts), with 0 where there was none."""
    grid = histograms.select("series", "ts").distinct().select("series", "ts", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(histograms, ["series", "ts", "bucket"], "left").select("series", "ts", "bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def cumulative(histograms: DataFrame) -> DataFrame:
    w = W.partitionBy("series", "ts").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return histograms.select("series", "ts", "bucket", F.sum("n").over(w).alias("n"))


def bucket_deltas(histograms: DataFrame) -> DataFrame:
    """Each cumulative count less the one of the bucket before, 0 where it falls."""
    before = F.coalesce(F.lag("n").over(W.partitionBy("series", "ts").orderBy("bucket")), F.lit(0).cast("bigint"))
    return histograms.select("series", "ts", "bucket", F.greatest(F.col("n") - before, F.lit(0).cast("bigint")).alias("n"))


def _with_previous(histograms: DataFrame, span: int) -> DataFrame:
    """With each count the same bucket's before. Two levels: within blocks of `span` units of ts, then over one row per
    block, so a series of any length is spread over tasks."""
    rows = whole(histograms, "n").withColumn("_block", F.floor(F.col("ts") / span))
    ends = rows.groupBy("series", "bucket", "_block").agg(F.max_by("n", "ts").alias("_end"))
    carried = ends.select("series", "bucket", "_block", F.lag("_end").over(W.partitionBy("series", "bucket").orderBy("_block")).alias("_carried"))
    inside = F.lag("n").over(W.partitionBy("series", "bucket", "_block").orderBy("ts"))
    rows = rows.withColumn("before", inside).join(carried, ["series", "bucket", "_block"])
    return rows.withColumn("before", F.coalesce("before", "_carried", F.lit(0).cast("bigint"))).drop("_block", "_carried")


def time_diff(histograms: DataFrame, span: int = SPAN) -> DataFrame:
    """Each count less the same bucket's before; where it fell (a counter was reset), the count itself."""
    diff = F.when(F.col("n") < F.col("before"), F.col("n")).otherwise(F.col("n") - F.col("before"))
    return _with_previous(histograms, span).select("series", "ts", "bucket", diff.alias("n"))


def resets(histograms: DataFrame, span: int = SPAN) -> DataFrame:
    """series, ts, value_dropped: whether any bucket fell."""
    return _with_previous(histograms, span).groupBy("series", "ts").agg(F.bool_or(F.col("n") < F.col("before")).alias("value_dropped"))


def packed(histograms: DataFrame, initial: float, multiplier: float) -> DataFrame:
    """series, ts, histogram: struct(initial, multiplier, buckets) of the counts as they are."""
    rows = histograms.groupBy("series", "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("b"))
    return rows.select("series", "ts", F.struct(F.lit(float(initial)).alias("initial"), F.lit(float(multiplier)).alias("multiplier"), F.col("b").alias("buckets")).alias("histogram"))
