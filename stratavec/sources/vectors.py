"""Building vectors: positions, densifying, finishing, appending, and table, text and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import MAX_ROWS, SECTION, InvalidNumRows, one_vector, require_type
from .scratch import saved


def vector(df: DataFrame, pos: Column | str, value: Column | str, vec: Column | str | None = None) -> DataFrame:
    """(vec, pos, v) from a table that has a dense position column. The value stays a plain column, so that predicates on
    it reach the scan; its nulls count as zeros in every operator."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select((F.lit("v") if vec is None else c(vec)).alias("vec"), c(pos).cast("bigint").alias("pos"), c(value).alias("v"))


def open_vector(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """A stored vector, if its elements have the type asked for."""
    return require_type(spark.read.parquet(path), "v", value_type)


def save_vector(df: DataFrame, path: str, max_rows_per_file: int = 50_000_000) -> None:
    """Written in position order within files, so that row-group statistics let scans skip."""
    df.sortWithinPartitions("vec", "pos").write.option("maxRecordsPerFile", max_rows_per_file).parquet(path)


def with_positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with dense positions `pos` in the given order; rows that tie are ordered by a hash of all their columns.

    The table is sorted by range and written to the shared folder once, with each row's place in its partition: what is
    numbered and what is counted are then the same rows, whichever columns are read later. Positions are the places
    moved by the rows of the partitions before; only one count per partition is gathered, and no task sees more than
    its range. Select the columns that are needed first, as all of df's are written."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind))
    sorted_ = df.withColumn("_tie", ties).repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie")
    placed = saved(sorted_.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    rows = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.withColumn("pos", F.col("_start") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_start")


def _grid(sizes: DataFrame) -> DataFrame:
    """(vec, pos) of all positions of vectors (vec, n). Those of one block of 65,536 are made together from its number, so a
    vector is never one row or one task."""
    blocks = sizes.where("n > 0").select("vec", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("n") - 1, 16))).alias("_block"))
    return blocks.select("vec", F.explode(F.sequence(F.col("_block") * 65536, F.least(F.col("n"), (F.col("_block") + 1) * 65536) - 1)).alias("pos"))


def densify(sparse: DataFrame, n: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The sparse vectors with zeros at all positions up to n (or up to `n` of their row in sizes: vec, n, which may
    hold vectors without any element)."""
    if sizes is None:
        sizes = sparse.select("vec").distinct().withColumn("n", F.lit(n).cast("bigint"))
    kind = dict(sparse.dtypes)["v"]
    return _grid(sizes).join(sparse, ["vec", "pos"], "left").select("vec", "pos", F.coalesce("v", F.lit(0).cast(kind)).alias("v"))


def finish(df: DataFrame, total_rows: int, vec: str = "v") -> DataFrame:
    """One vector, padded with zeros to total_rows; one without elements is called vec."""
    got, name = df.agg(F.max("pos"), F.min("vec")).first()
    if total_rows > MAX_ROWS or (got is not None and got >= total_rows):
        raise InvalidNumRows(f"{total_rows} rows for a vector of {0 if got is None else got + 1}")
    return densify(df, sizes=one_vector(df.sparkSession, vec if name is None else name, total_rows))


def append(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The elements of one vector after the other."""
    out, n = first, first.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    for df in more:
        out = out.unionByName(df.withColumn("pos", F.col("pos") + n))
        n += df.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    return out


def append_nulls(df: DataFrame, n: int, vec: str = "v") -> DataFrame:
    """One vector followed by n zeros; one without elements is called vec."""
    name = df.agg(F.min("vec")).first()[0]
    zeros = _grid(one_vector(df.sparkSession, vec if name is None else name, n)).withColumn("v", F.lit(0).cast(dict(df.dtypes)["v"]))
    return append(df, zeros)


def flushed(df: DataFrame) -> DataFrame:
    """What a reader of an unfinished vector sees: whole sections only."""
    n = df.groupBy("vec").agg((F.floor(F.count("*") / SECTION) * SECTION).alias("_n"))
    return df.join(n, "vec").where("pos < _n").drop("_n")


def chunks(df: DataFrame, max_elements: int) -> DataFrame:
    """df with the number of the variable-size section that each element falls in."""
    return df.withColumn("chunk", F.floor(F.col("pos") / max_elements).cast("bigint"))


def csv_histograms(spark: SparkSession, path: str, series: str = "csv") -> DataFrame:
    """(series, ts, bucket, n) from lines of comma-separated cumulative counts; ts is the line's number from 0, files in
    order of their paths.

    Lines are numbered inside each piece of a file that a task reads, and moved by the lines of the pieces before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    lines = saved(lines.withColumn("_id", F.monotonically_increasing_id()), "lines")
    pieces = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = W.orderBy("_file", "_at").rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    pieces = pieces.select("_file", "_at", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = lines.join(pieces, ["_file", "_at"]).select((F.col("_start") + F.col("_id") - F.col("_first")).alias("ts"), F.split("value", ",").alias("c"))
    return numbered.select(F.lit(series).alias("series"), "ts", F.posexplode("c").alias("bucket", "n")).select("series", "ts", "bucket", F.trim("n").cast("bigint").alias("n"))
