"""What the operators of this subpackage share: table access, intermediate tables, batch mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard, saved, scratch_path, shared_dir

__all__ = ["broadcast_bytes", "broadcast_if_small", "discard", "filter_rows", "map_rows", "release_memory", "saved", "scratch_path", "shared_dir", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], bytes_at_once: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about bytes_at_once bytes, one row at least."""
    for batch in batches:
        step = max(1, int(bytes_at_once * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def release_memory() -> None:
    """Gives back to the system what this process has freed. Spark's Python workers go from task to task and from query to
    query, and what the allocators of earlier ones hold counts to the executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str, each: Callable[..., Iterator[tuple]], setup: Callable | None = None, bytes_at_once: int = 8_000_000) -> DataFrame:
    """Rows of df, as lists of the named columns, through each(state, *lists) -> rows of schema.

    each gets slices of Arrow batches of about bytes_at_once bytes, so that memory is bounded whatever the rows'
    lengths; setup() makes the state once per task. Only the named columns are read, so others, clashing names
    included, do not matter."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for part in slices(batches, bytes_at_once):
            rows = list(each(state, *(c.to_pylist() for c in part.columns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[object, str | None], bool], setup: Callable | None = None, bytes_at_once: int = 8_000_000) -> DataFrame:
    """The rows of df, with all their columns, for which keep(state, value of column) holds."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for part in slices(batches, bytes_at_once):
            yield part.filter(pa.array([keep(state, v) for v in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def broadcast_bytes(spark: SparkSession, value, n_bytes: int, limit: int, what: str):
    """A broadcast of value, whose size has been measured as n_bytes and must not be over limit."""
    if n_bytes > limit:
        raise ValueError(f"{what}: {n_bytes} bytes; at most {limit} are broadcast")
    return spark.sparkContext.broadcast(value)


#: Bytes that a table may be broadcast with.
BROADCAST_BYTES = 32_000_000


def broadcast_if_small(df: DataFrame, bytes_of_a_row: int) -> DataFrame:
    """df, to be broadcast in a join if its rows, which are counted, take at most BROADCAST_BYTES; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * bytes_of_a_row <= BROADCAST_BYTES else df
