"""The data model: vectors are rows (vec, pos, v) with dense positions from 0; sections are 256 positions, octets 8.

Nulls count as zeros everywhere: predicates match a null if and only if they match 0, so that they can go to the scan
as they are, and all other operators read elements through whole()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = 256
OCTET = 8
MAX_ROWS = 2**32 - 1


class VectorError(ValueError):
    pass


class InvalidNumRows(VectorError):
    """A vector was to be finished with fewer rows than it has, or with more than the format can count."""


class WrongVectorType(VectorError):
    """The column's type is not the one that was asked for."""


class InputTooShort(VectorError):
    """A stream ends before what it announces, or an empty one where a value is necessary."""


class InvalidFormat(VectorError):
    """Bytes that are not a vector."""


def section(pos: Column | str = "pos") -> Column:
    return F.shiftright(_col(pos), 8)


def octet(pos: Column | str = "pos") -> Column:
    return F.shiftright(_col(pos), 3)


def lane(pos: Column | str = "pos") -> Column:
    return _col(pos).bitwiseAND(F.lit(OCTET - 1).cast("bigint"))


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def whole(df: DataFrame, column: str = "v") -> DataFrame:
    """df with zeros in place of the column's nulls, in its own type."""
    kind = dict(df.dtypes)[column]
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(0).cast(kind)))


def unsigned(c: Column | str) -> Column:
    """The value of a u64 element: vectors of u64 hold its 64 bits as a bigint, which is negative from 2**63."""
    c = _col(c).cast("decimal(20,0)")
    return F.when(c < 0, c + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(c).cast("decimal(20,0)")


def one_vector(spark: SparkSession, vec: str, n: int) -> DataFrame:
    """One row (vec, n)."""
    return spark.range(1).select(F.lit(vec).alias("vec"), F.lit(n).cast("bigint").alias("n"))


def require_type(df: DataFrame, column: str, *types: str) -> DataFrame:
    """df, if the column has one of the types, such as 'bigint'."""
    found = dict(df.dtypes).get(column)
    if found not in types:
        raise WrongVectorType(f"{column} is {found}, not {' or '.join(types)}")
    return df
