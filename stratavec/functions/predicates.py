"""Predicates over elements. A null element is a zero; NaN equals nothing, and -0.0 equals 0.0."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


def equals(c: Column | str, value) -> Column:
    """Stays a plain comparison that the Parquet scan can take, but where the value is 0 and nulls match too."""
    c = _column(c)
    if _is_nan(value):
        return F.lit(False)
    return (c == F.lit(value)) | c.isNull() if value == 0 else c == F.lit(value)


def one_of(c: Column | str, values: Iterable) -> Column:
    """Whether the element is any of the values; of none, if there are no values."""
    c = _column(c)
    values = [v for v in values if not _is_nan(v)]
    if not values:
        return F.lit(False)
    found = c.isin(values)
    return found | c.isNull() if any(v == 0 for v in values) else found


def matches_zero(values: Iterable) -> bool:
    """Whether a null section can match a predicate on these values."""
    return any(v == 0 for v in values if not _is_nan(v))


def all_of(*predicates: Column) -> Column:
    """Row-aligned AND; at least one predicate is necessary."""
    if not predicates:
        raise ValueError("no predicate")
    return reduce(lambda a, b: a & b, predicates)


def nothing() -> Column:
    return F.lit(False)


def true_where(predicate: Column) -> Column:
    """The predicate as a value: never null."""
    return F.coalesce(predicate, F.lit(False))
