"""Order of conjuncts: Spark evaluates AND from left to right and does not reorder by selectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_of


def most_selective_first(df: DataFrame, predicates: list[Column], rows: int = 100_000) -> Column:
    """The AND of the predicates, those that fewest of some `rows` rows match first. Only as many files are read as
    hold these rows; any order of the predicates gives the same result."""
    got = df.limit(rows).agg(*(F.count_if(p).alias(f"p{i}") for i, p in enumerate(predicates))).first()
    return all_of(*(p for _, p in sorted(enumerate(predicates), key=lambda x: (got[x[0]], x[0]))))
