"""Unions, distinct keys, differences and ordered counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def set_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``a`` that ``b`` does not have; nulls equal each other."""
    return a.select(column).subtract(b.select(column))


def ordered_counts(df: DataFrame, *columns: str) -> DataFrame:
    return (
        df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), *columns)
    )
