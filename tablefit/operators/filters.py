"""Row filters; plain predicates, so that they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(name: str, low: float, high: float, allow_null: bool = False) -> Column:
    inside = F.col(name).between(low, high)
    return F.col(name).isNull() | inside if allow_null else inside


def keep_in(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; null is not."""
    return df.filter(F.col(name).isin(list(values)))


def keep_not_null(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    for name in [names] if isinstance(names, str) else names:
        df = df.filter(F.col(name).isNotNull())
    return df


def keep_range(
    df: DataFrame, name: str, low: float, high: float, allow_null: bool = False
) -> DataFrame:
    """Rows with low <= value <= high; nulls only if `allow_null`."""
    return df.filter(in_range(name, low, high, allow_null))
