"""Reproducible samples and splits from a hash of the row key."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.clean import column
from tablefit.functions.hashing import unit_hash
from tablefit.operators.quantiles import order_statistic

Key = str | Sequence[str]


def sample(df: DataFrame, key: Key, fraction: float, seed: int = 42) -> DataFrame:
    """About `fraction` of the keys, with all their rows: a filter, no shuffle."""
    return df.filter(unit_hash(key, seed, "sample") < F.lit(float(fraction)))


def sample_n(df: DataFrame, key: Key, n: int, seed: int = 42) -> DataFrame:
    """Exactly `n` rows, those with the smallest hash of the key; all rows if
    n <= 0.

    The hash at rank `n` is found by counting, and the sample is then a filter:
    rows stay in their partitions, where a random sort with a limit would send
    candidates of every task to a single one.  Rows that share the hash at the
    cut, for instance those of a key that is not unique, are told apart by a
    hash of the whole row in the same way.
    """
    if n <= 0:
        return df
    rows = df.agg(F.count(F.lit(1)).alias("n")).first().n
    if n >= rows:
        return df
    # A hash skips nulls, so each column says first whether it is one.
    cells = [x for c in df.columns for x in (column(c).isNull(), column(c))]
    whole_row = F.shiftrightunsigned(F.xxhash64(*cells), 11) / F.lit(float(2**53))
    return _smallest(df, n, rows, [unit_hash(key, seed, "sample"), whole_row])


def _smallest(df: DataFrame, n: int, rows: int, places: list[Column]) -> DataFrame:
    place, *finer = places
    cut, below, at = _cut(df.select(place.alias("place")), n, rows)
    if below + at == n:
        return df.filter(place <= F.lit(cut))
    tied = df.filter(place == F.lit(cut))
    # Rows that agree in every column are as good as each other.
    chosen = _smallest(tied, n - below, at, finer) if finer else tied.limit(n - below)
    return df.filter(place < F.lit(cut)).unionByName(chosen)


def _cut(places: DataFrame, n: int, rows: int) -> tuple[float, int, int]:
    """The n-th smallest place, and how many rows lie below and at it."""
    # Places are uniform, so the n-th lies this close to n / rows.
    spread = 8 * math.sqrt(n) + 8
    cut = order_statistic(places, "place", n, ((n - spread) / rows, (n + spread) / rows))
    found = places.agg(
        F.count_if(F.col("place") < cut).alias("below"),
        F.count_if(F.col("place") == cut).alias("at"),
    ).first()
    return cut, found.below, found.at


def split(
    df: DataFrame,
    key: Key,
    ratio: float = 0.8,
    seed: int = 42,
    group_key: Key | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: disjoint, together the whole table.

    With `group_key` all rows of one group fall on the same side.
    """
    train = _in_train(key, ratio, seed, group_key)
    return df.filter(train), df.filter(~train)


def _in_train(key: Key, ratio: float, seed: int, group_key: Key | None) -> Column:
    place = unit_hash(group_key if group_key is not None else key, seed, "split")
    return place < F.lit(float(ratio))


def split_kept(
    df: DataFrame,
    keep: Callable[[DataFrame], DataFrame],
    key: Key,
    ratio: float = 0.8,
    seed: int = 42,
    group_key: Key | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`split(keep(df), ...)` for a `keep` that writes the rows and reads them back: a row's side is written
    beside it, so that readers of either side hash no key."""
    side = "in_train"
    while side in df.columns:
        side += "_"
    rows = keep(df.withColumn(side, _in_train(key, ratio, seed, group_key)))
    return rows.filter(F.col(side)).drop(side), rows.filter(~F.col(side)).drop(side)
