"""Joins whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this share of the rows are broadcast: fewer than so many keys.
HEAVY = 4096


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int) -> DataFrame:
    """Inner join of `left` to `right`, which has a row per key.

    `weight` of the right counts the left's rows of its key, of `total` rows
    that the left has at least.  Fewer than HEAVY keys can hold more than
    total / HEAVY rows each, so those are broadcast; the others meet by a
    shuffle, in which no key is large.  The left is read twice: write it first.
    """
    keys = list(on)
    large = F.col(weight) * F.lit(HEAVY) > F.lit(total)
    heavy, light = right.where(large).drop(weight), right.where(~large).drop(weight)
    others = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(heavy), keys).unionByName(others.join(light, keys))


def marked(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, name: str) -> DataFrame:
    """`left` with the boolean `name`, whether its key is in `right`; as in `meet`."""
    keys = list(on)
    large = F.col(weight) * F.lit(HEAVY) > F.lit(total)
    there = right.select(*keys, F.lit(True).alias(name), weight)
    first = left.join(F.broadcast(there.where(large).drop(weight)), keys, "left")
    others = first.where(F.col(name).isNull()).drop(name).join(there.where(~large).drop(weight), keys, "left")
    return first.where(F.col(name)).unionByName(others.withColumn(name, F.coalesce(name, F.lit(False))))
