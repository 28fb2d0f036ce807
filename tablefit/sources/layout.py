"""A layout of rows in files that lets range filters on several columns skip row groups."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each column's rank in the key of a row, where the columns are few enough.
RANK_BITS = 8
#: Bits of a key that is never negative.
KEY_BITS = 63


def _number(df: DataFrame, name: str) -> Column:
    """The column as a double of the same order."""
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(name).cast("double")
    if kind == "timestamp":
        return F.unix_micros(name).cast("double")
    if kind in ("string", "binary", "array", "map", "struct", "variant"):
        raise ValueError(f"rows are clustered by numbers and times, and {name} is of type {kind}")
    return F.col(name).cast("double")


def clustered(df: DataFrame, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The same rows, those close in all columns `by` close together (Z-order).

    Each column's rank is its place among quantiles of one pass, nulls and NaN
    behind all values; the ranks' bits are interleaved into a key, and rows are
    dealt to tasks by ranges of it and sorted within them.  The least and
    greatest values that Parquet keeps of each row group are then close in every
    column, so a filter on any of them reads few groups, where a plain sort helps
    the first column alone.

    Rows of one key, a third of all rows perhaps, are dealt on by a hash of the
    whole row; only copies equal in all columns stay in one task.
    """
    names = list(by)
    if not names:
        return df
    bits = min(RANK_BITS, KEY_BITS // len(names))
    if bits < 2:
        raise ValueError(f"at most {KEY_BITS // 2} columns to cluster by, not {len(names)}")
    # quantiles leave one rank free for what is no number
    ranks = (1 << bits) - 1
    own = f"_{uuid.uuid4().hex}"
    numbered = df.select("*", *[_number(df, n).alias(f"{own}_n{i}") for i, n in enumerate(names)])
    shares = [i / ranks for i in range(1, ranks)]
    cuts = df.agg(*[
        F.percentile_approx(F.nanvl(_number(df, n), F.lit(None).cast("double")), shares, 10000).alias(f"c{i}")
        for i, n in enumerate(names)
    ]).first()
    splits = [[-math.inf, *sorted({c for c in found or [0.0] if math.isfinite(c)} or {0.0}), math.inf] for found in cuts]
    ranked = Bucketizer(
        splitsArray=splits, handleInvalid="keep",
        inputCols=[f"{own}_n{i}" for i in range(len(names))], outputCols=[f"{own}_r{i}" for i in range(len(names))],
    ).transform(numbered)
    key = reduce(Column.bitwiseOR, [
        F.shiftleft(F.shiftright(F.col(f"{own}_r{i}").cast("long"), b).bitwiseAND(F.lit(1)), b * len(names) + i)
        for b in range(bits) for i in range(len(names))
    ])
    keyed = ranked.select(*df.columns, key.alias(f"{own}_key"), F.xxhash64(*df.columns).alias(f"{own}_row"))
    order = [f"{own}_key", f"{own}_row"]
    dealt = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).drop(*order)
