"""Counts, distributions and group summaries.

All aggregates combine on the map side, so a value that holds a third of all
rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.operators.filters import keep_not_null
from tablefit.operators.quantiles import exact_quantiles


def row_count(df: DataFrame, name: str = "total_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def percentile_name(p: float) -> str:
    return "median" if p == 0.5 else f"p{p * 100:g}".replace(".", "_")


def distribution(
    df: DataFrame,
    col: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    accuracy: int = 10_000,
    exact: bool = False,
    std: bool = False,
    minimum: bool = False,
    maximum: bool = True,
    digits: int = 2,
) -> DataFrame:
    """One row: count, rounded mean, percentiles, and on request the sample
    standard deviation, minimum and maximum of the values; null and NaN are none.

    Percentiles are approximate within 1/`accuracy` of the rows, in the same
    pass as the rest.  `exact` takes extra passes and gives the value at the
    exact rank, in bounded memory.
    """
    rows = keep_not_null(df.select(col), col)
    if rows.schema[col].dataType.typeName() in ("double", "float"):
        rows = rows.filter(~F.isnan(col))
    names = [percentile_name(p) for p in probs]
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg(col), digits).alias(f"avg_{col}"),
    ]
    if not exact:
        aggregates += [
            F.percentile_approx(col, p, accuracy).alias(n) for p, n in zip(probs, names)
        ]
    if std:
        aggregates.append(F.round(F.stddev_samp(col), digits).alias(f"stddev_{col}"))
    if minimum:
        aggregates.append(F.min(col).alias(f"min_{col}"))
    if maximum:
        aggregates.append(F.max(col).alias(f"max_{col}"))
    summary = rows.agg(*aggregates)
    if exact:
        found = exact_quantiles(rows, {col: list(probs)})[col]
        kind = rows.schema[col].dataType
        summary = summary.select(
            "*", *[F.lit(v).cast(kind).alias(n) for n, v in zip(names, found)]
        )
    order = ["total", f"avg_{col}", *names]
    return summary.select(*order, *[c for c in summary.columns if c not in order])


def group_summary(
    df: DataFrame, key: str, measure: str, limit: int | None = None, digits: int = 2
) -> DataFrame:
    """Rows and rounded mean of a non-null measure per key, largest groups
    first; equal counts are ordered by key."""
    groups = (
        keep_not_null(df.select(key, measure), measure)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.round(F.avg(measure), digits).alias(f"avg_{measure}"),
        )
        .orderBy(F.desc("total"), F.asc_nulls_last(key))
    )
    return groups if limit is None else groups.limit(limit)


def group_count(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, largest groups first."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), F.asc_nulls_last(key))
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column its position, type, rows and nulls, from a single pass."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows").alias("rows"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*entries)))


def reconcile(before: DataFrame, after: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows per key on both sides and their difference.

    One aggregate over both inputs instead of a join, so null keys match and a
    large key is combined before the shuffle.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = before.select(*names, one.alias("b"), zero.alias("a")).unionByName(
        after.select(*names, zero.alias("b"), one.alias("a"))
    )
    return _differences(sides, names)


def reconcile_counts(before: Mapping[str, int], after: DataFrame, key: str) -> DataFrame:
    """`reconcile` against counts already known, one per key value."""
    zero = F.lit(0).cast("bigint")
    known = [
        F.struct(F.lit(v).alias(key), F.lit(n).cast("bigint").alias("b"), zero.alias("a"))
        for v, n in before.items()
    ]
    sides = after.sparkSession.range(1).select(F.inline(F.array(*known)))
    found = after.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    return _differences(sides.unionByName(found.withColumn("b", zero)), [key])


def row_digest(names: Sequence[str]) -> Column:
    """A 64-bit hash of the row's values as a decimal, nulls told from other values.

    Sums of it do not depend on the order or the partitioning of rows, and
    change where a value does: a digest of a multiset of rows.
    """
    # a hash skips nulls, so each column says first whether it is one
    cells = [x for n in sorted(names) for x in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]
    return F.xxhash64(*cells).cast("decimal(20,0)")


def value_digest(df: DataFrame, key: str, names: Sequence[str] | None = None) -> DataFrame:
    """Rows and digest of all values (or those of `names`) per key."""
    digest = F.sum(row_digest(names or df.columns)).alias("digest")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), digest)


def reconcile_values(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """`reconcile` with a check of values: rows per key on both sides, their difference, and whether
    the rows are the same, in whatever order."""
    zero = F.lit(0)
    sides = [value_digest(df, key, before.columns) for df in (before, after)]
    signs = [(1, 0), (0, 1)]
    both = [
        side.select(
            key, *[(F.col("rows") * s).alias(n) for n, s in zip(("b", "a"), sign)],
            (F.col("digest") * (sign[0] - sign[1])).alias("apart"),
        )
        for side, sign in zip(sides, signs)
    ]
    return both[0].unionByName(both[1]).groupBy(key).agg(
        F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"),
        F.sum(F.col("a") - F.col("b")).alias("difference"),
        ((F.sum("apart") == zero) & (F.sum(F.col("a") - F.col("b")) == zero)).alias("same_values"),
    )


def _differences(sides: DataFrame, names: Sequence[str]) -> DataFrame:
    return sides.groupBy(*names).agg(
        F.sum("b").alias("rows_before"),
        F.sum("a").alias("rows_after"),
        F.sum(F.col("a") - F.col("b")).alias("difference"),
    )
