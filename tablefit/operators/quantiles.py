"""Exact quantiles of many numeric columns at once, by radix selection.

Columns are unpivoted to (column, value).  A digit that rises with the value
deals the values of each wanted rank to buckets; one aggregate counts all
buckets of all columns, and each rank moves into its bucket.  The first digit is
the sign and the binary exponent, the following ones cut the bucket's interval
into equal steps.  An interval shrinks to one value within a few passes whatever
the distribution, as all values of a bucket have one exponent from the second
pass on.  The answer is the value at the rank, never an interpolation.

Plans are of a fixed size: intervals are rows of a small table, joined on the
column, and not predicates, so the number of columns does not matter.  A task
holds at most one row per bucket, and a hot value is one bucket.

`approximate_quantiles` reads the rows once: tasks sort blocks of rows and keep
values of even ranks from them, each with the number of values it stands for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps that a bucket's interval is cut into by one pass.
STEPS = 4096
#: Rows that a task sorts at a time for approximate quantiles.
BLOCK_ROWS = 1 << 16
#: Beyond every exponent of a double, for the infinities.
_FAR = 5000


@dataclass
class _Target:
    """The `rank`-th smallest of the column's values from `low` to `high`, both included.

    Without a rank it is the value at `share` of the rows.  A `wide` interval is
    only believed to hold the rank; all values are counted.
    """

    column: str
    rank: int | None = None
    share: float | None = None
    low: float = -math.inf
    high: float = math.inf
    fresh: bool = True
    wide: bool = False
    value: float | None = None


def exact_quantiles(
    df: DataFrame, probabilities: Mapping[str, Sequence[float]], steps: int = STEPS
) -> dict[str, list[float | None]]:
    """Per column the smallest value whose cumulative share reaches each
    probability; nulls and NaN are left out, and a column without values gives
    nulls."""
    names = list(probabilities)
    if not names:
        return {}
    targets = {c: [_Target(c, share=p) for p in probabilities[c]] for c in names}
    _select(_values(df, names), names, [t for ts in targets.values() for t in ts], steps)
    return {c: [t.value for t in ts] for c, ts in targets.items()}


def _thinned(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `size` of the rising values, each with the count of its run; runs are of about equal counts."""
    if len(values) <= size:
        return values, counts
    upto = np.cumsum(counts)
    # the run of a value is that of its middle place
    run = ((upto - counts / 2) * (size / upto[-1])).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    totals = np.add.reduceat(counts, first)
    # each run is told by the value at its own middle
    return values[np.searchsorted(upto, upto[first] - counts[first] + (totals + 1) // 2)], totals


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = (np.concatenate(side) for side in zip(*parts))
    order = np.argsort(values, kind="stable")
    return values[order], counts[order]


_SUMMARY = "column int, values array<double>, counts array<long>"


def _summaries(width: int, size: int, block_rows: int):
    """A row per column and task: values of even ranks, and how many each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
        held: list[np.ndarray] = []

        def sort_held() -> None:
            block = np.concatenate(held, axis=1)
            held.clear()
            for i, column in enumerate(block):
                values = np.sort(column[~np.isnan(column)])
                if len(values):
                    kept[i].append(_thinned(values, np.ones(len(values), np.int64), size))

        for batch in batches:
            if batch.num_rows:
                # nulls become NaN
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                held.append(values.astype(float, copy=False).reshape(-1, width).T)
            if sum(b.shape[1] for b in held) >= block_rows:
                sort_held()
        if held:
            sort_held()
        for i, parts in enumerate(kept):
            if parts:
                values, counts = _thinned(*_merged(parts), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([values], pa.list_(pa.float64())), pa.array([counts], pa.list_(pa.int64()))],
                    ["column", "values", "counts"],
                )

    return run


def _at(shares: Sequence[float]):
    def run(summaries: pa.Table) -> pa.Table:
        values, counts = (summaries[c].combine_chunks().flatten().to_numpy() for c in ("values", "counts"))
        values, counts = _merged([(values, counts)])
        upto = np.cumsum(counts)
        ranks = [max(1, math.ceil(share * upto[-1])) for share in shares]
        found = values[np.searchsorted(upto, ranks)]
        return pa.table({"column": summaries["column"][:1], "found": pa.array([found], pa.list_(pa.float64()))})

    return run


def approximate_quantiles(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float], rel_error: float
) -> dict[str, list[float | None]]:
    """Per column a value whose rank is within `rel_error` of the rows at each probability; nulls and NaN are left
    out, and a column without values gives nulls.

    One pass over the rows for all columns.  A task hands on at most 2 / `rel_error` values a column; up to so many
    values in a task are all kept, and thinning happens twice at most, for a block and for a task.
    """
    if not names:
        return {}
    size = 2 * math.ceil(1 / rel_error)
    # one array a row: Spark asks each column it hands to Python for its size after every row
    doubles = df.select(F.array(*[F.col(n).cast("double") for n in names]).alias("values"))
    parts = doubles.mapInArrow(_summaries(len(names), size, BLOCK_ROWS), _SUMMARY)
    found = parts.groupBy("column").applyInArrow(_at(list(probabilities)), "column int, found array<double>")
    values = {r.column: r.found for r in found.collect()}
    return {n: values.get(i, [None] * len(probabilities)) for i, n in enumerate(names)}


def order_statistic(
    df: DataFrame, name: str, rank: int, guess: tuple[float, float] | None = None, steps: int = STEPS
) -> float:
    """The `rank`-th smallest value of a column.

    `guess` is an interval believed to hold it; a wrong one costs a pass, not
    the result.
    """
    target = _Target(name, rank)
    if guess:
        (target.low, target.high), target.fresh, target.wide = guess, False, True
    _select(_values(df, [name]), [name], [target], steps)
    return target.value


def _values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value): a row per number, columns by their place in `names`."""
    places = [f"v{i}" for i in range(len(names))]
    doubles = df.select(*[F.col(n).cast("double").alias(p) for n, p in zip(names, places)])
    stacked = doubles.select(F.posexplode(F.array(*places)).alias("column", "value"))
    return stacked.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _first_digit(value: Column) -> Column:
    """Sign and binary exponent in the order of the values.

    Logarithms never fall where their argument rises, and no more is needed.
    """
    size = F.abs(value)
    power = F.when(size == math.inf, float(_FAR)).otherwise(F.floor(F.log2(size)).cast("double") + 2000.0)
    return F.when(value == 0, 0.0).when(value > 0, power).otherwise(-power).cast("int")


def _next_digit(value: Column, low: Column, high: Column, steps: int) -> Column:
    """Place of the value among equal steps from `low` to `high`; the ends have steps of their own."""
    share = (value - low) / F.when(high > low, high - low).otherwise(1.0)
    step = F.floor(share * (steps - 2)).cast("int") + 1
    outside = F.when(value < low, -1).when(value > high, steps + 1)
    return outside.when(value == low, 0).when(value == high, steps).otherwise(step)


def _select(values: DataFrame, names: Sequence[str], targets: list[_Target], steps: int) -> None:
    """Settle the targets; one of a column without values keeps None."""
    spark, place = values.sparkSession, {n: i for i, n in enumerate(names)}
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    pending = list(targets)
    while pending:
        # targets of one interval share its buckets; a row per interval and per wanted rank
        intervals = list(dict.fromkeys((place[t.column], t.low, t.high, t.fresh, t.wide) for t in pending))
        of = [intervals.index((place[t.column], t.low, t.high, t.fresh, t.wide)) for t in pending]
        asked = spark.createDataFrame(
            [(i, *interval) for i, interval in enumerate(intervals)],
            "interval int, column int, low double, high double, fresh boolean, wide boolean",
        )
        ranks = spark.createDataFrame(
            [(i, j, t.rank, t.share) for j, (i, t) in enumerate(zip(of, pending))],
            "interval int, target int, rank long, share double",
        )
        inside = values.join(F.broadcast(asked), "column").where(F.col("wide") | value.between(low, high))
        digit = F.when(F.col("fresh"), _first_digit(value)).otherwise(_next_digit(value, low, high, steps))
        buckets = inside.groupBy("interval", digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        # each of these windows has at most a row per bucket
        every = Window.partitionBy("interval")
        counted = buckets.withColumns({"upto": F.sum("n").over(every.orderBy("digit")), "rows": F.sum("n").over(every)})
        by_share = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("rows")))
        ranked = counted.join(F.broadcast(ranks), "interval").withColumn("rank", F.coalesce("rank", by_share))
        holding = ranked.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        found = {r.target: r for r in holding.collect()}
        still = []
        for j, t in enumerate(pending):
            if j not in found:
                if t.fresh:
                    continue
                raise ArithmeticError("values differ between passes; write the table first")
            bucket = found[j]
            if bucket.low == bucket.high:
                t.value = bucket.low
                continue
            t.rank = bucket["rank"] - (bucket.upto - bucket.n)
            t.low, t.high, t.fresh, t.wide = bucket.low, bucket.high, False, False
            still.append(t)
        pending = still
