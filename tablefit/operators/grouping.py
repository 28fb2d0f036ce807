"""Keep the most frequent levels of a column and group the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.sources.tables import scratch, written

BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Group:
    column: str
    n: int
    output: str


@dataclass(frozen=True)
class TopNGrouper:
    """Estimator: finds the `n` most frequent levels of each column.

    Equal counts at the cut go to the alphabetically first level.  Null counts
    as a level and uses up a place when it is frequent enough, although no row
    can match it; `null_takes_place=False` leaves it out.
    """

    groups: Sequence[Group]
    other: str = "other"
    null_takes_place: bool = True

    def fit(self, df: DataFrame) -> TopNModel:
        """Count the levels of all columns in one scan, and write the chosen ones.

        Each task hands on its `n` first levels at most, so a column of any
        width is cut before its levels meet.  The levels are written: what
        happens to `df` later changes nothing.
        """
        # the counts go at the end; the chosen levels belong to the model
        with scratch(df.sparkSession, "levels"):
            return self._counted(df)

    def _counted(self, df: DataFrame) -> TopNModel:
        names = list(dict.fromkeys(g.column for g in self.groups))
        counts = (
            df.select(*[F.col(n).cast("string").alias(n) for n in names])
            .unpivot([], names, "column", "level")
            .groupBy("column", "level")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        if not self.null_takes_place:
            counts = counts.filter(F.col("level").isNotNull())
        counts = written(counts, "level-counts")
        chosen = [self._most_frequent(counts, g) for g in self.groups]
        levels = written(reduce(DataFrame.unionAll, chosen), "levels", result=True)
        sizes = dict(levels.groupBy("output").agg(F.sum(F.octet_length("level"))).collect())
        tables = {
            g.output: (levels.filter(F.col("output") == g.output).select("level"), sizes.get(g.output, 0))
            for g in self.groups
        }
        return TopNModel(tuple(self.groups), self.other, tables)

    def _most_frequent(self, counts: DataFrame, group: Group) -> DataFrame:
        own = counts.filter(F.col("column") == group.column)
        top = own.orderBy(F.desc("n"), F.asc_nulls_last("level")).limit(group.n)
        return top.filter(F.col("level").isNotNull()).select(F.lit(group.output).alias("output"), "level")


@dataclass(frozen=True)
class TopNModel:
    groups: tuple[Group, ...]
    other: str
    tables: dict[str, tuple[DataFrame, int]]

    def levels(self, output: str) -> DataFrame:
        return self.tables[output][0]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add each group's output column; all other columns and rows stay."""
        for group in self.groups:
            df = left_join_levels(df, group.column, *self.tables[group.output], "_kept")
            df = df.withColumn(group.output, F.coalesce("_kept", F.lit(self.other))).drop("_kept")
        return df


def left_join_levels(
    df: DataFrame, column: str, table: DataFrame, size: int, output: str
) -> DataFrame:
    """Left outer join of a table to a list of distinct levels; `output` is the
    level, or null where the row has none of them.

    `size` is the list's bytes.  Within bounds it is broadcast, so that a level
    with a third of all rows moves no row.  A longer list is left to Spark,
    which splits a skewed partition of the join at run time.
    """
    right = table.select(F.col("level").alias(output))
    if size <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return df.join(right, F.col(column).cast("string") == F.col(output), "left")
