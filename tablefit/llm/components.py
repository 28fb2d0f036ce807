"""Connected components of a table of links, by alternating star steps on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import Links
from tablefit.llm.columns import kept


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the links (a, b) as stars, no more links than nodes."""
    links = Links()
    for batch in batches:
        links.add(batch.column("a").to_numpy(), batch.column("b").to_numpy())
    yield from links.batches()


def _large_star(links: DataFrame) -> DataFrame:
    """The definition by joins, that `_star_step` is tested against."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m")
    )
    return both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("w")).select(
        F.col("v").alias("a"), F.col("m").alias("b")
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """The definition by joins, that `_star_step` is tested against."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least.withColumnRenamed("u", "w").hint("merge"), F.col("u") == F.col("w")).where("v > m")
    return to_least.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _stars(large: bool):
    """Links of each node u to the least of its neighbours, from rows (u, v) sorted by both.

    Large: u is a neighbour too, and each v above u is linked.  Small: all v are
    below u, and u and the others are linked.  Only the least of the node at
    hand is held, however many links it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = low = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            first = np.concatenate(([u[0] != node], u[1:] != u[:-1]))
            new = first | np.concatenate(([v[0] != last], v[1:] != v[:-1]))
            starts = np.union1d([0], np.flatnonzero(first))
            least = np.minimum(u[starts], v[starts]) if large else v[starts].copy()
            if not first[0]:
                least[0] = low
            m = np.repeat(least, np.diff(np.append(starts, len(u))))
            node, low, last = u[-1], m[-1], v[-1]
            others = new & (v > (u if large else m))
            parts = [(v[others], m[others])] if large else [(u[first], m[first]), (v[others], m[others])]
            a, b = (np.concatenate(side) for side in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def _star_step(links: DataFrame, large: bool) -> DataFrame:
    """What `_large_star` or `_small_star` gives, by one shuffle and one sort; a link may come more than once."""
    if large:
        rows = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        rows = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    rows = rows.where("u != v").repartition("u").sortWithinPartitions("u", "v")
    return rows.mapInArrow(_stars(large), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b: long), with the smallest node that it reaches.

    Each round reads a written table.  The number of rounds follows the
    logarithm of the longest chain.  A star step is one shuffle and one sort,
    without joins, hash maps or broadcasts: each of these holds a page of memory
    in every task, however few its links, or a table on the driver.  A step
    gives no more links than it reads; the stars at the end are distinct.
    """
    links = kept(links.mapInArrow(spanning, "a long, b long"), "links")
    before = None
    while True:
        links = kept(_star_step(_star_step(links, True), False), "links")
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b"), F.col("b")).distinct()
    )
