"""Near-duplicate embeddings by sorted projection passes.

Each pass hashes a vector by the signs of random projections, concatenated to
one number, orders all vectors of a label by it, and compares each with its
neighbours in that order, also across the ranges that tasks hold; what is verified by cosine is united across passes.
Passes only have to connect what belongs together: at the end the members of
each component are compared with each other, block against block, so the link
counts of a component are exact however many its members are.

Equal vectors of a label are one class from the start and cost one row each.
Tasks return spanning links, not pairs; blocks of a large component are
compared in different tasks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
numbers, and rows whose label or id is null, link with nothing and are kept, as
their own component.  Vectors of different lengths do not link.  Rows that
repeat an id and vector count as links of each other.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import Links, whole_runs
from tablefit.llm.columns import kept
from tablefit.llm.components import components

PASSES = 12
BITS = 48
WINDOW = 64
BLOCK = 1024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # first by the largest number, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def projections(width: int, seed: int, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng((seed, width)).standard_normal((width, bits))


def hashed(passes: int, seed: int):
    """For each pass a row (pass, label, width, code, rep, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.left_shift(np.int64(1), np.arange(BITS, dtype=np.int64))[::-1]
        for table, starts in _by_width(batches):
            for s, e in zip(starts[:-1], starts[1:]):
                part = table.slice(s, e - s).combine_chunks()
                width = part.column("width")[0].as_py()
                units = _matrix(part.column("vec"))
                for p in range(passes):
                    if (p, width) not in planes:
                        planes[p, width] = projections(width, seed + p)
                    code = ((units @ planes[p, width]) > 0) @ weights
                    yield from pa.table({
                        "pass": pa.array(np.full(e - s, p, "i4")), "label": part.column("label"),
                        "width": part.column("width"), "code": pa.array(code.astype("i8")),
                        "rep": part.column("rep"), "vec": part.column("vec"),
                    }).combine_chunks().to_batches()
    return run


def _by_width(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = pa.Table.from_batches([batch.slice(at, most)]).sort_by("width")
            width = part.column("width").to_numpy()
            yield part, np.concatenate(([0], np.flatnonzero(np.diff(width)) + 1, [len(width)])).astype(np.int64)


LINKS = "a long, b long, part int, at long, pass int, label long, width int, vec array<double>"
EDGE = ("part", "at", "pass", "label", "width", "vec")


def neighbour_links(least: float, window: int, keys: tuple[str, ...] = ("pass", "label", "width")):
    """Links (a, b) of each row to at least the `window` rows before it of its keys.

    A task does not see the rows before its first.  So it also gives its first
    and last `window` rows (a: rep, b: null) with their places `at` in the task
    `part`, and a row without a vector whose place is the number of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, key = Links(), None
        held = reps = None
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at < window:
                yield _edge_rows(batch.slice(0, window - at), part, at)
            if at + batch.num_rows > window:
                later = pa.Table.from_batches([batch.slice(max(0, window - at))])
                last = later if last is None else pa.concat_tables([last, later])
                last = last.slice(max(0, last.num_rows - window)).combine_chunks()
            at += batch.num_rows
            values = np.stack([batch.column(c).to_numpy().astype("i8") for c in keys])
            edges = np.concatenate(([0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            for s, e in zip(edges[:-1], edges[1:]):
                if key != tuple(values[:, s]):
                    key, held = tuple(values[:, s]), None
                units, ids = _matrix(batch.column("vec").slice(s, e - s)), batch.column("rep").to_numpy()[s:e]
                before = 0 if held is None else len(held)
                if before:
                    units, ids = np.concatenate((held, units)), np.concatenate((reps, ids))
                for row in range(before, len(ids), 256):
                    low = max(0, row - window)
                    i, j = np.nonzero(units[row:row + 256] @ units[low:row + 256].T >= least)
                    i, j = i + row, j + low
                    before_it = j < i
                    links.add(ids[i[before_it]], ids[j[before_it]])
                held, reps = units[-window:], ids[-window:]
        for found in links.batches():
            empty = [pa.nulls(found.num_rows, t) for t in _EDGE_TYPES]
            yield pa.RecordBatch.from_arrays([found.column("a"), found.column("b"), *empty], ["a", "b", *EDGE])
        if last is not None:
            for rows in last.to_batches():
                yield _edge_rows(rows, part, at - last.num_rows)
        if at:
            size = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([at], pa.int64())]
            yield pa.RecordBatch.from_arrays(size + [pa.nulls(1, t) for t in _EDGE_TYPES[2:]], ["a", "b", *EDGE])
    return run


_EDGE_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()))


def _edge_rows(rows: pa.RecordBatch, part: int, at: int) -> pa.RecordBatch:
    n = rows.num_rows
    places = [pa.array(np.full(n, part, "i4")), pa.array(np.arange(at, at + n))]
    own = [rows.column(c) for c in ("pass", "label", "width", "vec")]
    return pa.RecordBatch.from_arrays([rows.column("rep"), pa.nulls(n, pa.int64()), *places, *own], ["a", "b", *EDGE])


def window_links(ordered: DataFrame, least: float, window: int) -> DataFrame:
    """Links (a, b) of each row of sorted ranges to at least the `window` rows before it, whichever task they are in.

    Only the number of rows of each task comes to the driver.  The first rows of
    each task meet the last ones of the tasks before it, so at most
    2 * `window` rows a task move once more.
    """
    found = kept(ordered.mapInArrow(neighbour_links(least, window), LINKS), "neighbour-links")
    inside = found.where("part is null").select("a", "b")
    sizes = sorted((r.part, r.at) for r in found.where("part is not null and vec is null").select("part", "at").collect())
    if len(sizes) < 2:
        return inside
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    targets = []
    for i, (part, _) in enumerate(sizes):
        after = i + 1
        # tasks of few rows let a window reach beyond the next task
        while after < len(sizes) and starts[after] - starts[i + 1] < window:
            after += 1
        targets += [(part, starts[i], j, starts[j]) for j in range(i, after)]
    met = found.sparkSession.createDataFrame(targets, "part int, start long, target int, first long")
    place = F.col("start") + F.col("at")
    rows = found.where("vec is not null").join(F.broadcast(met), "part").withColumn("place", place).where(
        F.col("place").between(F.col("first") - window, F.col("first") + window - 1)
    )
    # of a later task's own rows, only itself gives the first ones
    rows = rows.where((F.col("place") < F.col("first")) | (F.col("start") == F.col("first"))).select(
        "target", "place", "pass", "label", "width", F.col("a").alias("rep"), "vec"
    )
    across = rows.repartition("target").sortWithinPartitions("target", "place").mapInArrow(
        neighbour_links(least, window, ("target", "pass", "label", "width")), LINKS
    )
    return inside.union(across.where("part is null").select("a", "b"))


def counted_links(least: float):
    """Per row of a block pair (root, low, high): the weight it links to in the other block (its own, if one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ("root", "low", "high")):
            low, high, block, weight, rep = (table.column(c).to_numpy() for c in ("low", "high", "block", "n", "rep"))
            vectors = table.column("vec").combine_chunks()
            for s, e in zip(starts[:-1], starts[1:]):
                units = _matrix(vectors.slice(s, e - s))
                found = np.empty(e - s, np.int64)
                if low[s] == high[s]:
                    everyone = np.arange(e - s)
                    sides = [(everyone, everyone)]
                else:
                    a, b = np.flatnonzero(block[s:e] == low[s]), np.flatnonzero(block[s:e] != low[s])
                    sides = [(a, b), (b, a)]
                for own, other in sides:
                    near = units[own] @ units[other].T >= least
                    found[own] = near @ weight[s:e][other]
                    if own is other:
                        found[own] -= near.diagonal() * weight[s:e]
                yield pa.RecordBatch.from_arrays([pa.array(rep[s:e]), pa.array(found)], ["rep", "links"])
    return run


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.98, passes: int = PASSES, window: int = WINDOW, seed: int = 42,
) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept (the smallest id of its component)."""
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), numbers.alias("vec")
    )
    limit = F.lit(float("inf"))
    usable = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
        & F.exists("vec", lambda x: x != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # 0.0 and -0.0 are one number
    same = F.transform("vec", lambda x: x + F.lit(0.0))
    classes = kept(
        rows.where("usable").withColumn("vec", same).groupBy("label", "vec").agg(
            F.min("id").alias("least"), F.count("*").alias("n")
        ).withColumns({"width": F.size("vec"), "rep": F.monotonically_increasing_id()}),
        "vector-classes",
    )
    # rep numbers the classes; written once, the numbers stay
    schema = "pass int, label long, width int, code long, rep long, vec array<double>"
    order = ("pass", "label", "width", "code", "rep")
    found = classes.select("label", "width", "rep", "vec").mapInArrow(hashed(passes, seed), schema)
    links = window_links(found.repartitionByRange(*order).sortWithinPartitions(*order), least, window)
    reached = kept(components(links), "vector-components").withColumnRenamed("node", "rep")
    sizes = reached.groupBy("root").agg(F.count("*").alias("size"))
    members = classes.join(reached, "rep").join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    paired = (
        members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .select("root", "low", "high", "block", "rep", "n", "vec")
        .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    )
    counts = paired.mapInArrow(counted_links(least), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    smallest = classes.join(reached, "rep").groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = reached.join(counts, "rep").join(smallest, "root").select("rep", "links", "component_id")
    per_class = kept(
        classes.join(grouped, "rep", "left").select(
            "label", "vec",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        ),
        "vector-groups",
    )
    linked = rows.where("usable").withColumn("vec", same).join(per_class, ["label", "vec"]).select(
        "id", "n_links", "component_id"
    )
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
