"""Whitening of embeddings over distinct vectors, weighted by how often they occur.

Entries become whole numbers x = floor(steps * entry) + offset.  Identical x
vectors are one class with a count, which is its weight in the fit (or each
class weighs one).  Each task subtracts the mean and multiplies its weighted
block of classes, so a task hands on one matrix and not its rows; the matrices
are added on Spark.  Each class is whitened once and joined back to its rows.

The mean is exact: sums of x are whole numbers.  What the driver holds is one
vector and one matrix per length of vector that occurs.

Defined cases: rows whose vector is null, empty or holds null or non-finite
entries, or entries so large that steps * entry is beyond 2**40, are left out.
Vectors of different lengths are whitened apart, each length with its own n.  A
component without variance (for instance where all vectors are equal) has no
whitened value and is left out, so fewer than `most` may come back.  Rows that
repeat an id, and rows without one, come back as often as they are there.  A
deviation beyond a long is null.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.columns import kept
from tablefit.llm.skewed import meet

STEPS = 64
OFFSET = 1_000_000
MOST = 32
_LARGEST = float(1 << 40)
#: Variances below this share of the whole are rounding.
_FLAT = 1e-12
#: Classes in one product.
_BLOCK = 4096

COUNTS, ONE = "counts", "one"


@dataclass
class Fit:
    """n x-vectors of one length with their sums and covariance, and the components kept of it."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    def __post_init__(self) -> None:
        # the mean as a whole number and a rest, so that x loses nothing when centred
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def solve(self, most: int) -> Fit:
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(values)[::-1][:most]
        order = order[values[order] > _FLAT * max(np.trace(self.covariance), 0.0)]
        self.values, self.vectors = values[order], vectors[:, order]
        self.explained = self.values / np.trace(self.covariance)
        return self

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S) squared, exact."""
        shift = [s - self.n * int(b) for s, b in zip(self.sums, self.base)]
        y = x - self.base
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        kind = np.int64 if largest**2 * x.shape[1] < 1 << 62 else object
        apart = y.astype(kind) * self.n - np.array(shift, kind)
        found = (apart * apart).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]


def _blocks(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """Rows of one vector length, with their vectors as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = pa.Table.from_batches([batch.slice(at, _BLOCK)]).sort_by("width")
            width = part.column("width").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(width)) + 1, [len(width)]))
            for s, e in zip(edges[:-1], edges[1:]):
                if s < e:
                    rows = part.slice(s, e - s)
                    matrix = rows.column(vector).combine_chunks().flatten().to_numpy().reshape(e - s, -1)
                    yield int(width[s]), rows, matrix


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length a row (width, place, n, s) for each place: its weight and weighted sum of x."""
    found: dict[int, list] = {}
    for width, rows, x in _blocks(batches, "x"):
        weight = rows.column("weight").to_numpy()
        small = float(np.abs(x).max()) * float(weight.sum()) < 2.0**62
        total = weight @ x if small else weight.astype(object) @ x.astype(object)
        n, s = found.get(width, (0, [0] * width))
        found[width] = n + int(weight.sum()), [a + int(b) for a, b in zip(s, total)]
    for width, (n, s) in found.items():
        yield pa.RecordBatch.from_pydict({
            "width": pa.array([width] * width, "int32"), "place": pa.array(range(width), "int32"),
            "n": pa.array([n] * width, "int64"), "s": pa.array([str(v) for v in s]),
        })


def _products(centre, vector: str):
    """Per task and length a row (width, i, v) for each line of the weighted product of its centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for width, rows, matrix in _blocks(batches, vector):
            z = centre(width, matrix)
            product = (z * rows.column("weight").to_numpy()[:, None]).T @ z
            found[width] = found[width] + product if width in found else product
        for width, product in found.items():
            lines = pa.array(product.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * len(product), "int32"), pa.array(range(len(product)), "int32"), lines], ["width", "i", "v"]
            )
    return run


def _added(products: DataFrame, size: dict[int, int], n: dict[int, int]) -> dict[int, np.ndarray]:
    """The tasks' products, added on Spark and divided by n; a number per pair of places comes to the driver."""
    lines = products.select("width", "i", F.posexplode("v").alias("j", "v"))
    found = {w: np.zeros((k, k)) for w, k in size.items()}
    for r in lines.groupBy("width", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[r.width][r.i, r.j] = r.v / n[r.width]
    return found


def _whitened(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, rows, x in _blocks(batches, "x"):
            fit = fits[width]
            white = fit.centred(x) @ fit.vectors / np.sqrt(fit.values)
            yield from pa.table({
                **{c: rows.column(c) for c in ("key1", "key2", "n", "weight", "width")},
                "deviation": pa.array(fit.deviations(x), "int64"),
                "white": pa.array(white.tolist(), pa.list_(pa.float64())),
            }).combine_chunks().to_batches()
    return run


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST,
    weights: str = COUNTS, steps: int = STEPS, offset: int = OFFSET,
) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    `weights` COUNTS fits on all vectors, ONE on each distinct one once.
    """
    if weights not in (COUNTS, ONE):
        raise ValueError(f"no such weights: {weights}")
    spark = vectors.sparkSession
    scaled = F.transform(F.col(vector_col), lambda c: c.cast("double") * float(steps))
    usable = (F.size("scaled") > 0) & F.forall(
        "scaled", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST)
    )
    x = F.transform("scaled", lambda c: F.floor(c) + F.lit(offset).cast("long"))
    rows = kept(
        vectors.select(F.col(id_col).alias("id"), scaled.alias("scaled")).where(usable).select("id", x.alias("x")), "whitening-rows"
    )
    # 128 bits stand for a vector where rows meet their class
    keys = [F.xxhash64(F.lit(i), F.size("x"), "x").alias(f"key{i}") for i in (1, 2)]
    counted = rows.groupBy("x").agg(F.count("*").alias("n"))
    weight = F.col("n") if weights == COUNTS else F.lit(1).cast("long")
    classes = kept(
        counted.select("x", "n", weight.alias("weight"), F.size("x").alias("width"), *keys), "whitening-classes"
    )
    tasks = classes.select("width", "weight", "x")
    sums = tasks.mapInArrow(_sums, "width int, place int, n long, s string").groupBy("width", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("width", "place").collect():
        totals.setdefault(r.width, (r.n, []))[1].append(int(r.s))
    fits = {w: Fit(n, s, np.zeros((w, w))) for w, (n, s) in totals.items()}
    products = tasks.mapInArrow(_products(lambda w, x: fits[w].centred(x), "x"), "width int, i int, v array<double>")
    covariances = _added(products, {w: w for w in fits}, {w: f.n for w, f in fits.items()})
    fits = {w: Fit(f.n, f.sums, covariances[w]).solve(most) for w, f in fits.items()}
    white = kept(
        classes.mapInArrow(
            _whitened(fits), "key1 long, key2 long, n long, weight long, width int, deviation long, white array<double>"
        ),
        "whitened",
    )
    errors = _identity_errors(white, fits)
    schema = "width int, fitted long, explained array<double>, identity_error double"
    # a row per length of vector
    fitted = spark.createDataFrame([(w, f.n, f.explained.tolist(), errors[w]) for w, f in fits.items()], schema)
    per_class = white.select("key1", "key2", "n", "width", "deviation", "white")
    met = meet(rows.select("id", *keys), per_class, ["key1", "key2"], "n", rows.count()).join(F.broadcast(fitted), "width")
    entries = met.select(
        "id", "fitted", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "explained")).alias("place", "entry")
    )
    return entries.select(
        F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.col("fitted").alias("n"), "deviation",
        F.col("entry.white").alias("whitened"), F.col("entry.explained").alias("explained"), "identity_error",
    )


def _identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length the largest entry of the whitened vectors' covariance minus the identity."""
    n = {w: f.n for w, f in fits.items()}
    size = {w: len(f.values) for w, f in fits.items()}
    some = white.where(F.size("white") > 0)
    places = some.select("width", "weight", F.posexplode("white").alias("i", "v"))
    means = {w: np.zeros(k) for w, k in size.items()}
    for r in places.groupBy("width", "i").agg(F.sum(F.col("v") * F.col("weight")).alias("v")).collect():
        means[r.width][r.i] = r.v / n[r.width]
    products = some.select("width", "weight", "white").mapInArrow(
        _products(lambda w, v: v - means[w], "white"), "width int, i int, v array<double>"
    )
    found = _added(products, size, n)
    return {w: float(np.abs(found[w] - np.eye(k)).max(initial=0.0)) for w, k in size.items()}
