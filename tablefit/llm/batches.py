"""Helpers inside tasks: whole runs of sorted rows, word hashes and spanning forests in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` characters; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def whole_runs(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by `keys`, in tables that never cut a run of equal keys.

    Yields a table with the places where its runs begin, and its length last.
    A run is held in memory: callers bound its size.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _changes(batch, keys)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield _with_runs(held, keys)
            held = []
        cut = int(starts[-2]) if len(starts) > 2 else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield _with_runs(held, keys)
            held = []
        held.append(batch.slice(cut))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield _with_runs(held, keys)


def _changes(rows: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        column = rows.column(key)
        if column.null_count:
            known = column.is_valid().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_valid().to_numpy()
            new[1:] |= known[1:] != known[:-1]
            column = pc.fill_null(column, 0)
        values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def _with_runs(held: list[pa.RecordBatch], keys: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held)
    return table, _changes(table, keys)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_INVERSE = U64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, base: U64 = _MULTIPLIER) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of texts (runs of other than ASCII space) with their 64-bit hashes.

    `of` is each word's text, `hashes` its hash, `begin` and `end` its place in
    the joined bytes.  Equal words have equal hashes wherever they stand.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool = True):
        joined = b" ".join(texts) + b" "
        if lower:
            joined = joined.lower()
        self.joined = joined
        raw = np.frombuffer(joined, np.uint8)
        space = _SPACE[raw]
        inside = ~space
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.of = np.searchsorted(offsets, self.begin, side="right") - 1
        # any stretch of bytes hashes to (sums[end] - sums[begin]) * back[begin]
        self.sums = sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(_BYTES[raw] * powers(len(raw)), out=sums[1:])
        self.back = back = powers(len(raw) + 1, _INVERSE)
        self.hashes = mix((sums[self.end] - sums[self.begin]) * back[self.begin])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every k-word shingle; a shorter text is one shingle of all its words."""
        n = len(self.hashes)
        if not n:
            return np.empty(0, U64), np.empty(0, np.int64)
        rolling = np.zeros(n, U64)
        width = np.zeros(n, np.int64)
        for i in range(min(k, n)):
            same = self.of[: n - i] == self.of[i:]
            step = mix(self.hashes[i:] + U64(i + 1)) * same.astype(U64)
            rolling[: n - i] += step
            width[: n - i] += same
        first = np.concatenate(([True], self.of[1:] != self.of[:-1]))
        whole = (width == k) | first
        return mix(rolling[whole] + width[whole].astype(U64)), self.of[whole]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as a star per component: each node but the smallest, and that smallest."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = places[: len(a)], places[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class Links:
    """Gathers links of a task and keeps them a forest, so that memory follows the nodes."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.size, self.parts = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.size += len(a)
            if self.size > self.most:
                self._shrink()
                self.most = max(self.most, 2 * self.size)

    def _shrink(self) -> None:
        if self.parts:
            a, b = forest(*(np.concatenate([p[i] for p in self.parts]) for i in (0, 1)))
            self.parts, self.size = [(a, b)], len(a)

    def batches(self, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        self._shrink()
        for a, b in self.parts:
            for i in range(0, len(a), most):
                yield pa.RecordBatch.from_arrays([pa.array(a[i:i + most]), pa.array(b[i:i + most])], ["a", "b"])
