"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint holds the majority vote of its word shingles' XXH64.
Fingerprints link at `max_bits` differing bits or fewer.  Each is cut into
segments; two that link differ in few bits of at least one segment.  Both sides
enumerate the Hamming ball of half that radius within the segment, so that
their balls meet in a key of the index; what meets is verified on all 64 bits.

Equal fingerprints are one node from the start, so copies cost one row each.
Keys that many fingerprints share are compared block against block over several
tasks, and tasks return spanning links, not pairs.

Tables of fingerprints and ids meet by shuffles at every size; none is broadcast,
so that the driver holds no part of them.

Defined cases: a null or blank text has no word and fingerprint 0, which links
like any other.  Fewer words than a shingle: the whole sequence is one.  Rows
that repeat an id are fingerprinted apart; null ids take part and are never
the smallest of a component with known ids.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import Links, text_slices, whole_runs
from tablefit.llm.columns import kept, texts
from tablefit.llm.components import components

SEED = 42
BLOCK = 2048
FINGERPRINT_SCHEMA = "doc_id long, fp long"


def fingerprint(text: str, k: int = 4, chunk: int = 1 << 14) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1:]
    else:
        starts, ends = [0], [len(joined)]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), chunk):
        found = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at:at + chunk], ends[at:at + chunk])], "<u8"
        )
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [fingerprint(t, k) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(found, "u8").view("i8"))], ["doc_id", "fp"]
                )
    return run


def segments(max_bits: int) -> tuple[list[tuple[int, int]], int]:
    """(shift, width) of each segment and the radius that each side enumerates in it.

    With two segments, one of them differs in at most max_bits // 2 bits, and
    two balls of half that radius (rounded up) meet.
    """
    return [(32, 32), (0, 32)], -(-(max_bits // 2) // 2)


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of at most `radius` set bits."""
    return np.array(
        [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], "u8"
    )


def index_rows(max_bits: int):
    parts, radius = segments(max_bits)
    masks = [ball(width, radius) for _, width in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                signed = batch.column("fp").slice(at, 2048).to_numpy()
                fp = signed.view("u8")
                for (shift, width), mask in zip(parts, masks):
                    value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    key = value[:, None] ^ mask[None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(key.size, shift, "i4")), pa.array(key.ravel().view("i8")),
                         pa.array(np.repeat(signed, len(mask)))],
                        ["segment", "key", "fp"],
                    )
    return run


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a.view("u8") ^ b.view("u8")) <= max_bits


def _cross(left: np.ndarray, right: np.ndarray, max_bits: int, links: Links) -> None:
    """Links of each row on the left to those on the right, 256 rows at a time."""
    for at in range(0, len(left), 256):
        part = left[at:at + 256]
        i, j = np.nonzero(_near(part[:, None], right[None, :], max_bits))
        links.add(part[i], right[j])


def run_links(max_bits: int, short: int = 32):
    """Links within each run of one key; of long runs only within blocks, the rest by block_links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table, starts in whole_runs(batches, ("segment", "key", "block")):
            fp = table.column("fp").to_numpy()
            sizes = np.diff(starts)
            size_of = np.repeat(sizes, sizes)
            rank = np.arange(len(fp)) - np.repeat(starts[:-1], sizes)
            for step in range(1, min(short, int(sizes.max()))):
                i = np.flatnonzero((rank + step < size_of) & (size_of <= short))
                i = i[_near(fp[i], fp[i + step], max_bits)]
                links.add(fp[i], fp[i + step])
            for r in np.flatnonzero(sizes > short):
                part = fp[starts[r]:starts[r + 1]]
                _cross(part, part, max_bits, links)
        yield from links.batches()
    return run


def block_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table, starts in whole_runs(batches, ("segment", "key", "low", "high")):
            fp, block = table.column("fp").to_numpy(), table.column("block").to_numpy()
            low = table.column("low").to_numpy()
            for s, e in zip(starts[:-1], starts[1:]):
                in_low = block[s:e] == low[s]
                _cross(fp[s:e][in_low], fp[s:e][~in_low], max_bits, links)
        yield from links.batches()
    return run


def near_links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints (fp) within `max_bits` bits."""
    index = distinct.select("fp").mapInArrow(index_rows(max_bits), "segment int, key long, fp long")
    shared = index.groupBy("segment", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A key of n fingerprints is dealt to n / BLOCK blocks by a hash of the fingerprint.
    rows = index.join(shared.hint("merge"), ["segment", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("blocks"))
    )
    within = rows.repartition("segment", "key", "block").sortWithinPartitions("segment", "key", "block")
    large = rows.where("blocks > 1")
    across = (
        large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("other != block")
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .select("segment", "key", "low", "high", "block", "fp")
        .repartition("segment", "key", "low", "high")
        .sortWithinPartitions("segment", "key", "low", "high")
    )
    return within.select("segment", "key", "block", "fp").mapInArrow(run_links(max_bits), "a long, b long").union(
        across.mapInArrow(block_links(max_bits), "a long, b long")
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and the smallest id it reaches."""
    if not 0 <= max_bits <= 5:
        raise ValueError("balls grow with the distance; up to 5 bits are supported")
    marked = kept(texts(docs, id_col, text_col).mapInArrow(fingerprints(k), FINGERPRINT_SCHEMA), "simhash")
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("lead")), "simhash-distinct")
    reached = components(near_links(distinct, max_bits)).withColumnRenamed("node", "fp")
    rooted = kept(
        distinct.join(reached.hint("merge"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def leave_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, all their columns, of the smallest id of each of the groups (id, component_id).

    Rows that repeat an id stay or go together: they stay if one of them does.
    Rows without an id stay.
    """
    gone = groups.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max(F.col(id_col) == F.col("component_id")).alias("stays")
    ).where("not stays")
    return docs.join(gone.select(id_col).hint("merge"), id_col, "left_anti").select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents, all their columns, of the smallest id of each group; see `leave_one`."""
    return leave_one(docs, simhash_groups(docs.select(id_col, text_col), id_col, text_col, k, max_bits), id_col)
