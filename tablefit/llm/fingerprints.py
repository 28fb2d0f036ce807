"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document, sketches merge by union, and the share of one
sketch found in another estimates containment however unequal the documents
are.  A text of at most SHORT distinct shingles keeps all of them, and the mark
WHOLE after them; two such texts are compared exactly, and with a longer one by
what is below the threshold.  Where no hash of a longer text is below the
threshold (one text in 5000 of 65 shingles, rarer with every further one) the
least hash alone is kept, so that only a text without words has an empty sketch.

Between a short and a longer text there may be no hash to compare; then the
containment of the short one is unknown (null), and the resemblance, at most the
ratio of their numbers of shingles, is given as 0.

Defined cases: null text counts as empty.  Two empty sketches are alike (1), an
empty and another are not (0).  Rows that repeat an id follow each other in the
order of their texts; null ids come first.  One document is its own next.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import U64, Words, text_slices
from tablefit.llm.columns import texts

FIRST = -(1 << 63)
ROWS_PER_PART = 20_000
MOST_PARTS = 10_000
#: Up to so many distinct shingles a text keeps them all.
SHORT = 64
WHOLE = U64((1 << 64) - 1)


def threshold(fraction: float) -> np.uint64:
    return U64(int(fraction * (1 << 64)))


def sketches(texts: Sequence[str], k: int, below: np.uint64) -> list[np.ndarray]:
    """Per text its sketch: sorted distinct hashes, the last one WHOLE if none was left out."""
    words = Words([t.encode("utf-8", "surrogatepass") for t in texts])
    hashes, of = words.shingles(k)
    hashes = np.minimum(hashes, WHOLE - U64(1))
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for s, e in zip(edges[:-1], edges[1:]):
        own = hashes[s:e]
        low = np.unique(own[own < below])
        if len(low) <= SHORT:
            # few enough to be worth counting all
            own = np.unique(own)
            low = _fitting(own, below)
        out.append(low)
    return out


def _fitting(hashes: np.ndarray, below: np.uint64) -> np.ndarray:
    """The sketch of these sorted distinct hashes."""
    if not len(hashes):
        return hashes
    if len(hashes) <= SHORT:
        return np.append(hashes, WHOLE)
    low = hashes[hashes < below]
    return low if len(low) else hashes[:1]


def is_whole(sketch: np.ndarray) -> bool:
    return bool(len(sketch)) and sketch[-1] == WHOLE


def merge(a: np.ndarray, b: np.ndarray, below: np.uint64) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    if not len(a) or not len(b):
        return a if len(a) else b
    if is_whole(a) and is_whole(b):
        return _fitting(np.union1d(a[:-1], b[:-1]), below)
    both = np.union1d(a, b)
    low = both[both < below]
    return low if len(low) else both[:1]


def encode(sketch: np.ndarray) -> str:
    """Hashes in ascending order, 16 hex digits each."""
    return sketch.astype(">u8").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(U64)


def comparable(a: np.ndarray, b: np.ndarray, below: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both that the other would have kept as well."""
    if is_whole(a) and is_whole(b):
        return a[:-1], b[:-1]
    # nothing is left out of an empty sketch
    if is_whole(a):
        a = a[a < below] if len(b) else a[:-1]
    elif is_whole(b):
        b = b[b < below] if len(a) else b[:-1]
    return a, b


def resemblance(a: np.ndarray, b: np.ndarray, below: np.uint64 = threshold(1 / 8)) -> float:
    """Estimated share of all shingles that both have."""
    if not len(a) and not len(b):
        return 1.0
    a, b = comparable(a, b, below)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 0.0


def containment(a: np.ndarray, b: np.ndarray, below: np.uint64 = threshold(1 / 8)) -> float | None:
    """Estimated share of a's shingles that b has; None where no hash tells."""
    if not len(a):
        return 1.0
    a, b = comparable(a, b, below)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else None


def sketched(k: int = 5, fraction: float = 1 / 8):
    """For mapInArrow over (doc_id, text): adds the fingerprint."""
    below = threshold(fraction)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [encode(s) for s in sketches(part.column("text").to_pylist(), k, below)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])
    return run


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, fraction: float = 1 / 8) -> DataFrame:
    """One row per document: its id and fingerprint."""
    found = texts(docs, id_col, text_col).mapInArrow(sketched(k, fraction), "doc_id long, fingerprint string")
    return found.withColumnRenamed("doc_id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_holds double, next_holds double"
)


def compare_with_next(k: int, fraction: float):
    below = threshold(fraction)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """(doc_id, text, next text) in slices; the last row of each part only gives its text."""
        previous = None
        for batch in batches:
            for some in text_slices(batch, "text"):
                out = []
                for part, head, doc_id, text in zip(*(some.column(c).to_pylist() for c in ("part", "head", "doc_id", "text"))):
                    if previous is not None and previous[0] == part:
                        out.append((previous[1], previous[2], text))
                    previous = None if head else (part, doc_id, text)
                if out:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows(batches):
            ids, own, following = zip(*some)
            changed = [edited(t, n) for t, n in zip(own, following)]
            mine = sketches(own, k, below)
            # within a slice a row's next text is mostly the next row's own
            after = mine[1:] + sketches(following[-1:], k, below)
            for i in range(len(own) - 1):
                if following[i] is not own[i + 1] and following[i] != own[i + 1]:
                    after[i] = sketches([following[i]], k, below)[0]
            theirs = sketches(changed, k, below)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                    pa.array([encode(s) for s in mine]),
                    pa.array([encode(s) for s in theirs]),
                    pa.array([resemblance(a, b, below) for a, b in zip(mine, theirs)], pa.float64()),
                    pa.array([resemblance(a, b, below) for a, b in zip(mine, after)], pa.float64()),
                    pa.array([containment(a, b, below) for a, b in zip(mine, theirs)], pa.float64()),
                    pa.array([containment(a, b, below) for a, b in zip(mine, after)], pa.float64()),
                ],
                [f.split()[0] for f in EDIT_SCHEMA.split(", ")],
            )
    return run


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, fraction: float = 1 / 8,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and how alike they and its successor are.

    Documents are dealt to parts by ranges of ids, of about `rows_per_part`
    rows, or more where that would be over MOST_PARTS parts; a part is sorted
    and streamed, never held.  The first document of each part is also handed to
    the part before, where it only serves as the successor of the last; so one
    shuffle of the texts is enough.  Only the cuts between parts reach the driver.
    """
    docs = texts(docs, id_col, text_col).withColumn("at", F.coalesce("doc_id", F.lit(FIRST)))
    rows, distinct = docs.agg(F.count("*"), F.approx_count_distinct("at")).first()
    n_parts = max(1, min(rows // rows_per_part, distinct, MOST_PARTS))
    cuts = []
    if n_parts > 1:
        shares = [i / n_parts for i in range(1, n_parts)]
        found = docs.agg(F.percentile_approx("at", shares, 10 * n_parts)).first()[0]
        cuts = sorted({float(c) for c in found})
    part = F.lit(0).cast("long")
    if cuts:
        # doubles round large ids, but never change their order
        splits = [-math.inf, *cuts, math.inf]
        docs = Bucketizer(splits=splits, inputCol="as_double", outputCol="bucket").transform(
            docs.withColumn("as_double", F.col("at").cast("double"))
        ).drop("as_double")
        part = F.col("bucket").cast("long")
    docs = docs.withColumn("part", part)
    firsts = docs.groupBy("part").agg(F.min("at").alias("at"))
    before = sorted(r.part for r in firsts.select("part").collect())
    if not before:
        return docs.mapInArrow(compare_with_next(k, fraction), EDIT_SCHEMA).withColumnRenamed("doc_id", id_col)
    previous = docs.sparkSession.createDataFrame(
        list(zip(before, before[-1:] + before)), "part long, previous long"
    )
    # as many rows as there are parts, and the copies of their ids
    heads = (
        docs.join(F.broadcast(firsts), ["part", "at"], "left_semi")
        .groupBy("part").agg(F.min("text").alias("text"))
        .join(F.broadcast(previous), "part")
        .select(F.col("previous").alias("part"), F.lit(True).alias("head"),
                F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("doc_id"), "text")
    )
    both = docs.select("part", F.lit(False).alias("head"), "at", "doc_id", "text").union(heads)
    ordered = both.repartition("part").sortWithinPartitions("part", "head", "at", "text")
    return ordered.select("part", "head", "doc_id", "text").mapInArrow(
        compare_with_next(k, fraction), EDIT_SCHEMA
    ).withColumnRenamed("doc_id", id_col)
