"""Removal of lines that many documents share.

Lines are exploded with their place and normalised to a key: ASCII space off
both ends, A-Z lower-cased.  Keys are hashed to 128 bits; per hash the distinct
documents are counted.  A key of enough documents is dropped everywhere but in
the largest id that holds it, and the lines that stay are joined again by their
places.

Only hashes and places are shuffled to find what goes; the texts move once, to
meet the places of their own dropped lines.  A line that a third of all
documents hold is one row per task in the counts, and is joined by a broadcast
(see `skewed.meet`).

Defined cases: a null or empty text is one empty line.  A trailing line break
ends an empty line, which stays.  Keys shorter than `min_chars` code points
never go.  Rows that repeat an id are one document in the counts, and so are all
rows without an id, which come before any known id; each row is cut for itself.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import text_slices
from tablefit.llm.columns import kept, texts
from tablefit.llm.skewed import meet

MIN_CHARS = 20
MIN_DOCS = 3

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes that go on with a code point and do not begin one.
CONTINUED = bytes(range(0x80, 0xC0))


def keyed_lines(min_chars: int):
    """(doc_id, row1, row2, place, key1, key2) of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                of, places, digests = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    for place, line in enumerate(text.split(b"\n")):
                        key = line.strip(SPACE)
                        if len(key) >= min_chars and len(key.translate(None, CONTINUED)) >= min_chars:
                            of.append(row)
                            places.append(place)
                            digests.append(xxhash.xxh3_128_digest(key.translate(LOWER)))
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = {c: part.column(c).take(pa.array(of, "int64")) for c in ("doc_id", "row1", "row2")}
                columns["place"] = pa.array(places, "int32")
                columns |= {f"key{i + 1}": pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)}
                yield pa.RecordBatch.from_pydict(columns)
    return run


def _row_key() -> list[Column]:
    """128 bits of id and text, so that rows of one id are told apart; equal rows have equal lines anyway."""
    cells = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    return [F.xxhash64(F.lit(i), *cells).alias(f"row{i}") for i in (1, 2)]


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per document: its id, n_lines, n_dropped, and `kept`, the text of the lines that stay."""
    rows = texts(docs, id_col, text_col).select("doc_id", "text", *_row_key())
    lines = kept(
        rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(
            keyed_lines(min_chars), "doc_id long, row1 long, row2 long, place int, key1 long, key2 long"
        ),
        "line-keys",
    )
    per_document = lines.groupBy("key1", "key2", "doc_id").agg(F.count("*").alias("n"))
    common = kept(
        per_document.groupBy("key1", "key2").agg(
            F.count("*").alias("documents"), F.sum("n").alias("n"), F.max("doc_id").alias("holder")
        ).where(F.col("documents") >= min_docs).select("key1", "key2", "n", "holder"),
        "common-lines",
    )
    going = meet(lines, common, ["key1", "key2"], "n", lines.count()).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    # bounded by the lines of a document, copies of a row give one set
    dropped = going.groupBy("row1", "row2").agg(F.collect_set("place").alias("dropped"))
    split = rows.select("doc_id", "row1", "row2", F.split("text", "\n", -1).alias("lines"))
    met = split.join(dropped, ["row1", "row2"], "left")
    count = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), count - 1), "dropped")
    text = F.array_join(F.transform(stay, lambda place: F.col("lines")[place]), "\n")
    return met.select(
        F.col("doc_id").alias(id_col),
        count.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(text).alias("kept"),
    )
