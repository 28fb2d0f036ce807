"""Best-fit packing of documents into sequences by minimum bin slack.

Tasks tokenize and count pieces per length.  The count per length, at most
`capacity` numbers at any size of the corpus, is all that the planner on the
driver sees.  It opens each bin with the longest piece left, finds by a bitset
subset-sum over the lengths left the combination that fills the bin most, and
removes it as often as the counts allow; each step uses up a length, so there
are no more patterns than about twice the lengths.  Pieces are then numbered
within their length (a running count per input part, so a length that a third
of all pieces has is numbered in parallel) and look their place up in the plan.

Defined cases: a null or empty text is one piece, the end id alone.  A text of
any length is cut into full pieces and a rest; only such texts are cut.  Rows
that repeat an id are packed each; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.llm.batches import text_slices
from tablefit.llm.columns import kept, texts

END_ID = 1
CACHED_WORDS = 300_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


#: Words of these characters alone are NFC already and have one lower-case form.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
#: Where the vocabulary cuts a lower-case word of simple characters.
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a lower-casing word BPE tokenizer, remembered by word and by part of a word.

    The vocabulary splits at white space before it merges, so a text's ids are
    those of its words in turn.  Only ASCII white space is cut here.  A word of
    simple characters is cut into letters, digits and signs, whose merges alone
    are asked for; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.characters = self.tokenizer.model.tokenize, _byte_characters()
        self.cached, self.words, self.parts = cached, {}, {}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.characters)
        ids = array("I", [t.id for t in self.merges(shown)]).tobytes()
        if len(self.parts) >= self.cached:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if SIMPLE(text) and "<|" not in text:
            known = self.parts.get
            return b"".join([known(part) or self._part(part) for part in CUT(text.lower())])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        for text in texts:
            split = text.encode("utf-8", "surrogatepass").split()
            if len(self.words) > self.cached:
                self.words.clear()
            known = self.words
            for word in set(split).difference(known):
                known[word] = self._word(word)
            yield b"".join(map(known.__getitem__, split))


def pieces(path: str, capacity: int):
    """Per piece its place in the document, its checksum, and its number within the length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for some in text_slices(batch, "text"):
                rows = []
                docs = some.column("doc_id").to_pylist()
                for doc_id, ids in zip(docs, tokenizer.encode(some.column("text").to_pylist())):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + capacity)]
                        n = len(own) // 4
                        rows.append((doc_id, piece, start, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )
    return run


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum comes nearest to `room` without passing it.

    Subset sums as bits of one integer, lengths longest first and each doubled
    up to its count; stops as soon as `room` itself is reached.
    """
    reached, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reached >> room & 1:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & limit
            left -= take
            take *= 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, pattern) so that the patterns use up all counts; a pattern says how often it has a length."""
    left = {n: c for n, c in counts.items() if c}
    patterns = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[n] // m for n, m in pattern.items())
        for n, m in pattern.items():
            left[n] -= m * repeats
            if not left[n]:
                del left[n]
        patterns.append((repeats, pattern))
    return patterns


class Places:
    """Sequence and offset by length and number within the length."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]], capacity: int):
        used, rows, sequence = {}, [], 0
        for repeats, pattern in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.append((length, used.get(length, 0), pattern[length], sequence, offset))
                used[length] = used.get(length, 0) + pattern[length] * repeats
                offset += length * pattern[length]
            sequence += repeats
        rows.sort()
        self.length, self.first, self.each, self.sequence, self.offset = (
            np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5)
        )
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            low, high = self.begin[n], self.begin[n + 1]
            at[own] = low + np.searchsorted(self.first[low:high], number[own], side="right") - 1
        since = number - self.first[at]
        copy, slot = np.divmod(since, self.each[at])
        return self.sequence[at] + copy, self.offset[at] + slot * length


def placed(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = pc.add(batch.column("rank"), batch.column("before")).to_numpy()
            sequence, offset = places.find(length, number)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )
    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    `tokenizer` is the path of a vocabulary file that every executor has.
    """
    cut = kept(texts(docs, id_col, text_col).mapInArrow(pieces(tokenizer, capacity), PIECE_SCHEMA), "pieces")
    by_part = kept(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = by_part.select(
        "length", "part",
        F.coalesce(F.sum("n").over(
            W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        ), F.lit(0)).alias("before"),
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    found = cut.join(before, ["length", "part"]).mapInArrow(placed(Places(plan(counts, capacity), capacity)), schema)
    return found.withColumnRenamed("doc_id", id_col)
