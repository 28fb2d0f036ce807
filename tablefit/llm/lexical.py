"""Ranked lexical search by a document FP-tree and branch and bound.

Documents keep only the terms of the query items.  Each task deals its documents
to trees: a document's restricted terms, most frequent of all documents first,
are a path, and documents share the path of their common first terms.  A node
knows for its subtree the largest tf of every term and the smallest m, so the
score that any document below it can have is bounded: a score rises with tf and
falls with m.  Per item the tree is searched depth first, best bound first, and
a subtree whose bound cannot enter the item's best is not entered.  The best of
all trees of a task are carried on, so later trees are cut off earlier.

No document is shuffled: tasks hand on at most `k` rows per item, which are
merged in two steps.  Items are a stated query set; blocks of about ITEM_BYTES of
their text are taken at a time, each against all documents, and only a block's
terms are on the driver and in the tasks.

Weights, lengths and scores are whole numbers (see `weight`, `document_m` and
`contribution`), so neither the trees nor the partitioning change a result.

Defined cases: a null or empty text has no term; it counts for nothing and is
never found.  Items without a known term find nothing.  Items of one id are one
item with the terms of all; an item without an id is one too.  Rows that repeat
an id are documents of their own; those without one come after known ids where
scores are equal.  Empty tables give an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablefit.llm.columns import kept

BEST = 50
#: Bytes of item text in one block of items.
ITEM_BYTES = 1 << 24
#: Documents and postings of one tree.
TREE_DOCS, TREE_POSTINGS = 8192, 1 << 21
#: Ranges of so many documents are not divided further.
LEAF = 32
#: Parts that an item's finds are merged in first.
SLICES = 64

_TERM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: Bytes of terms stay, A-Z lower-cased; all others separate.
TABLE = bytes(b if b in _TERM else 0x20 for b in range(256)).lower()[:128] + bytes(range(0x80, 0x100))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII digits and letters and of all that is beyond ASCII; A-Z lower-cased."""
    return (text or b"").translate(TABLE).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def document_m(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    return 50 + (50 * n * documents) // words


def contribution(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def restricted(vocabulary: dict[bytes, int]):
    """(doc_id, n, terms, tfs) of every document with a term: the vocabulary's terms in it and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            lengths, found, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = terms(text.as_py())
                lengths.append(len(words))
                known, n = np.unique(np.array([t for t in map(get, words) if t is not None], np.int32), return_counts=True)
                found.append(known)
                counts.append(n.astype(np.int32))
                ends.append(ends[-1] + len(known))
            offsets = pa.array(ends, "int32")
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *part]), "int32"))
                for part in (found, counts)
            ]
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, "int64"), *lists], ["doc_id", "n", "terms", "tfs"]
            )
            yield out.filter(pa.array(np.array(lengths, np.int64) > 0))
    return run


@dataclass
class Postings:
    """Documents of one tree: a row each of `ids`, `known` (whether it has one) and `m`; document d has the
    ranks[ends[d]:ends[d + 1]], rising, and their tfs."""

    ids: np.ndarray
    known: np.ndarray
    m: np.ndarray
    ends: np.ndarray
    ranks: np.ndarray
    tfs: np.ndarray

    def ordered(self) -> Postings:
        """The same documents in the lexicographic order of their ranks."""
        raw = self.ranks.astype(">u4").tobytes()
        keys = [raw[4 * s:4 * e] for s, e in zip(self.ends[:-1].tolist(), self.ends[1:].tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        sizes = np.diff(self.ends)[order]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.ends[:-1][order] - ends[:-1], sizes) + np.arange(ends[-1])
        return Postings(self.ids[order], self.known[order], self.m[order], ends, self.ranks[at], self.tfs[at])


class Tree:
    """The FP-tree of some documents: a node is a range of them in the order of their paths."""

    def __init__(self, documents: Postings, weights: np.ndarray):
        self.docs = docs = documents.ordered()
        sizes = np.diff(docs.ends)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.scores = contribution(weights[docs.ranks], docs.tfs, docs.m[self.of])
        self.low, self.high, self.children = [0], [len(sizes)], []
        for node, (low, high) in enumerate(zip(self.low, self.high)):  # both grow on the way
            parts = self._divided(low, high, sizes)
            self.children.append(list(range(len(self.low), len(self.low) + len(parts))))
            self.low += [s for s, _ in parts]
            self.high += [e for _, e in parts]
        self.least_id = [int(docs.ids[s:e].min()) for s, e in zip(self.low, self.high)]
        self._bound(weights)

    def _divided(self, low: int, high: int, sizes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of the node's children: documents that end here, then one range per next term."""
        if high - low <= LEAF:
            return []
        ends, ranks = self.docs.ends, self.docs.ranks
        first, last = ranks[ends[low]:ends[low + 1]], ranks[ends[high - 1]:ends[high]]
        least = min(len(first), len(last))
        apart = np.flatnonzero(first[:least] != last[:least])
        depth = int(apart[0]) if len(apart) else least
        if depth == len(last):
            return []  # one path for all
        begin = low + int(np.count_nonzero(sizes[low:high] == depth))
        following = ranks[ends[begin:high] + depth]
        edges = [begin, *(np.flatnonzero(np.diff(following)) + begin + 1).tolist(), high]
        return [(low, begin)] * (begin > low) + list(zip(edges[:-1], edges[1:]))

    def _bound(self, weights: np.ndarray) -> None:
        """Per term of a node's subtree the most that it can add to a score there, sorted by term."""
        docs, n = self.docs, len(self.low)
        found: list[tuple[np.ndarray, np.ndarray]] = [None] * n
        for node in range(n - 1, -1, -1):  # children come after their parent
            if self.children[node]:
                ranks, tfs = (np.concatenate([found[c][i] for c in self.children[node]]) for i in (0, 1))
            else:
                here = slice(docs.ends[self.low[node]], docs.ends[self.high[node]])
                ranks, tfs = docs.ranks[here], docs.tfs[here]
            order = np.argsort(ranks, kind="stable")
            ranks = ranks[order]
            starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else np.empty(0, np.int64)
            found[node] = ranks[starts], np.maximum.reduceat(tfs[order], starts) if len(starts) else tfs
        sizes = [len(f[0]) for f in found]
        ranks, tfs = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        node = np.repeat(np.arange(n), sizes)
        least_m = np.array([docs.m[s:e].min() for s, e in zip(self.low, self.high)], np.int64)
        order = np.argsort(ranks, kind="stable")
        self.node, most = node[order], contribution(weights[ranks], tfs, least_m[node])
        self.most = most[order].astype(np.float64)  # whole numbers below 2**53
        self.starts = np.searchsorted(ranks[order], np.arange(len(weights) + 1))

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """Per node the most that a document below it can score."""
        starts, sizes = self.starts[wanted], self.starts[wanted + 1] - self.starts[wanted]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(self.node[at], weights=self.most[at], minlength=len(self.low))

    def search(self, wanted: np.ndarray, mask: np.ndarray, best: Best) -> int:
        """Enter what can still be among the best; returns how many documents were scored."""
        if not len(self.of):
            return 0
        bounds, scored, stack = self.bounds(wanted), 0, [0]
        while stack:
            node = stack.pop()
            if not best.open_to(bounds[node], self.least_id[node]):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bounds.__getitem__)
                continue
            low, high = self.low[node], self.high[node]
            here = slice(self.docs.ends[low], self.docs.ends[high])
            hit = np.flatnonzero(mask[self.docs.ranks[here]]) + here.start
            scores = np.bincount(self.of[hit] - low, weights=self.scores[hit], minlength=high - low).astype(np.int64)
            best.add(scores, self.docs.ids[low:high], self.docs.known[low:high])
            scored += high - low
        return scored


class Best:
    """The k best documents so far: highest score first, equal ones by id, those without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def open_to(self, bound: float, least_id: int) -> bool:
        if bound <= 0 or len(self.scores) < self.k:
            return bound > 0
        return bound > self.scores[-1] or (bound == self.scores[-1] and least_id <= self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        least = self.scores[-1] if len(self.scores) == self.k else 1
        near = np.flatnonzero(scores >= least)
        if len(near):
            scores, ids, known = (
                np.concatenate(p) for p in ((self.scores, scores[near]), (self.ids, ids[near]), (self.known, known[near]))
            )
            order = np.lexsort((ids, ~known, -scores))[:self.k]
            self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def _trees(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, documents: int, words: int) -> Iterator[Postings]:
    """The task's documents in portions that one tree holds."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        start = 0
        while start < batch.num_rows:
            upto = np.searchsorted(np.cumsum(sizes[start:]), TREE_POSTINGS - postings, side="right")
            take = min(batch.num_rows - start, TREE_DOCS - rows, int(upto))
            if take > 0 or not rows:
                take = max(take, 1)
                held.append(batch.slice(start, take))
                rows, postings, start = rows + take, postings + int(sizes[start:start + take].sum()), start + take
                if start == batch.num_rows:
                    break
            yield _postings(held, rank_of, documents, words)
            held, rows, postings = [], 0, 0
    if held:
        yield _postings(held, rank_of, documents, words)


def _postings(held: list[pa.RecordBatch], rank_of: np.ndarray, documents: int, words: int) -> Postings:
    table = pa.Table.from_batches(held).combine_chunks()
    known = table.column("doc_id").is_valid().to_numpy()
    ids = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
    sizes = np.array([0, *lists[0].value_lengths().to_numpy()], np.int64)
    ranks, tfs = rank_of[lists[0].flatten().to_numpy()], lists[1].flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    order = np.lexsort((ranks, np.repeat(np.arange(len(ids)), sizes[1:])))
    m = document_m(table.column("n").to_numpy(), documents, words)
    return Postings(ids, known, m, ends, ranks[order], tfs[order])


def searched(items: list[np.ndarray], rank_of: np.ndarray, weights: np.ndarray, documents: int, words: int, k: int):
    """(item, doc_id, score): the best of the task's documents for each item (its ranks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        mask = np.zeros(len(weights), bool)
        for part in _trees(batches, rank_of, documents, words):
            tree = Tree(part, weights)
            for wanted, b in zip(items, best):
                mask[wanted] = True
                tree.search(wanted, mask, b)
                mask[wanted] = False
        for item, b in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b.ids), item, np.int32)), pa.array(b.ids, mask=~b.known), pa.array(b.scores)],
                ["item", "doc_id", "score"],
            )
    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, doc, score): each item's k documents of the highest scores above 0."""
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    found = None
    for block in range(blocks):
        one = _block(docs, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block), k, id_col, text_col)
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def _block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    wanted: dict[object, set[bytes]] = {}
    for row in asked.collect():  # ITEM_BYTES of text, or one longer item
        wanted.setdefault(row.id, set()).update(terms(row.text))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    vectors = kept(
        rows.mapInArrow(restricted(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), "lexical-vectors"
    )
    total = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[row.term] = row.df
    # rank 0 is the term of the most documents
    order = np.argsort(-df, kind="stable")
    rank_of = np.empty(len(order), np.int32)
    rank_of[order] = np.arange(len(order), dtype=np.int32)
    weights = np.array([weight(total.documents, int(n)) for n in df[order]], np.int64)
    ranks = [np.sort(rank_of[[vocabulary[t] for t in ts]]).astype(np.int64) if ts else np.empty(0, np.int64) for ts in wanted.values()]
    best = vectors.mapInArrow(
        searched(ranks, rank_of, weights, total.documents, total.words or 1, k), "item int, doc_id long, score long"
    )
    order_by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = Window.partitionBy("item", "slice").orderBy(*order_by)
    merged = best.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))).withColumn(
        "place", F.row_number().over(within)
    ).where(F.col("place") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order_by))).where(F.col("rank") <= k)
    names = asked.sparkSession.createDataFrame(list(enumerate(wanted)), f"item int, id {asked.schema['id'].dataType.simpleString()}")
    # a row per item of the block
    return ranked.join(F.broadcast(names), "item").select("id", "rank", "doc_id", "score")
