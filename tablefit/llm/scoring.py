"""Language-model scores by subword lattices.

The probability of a word sums over all its segmentations into pieces of an
existing unigram vocabulary, by a forward recursion in log space.  The
vocabulary's own scores are where expectation maximisation over the distinct
training words starts from.  Besides the pieces, each training word is an arc
of its own, of weight `share` times its count; `share` is what Good and Turing
leave to seen words.  With L the lattice of pieces, C training words and e the
chance of an end, P(word) = (1 - e) * (share * c / C + (1 - share) * L(word)),
which sums to 1 - e over all words.  A text is its words and one end.

Two more scores are by segmentations alone, without arcs of words:
`lattice_score` with L, and `vocabulary_score` with the vocabulary's own
scores, of which nothing but e is learnt.

Every distinct training word is counted.  The most frequent ones, at most
HEAD, go to all tasks; the counts of all others are joined to the documents
that hold them, so nothing that grows with the corpus is broadcast.

Defined cases: a null or empty text is the end alone.  Text of any length is
read whole.  Rows that repeat an id are scored each, and are all learnt from or
all not.  A null id counts as the empty text in the choice of training rows.
Without training rows counts are 0 and the vocabulary's scores alone decide.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import Words, text_slices
from tablefit.llm.columns import crc_mod, kept, texts
from tablefit.llm.lattice import START, Pieces, existing_logp, piece_bytes

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 20
FLUSH = 400_000
ROUNDS = 2
PRIOR_WEIGHT = 1000.0


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model that can stand in a word, with their own scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    own = [
        i for i in range(model.get_piece_size())
        if not model.is_control(i) and not model.is_unknown(i) and START not in model.id_to_piece(i)[1:]
    ]
    spelled = [piece_bytes(model.id_to_piece(i)) for i in own]
    return Pieces(spelled, existing_logp(np.array([model.get_score(i) for i in own]), spelled))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts with how often they are in this task; bounded by flushing."""

    def flushed(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 50_000):
            some = words[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), pa.array([counts[w] for w in some], pa.int64())], ["word", "n"]
            )

    counts: Counter = Counter()
    for batch in batches:
        for part in text_slices(batch, "text"):
            for text in part.column("text").to_pylist():
                counts.update(text.encode("utf-8", "surrogatepass").lower().split())
                if len(counts) > FLUSH:
                    yield from flushed(counts)
                    counts = Counter()
    yield from flushed(counts)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.Table]:
    """Batches put together to about `most` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = Words(batch.column("word").to_pylist(), lower=False).hashes
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view("i8")), batch.column("n")], ["hash", "n"])


def weigh_words(pieces: Pieces, own: Pieces):
    """(hash, n, lattice, vocabulary) of words, whose lattices are weighed in both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            words = table.column("word").to_pylist()
            if words:
                lattice, vocabulary = pieces.marginals(words, own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(Words(words, lower=False).hashes.view("i8")), table.column("n").combine_chunks(),
                    pa.array(lattice), pa.array(vocabulary),
                ], ["hash", "n", "lattice", "vocabulary"])
    return run


def piece_use(pieces: Pieces):
    """Expected use of each piece over the words of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces.spelled))
        for table in gathered(batches):
            words = table.column("word").to_pylist()
            if words:
                total += pieces.expected(words, np.ones(len(words)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[used])], ["piece", "used"])
    return run


def refit(pieces: Pieces, words: DataFrame, rounds: int) -> Pieces:
    """Expectation maximisation over distinct words; the vocabulary's own scores weigh as a prior.

    The driver gets one number per piece.
    """
    prior = PRIOR_WEIGHT * np.exp(pieces.logp)
    for _ in range(rounds):
        rows = words.select("word").mapInArrow(piece_use(pieces), "piece int, used double")
        rows = rows.groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
        use = prior.copy()
        use[rows.column("piece").to_numpy()] += rows.column("used").to_numpy()
        pieces = pieces.weighted(np.log(use / use.sum()))
    return pieces


class Model:
    """What a task needs to score: pieces, shares, and the counts of the most frequent words."""

    def __init__(
        self, pieces: Pieces, own: Pieces, n_words: int, n_ends: int, distinct: int, once: int,
        head: np.ndarray, counts: np.ndarray, lattice: np.ndarray, vocabulary: np.ndarray,
    ):
        order = np.argsort(head)
        self.pieces, self.own, self.head, self.counts = pieces, own, head[order], counts[order]
        self.lattice, self.vocabulary = lattice[order], vocabulary[order]
        self.n_words, self.n_ends = n_words, n_ends
        self.tokens, self.distinct = n_words + n_ends, distinct + (n_ends > 0)
        self.share = min(0.999, max(0.0, 1 - once / n_words)) if n_words else 0.0
        self.end = (n_ends + 1) / (self.tokens + 2)
        # of the base model: tokens and distinct tokens of the training rows, ends included
        self.base_unit = -math.log10(self.tokens + self.distinct + 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts (-1: not there) and lattices, weighed in both ways, of words in the head."""
        if not len(self.head):
            return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes)), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        own = self.head[at] == hashes
        return np.where(own, self.counts[at], -1), *(np.where(own, x[at], 0.0) for x in (self.lattice, self.vocabulary))

    def log10(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of each word's probability from its count and the natural log of its lattice."""
        with np.errstate(divide="ignore"):
            seen = np.log(self.share * counts / max(1, self.n_words))
        piece = math.log1p(-self.share) + lattice
        return (math.log1p(-self.end) + np.logaddexp(seen, piece)) / math.log(10)


ROW_SCHEMA = (
    "row long, hash long, times long, lattice double, vocabulary double, doc_id long, held_out boolean, n_tokens long, "
    "n_known long, base double, score double"
)


def score_rows(model: Model):
    """Per document a row with the sums over words in the head, and a row for each other word of it.

    The lattices of a document's own row are sums; those of the other rows are to be taken `times`.
    """
    names = [f.split()[0] for f in ROW_SCHEMA.split(", ")]

    def others(held: list[tuple], spelled: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Rows of the words that were put off, whose lattices are done together."""
        (lattice, vocabulary), at = model.pieces.marginals(spelled, model.own), 0
        for rows, kinds, of, kind, times in held:
            m = len(of)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[of]), pa.array(kinds[kind].view("i8")), pa.array(times.astype("i8")),
                pa.array(lattice[at + kind]), pa.array(vocabulary[at + kind]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()),
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
            ], names)
            at += len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held, spelled = [], []
        for batch in batches:
            for part in text_slices(batch, "text"):
                n = part.num_rows
                words = Words([t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])
                kinds, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                counts, lattice, vocabulary = model.find(kinds)
                in_head = counts >= 0
                base = np.where(in_head, np.log10(np.maximum(counts, 0) + 1), 0.0)
                score = np.where(in_head, model.log10(np.maximum(counts, 0), lattice), 0.0)
                sums = [np.bincount(words.of, x[back], n) for x in (in_head, base, score, lattice, vocabulary)]
                n_words = np.bincount(words.of, minlength=n)
                known_end = model.n_ends > 0
                rows = number + np.arange(n)
                number += n
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), pa.array(rows), pa.nulls(n, pa.int64()), *(pa.array(x.astype(float)) for x in sums[3:]),
                    part.column("doc_id"), part.column("held_out"),
                    pa.array(n_words + 1), pa.array(sums[0].astype("i8") + known_end),
                    pa.array(sums[1] + math.log10(model.n_ends + 1) + (n_words + 1) * model.base_unit),
                    pa.array(sums[2] + math.log10(model.end)),
                ], names)
                rest = np.flatnonzero(~in_head[back])
                if len(rest):
                    # once for each document and word
                    other = np.flatnonzero(~in_head)
                    place = np.cumsum(~in_head) - 1
                    pairs, times = np.unique(words.of[rest].astype("i8") * len(other) + place[back[rest]], return_counts=True)
                    held.append((rows, kinds[other], *np.divmod(pairs, len(other)), times))
                    spelled += [words.joined[words.begin[i]:words.end[i]] for i in first[other]]
                    if len(spelled) > 50_000:
                        yield from others(held, spelled)
                        held, spelled = [], []
        if held:
            yield from others(held, spelled)
    return run


def learn(own: DataFrame, vocabulary: str, rounds: int = ROUNDS, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of the training rows of (text, held_out), and the table (hash, n) of all their words."""
    train = own.where("not held_out")
    counted = kept(
        train.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "words",
    )
    n_ends = train.count()
    level = F.floor(F.log2("n") * 8).cast("int")
    total, distinct, once = counted.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("int"))).first()
    levels = sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, words = None, 0
    for row in levels:
        words += row.words
        if words > head:
            break
        least = row.level
    often = level >= least if least is not None else F.lit(False)
    existing = load_pieces(vocabulary)
    pieces = refit(existing, counted, rounds if total else 0)
    # at most `head` words
    frequent = counted.where(often).mapInArrow(
        weigh_words(pieces, existing), "hash long, n long, lattice double, vocabulary double"
    ).toArrow()
    model = Model(
        pieces, existing, total or 0, n_ends, distinct, once or 0, frequent.column("hash").to_numpy().view("u8"),
        *(frequent.column(name).to_numpy() for name in ("n", "lattice", "vocabulary")),
    )
    return model, kept(counted.where(~often).mapInArrow(hash_words, "hash long, n long"), "word-hashes")


def score_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    and the scores by segmentations alone, lattice_score and vocabulary_score.

    `vocabulary` is the path of a sentencepiece model that the driver has.
    Learnt from are ids whose crc32 modulo 7 is not 2.
    """
    own = texts(docs, id_col, text_col).withColumn("held_out", crc_mod("doc_id", FOLDS) == HELD_OUT)
    model, rare = learn(own, vocabulary, rounds, head)
    rows = own.mapInArrow(score_rows(model), ROW_SCHEMA)
    # a document's own row carries its number as hash, and no times: whatever it meets adds nothing
    joined = rows.join(rare, "hash", "left")
    n = F.coalesce("n", F.lit(0))
    seen = F.lit(model.share) * n / max(1, model.n_words)
    piece = F.lit(1 - model.share) * F.exp("lattice")
    # the exponent of a long word's lattice vanishes where its log does not
    log_p = F.when(n > 0, F.log(seen + piece)).otherwise(math.log1p(-model.share) + F.col("lattice")) + math.log1p(-model.end)

    def alone(lattice: str):
        """log10 probability by segmentations alone."""
        words = F.sum(F.coalesce("times", F.lit(1)) * F.col(lattice))
        return (words + (F.max("n_tokens") - 1) * math.log1p(-model.end) + math.log(model.end)) / math.log(10)

    return joined.groupBy("row").agg(
        F.max("doc_id").alias(id_col),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(n > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.max("base") + F.coalesce(F.sum(F.col("times") * F.log10(n + 1)), F.lit(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.col("times") * log_p / math.log(10)), F.lit(0.0))).alias("score"),
        alone("lattice").alias("lattice_score"),
        alone("vocabulary").alias("vocabulary_score"),
    ).drop("row")
