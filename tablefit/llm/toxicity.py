"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers on hashed word presence (words and their leading
characters) are trained in numpy from confirmed toxic documents and unlabelled
ones; no document is ever taken as confirmed clean.  The loss is the
non-negative risk estimator: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
with the class prior from the labelled rows.  Where the second part falls below
zero the step goes against it, so the classifier does not fit the toxic rows
hidden in the unlabelled text.  Only features are used whose share of documents
differs between both sets by more than chance.  Several classifiers with their
own random order are averaged, and the bias is set so that the share of
unlabelled documents scored 0.5 or more is the class prior.

At most `max_positive` and `max_unlabelled` documents, chosen by a hash of the
id, are brought to the driver as feature numbers (not texts) to fit; prior and
label counts come from all rows, and every whole text is scored.

Defined cases: a null or empty text has no feature and is scored by the bias.
A label that is null, or of a null id, is no label; an id labelled toxic once
is toxic.  Without a toxic label every score is 0.  Rows that repeat an id are
scored each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import U64, Words, mix, text_slices
from tablefit.llm.columns import crc_mod, texts

BITS = 17
PREFIX = 4
FOLDS = 5


def features(documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, feature) numbers: trimmed words, and words' first characters."""
    words = Words([t.encode("utf-8", "surrogatepass") for t in documents])
    raw = np.frombuffer(words.joined, np.uint8)
    begin, end, of = words.begin, words.end, words.of
    # marks around a word do not count
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in ".,;:!?\"'()[]|*_-"]] = True
    for _ in range(2):
        begin = begin + (mark[raw[np.minimum(begin, len(raw) - 1)]] & (begin < end - 1))
        end = end - (mark[raw[end - 1]] & (begin < end - 1))
    sums, back = words.sums, words.back
    whole = mix((sums[end] - sums[begin]) * back[begin])
    stop = np.minimum(end, begin + PREFIX)
    start = mix((sums[stop] - sums[begin]) * back[begin] + U64(1))
    shift = U64(64 - BITS)
    found = np.concatenate((whole >> shift, start >> shift)).astype(np.int64)
    pairs = np.unique(np.concatenate((of, of)) << BITS | found)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            of, found = features(part.column("text").to_pylist())
            edges = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("any"), lists], ["toxic", "any", "features"])


@dataclass
class Model:
    """Weights per feature, averaged over the classifiers, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, of: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        margin = np.bincount(of, self.weights[found], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rows(edges: np.ndarray, found: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = edges[chosen + 1] - edges[chosen]
    of = np.repeat(np.arange(len(chosen)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(edges[chosen], sizes)
    return of, found[at]


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 42,
    epochs: int = 12, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, beta: float = 0.0, gamma: float = 1.0,
    least_steps: int = 400,
) -> Model:
    """One classifier by Adam on the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    n_p, n_u = len(positive), len(unlabelled)
    documents = [*positive, *unlabelled]
    edges = np.cumsum([0, *map(len, documents)])
    found = np.concatenate(documents).astype(np.int64) if documents else np.empty(0, np.int64)
    size = 1 << BITS
    w, bias = np.zeros(size), np.log(prior / (1 - prior))
    m, v, m_b, v_b, step = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    per_step = max(1, min(n_u, batch))
    steps = -(-n_u // per_step)
    for _ in range(max(epochs, -(-least_steps // steps))):
        order_u = rng.permutation(n_u) + n_p
        order_p = np.concatenate([rng.permutation(n_p) for _ in range(-(-steps * max(1, batch // 2) // n_p))])
        for i in range(steps):
            u = order_u[i * per_step:(i + 1) * per_step]
            p = order_p[i * max(1, batch // 2):(i + 1) * max(1, batch // 2)]
            of, own = _rows(edges, found, np.concatenate((p, u)))
            margin = np.bincount(of, w[own], len(p) + len(u)) + bias
            up = _sigmoid(margin)
            # logistic loss: l(+) = log(1 + e^-m), l(-) = log(1 + e^m)
            loss_minus = np.logaddexp(0, margin)
            rest = loss_minus[len(p):].mean() - prior * loss_minus[: len(p)].mean()
            g = np.empty(len(margin))
            if rest >= -beta:
                g[: len(p)] = prior * ((up[: len(p)] - 1) - up[: len(p)]) / len(p)
                g[len(p):] = up[len(p):] / len(u)
            else:
                g[: len(p)] = gamma * prior * up[: len(p)] / len(p)
                g[len(p):] = -gamma * up[len(p):] / len(u)
            grad = np.bincount(own, g[of], size) + decay * w
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            m_b += 0.1 * (g.sum() - m_b)
            v_b += 0.001 * (g.sum() ** 2 - v_b)
            fix_m, fix_v = 1 - 0.9**step, 1 - 0.999**step
            w -= rate * (m / fix_m) / (np.sqrt(v / fix_v) + 1e-6)
            bias -= rate * (m_b / fix_m) / (np.sqrt(v_b / fix_v) + 1e-6)
    return Model(w, float(bias))


def informative(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 5.0) -> np.ndarray:
    """Per feature whether its document shares differ by `least` standard errors."""
    size = 1 << BITS
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = (np.bincount(np.concatenate(rows).astype(np.int64), minlength=size) for rows in (positive, unlabelled))
    pooled = (in_p + in_u + 0.5) / (n_p + n_u + 1)
    gap = (in_p + 0.5) / (n_p + 1) - (in_u + 0.5) / (n_u + 1)
    return np.abs(gap) > least * np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, models: int) -> Model:
    """Classifiers on the informative features, averaged and set to the prior."""
    used = informative(positive, unlabelled)
    positive, unlabelled = ([x[used[x]] for x in rows] for rows in (positive, unlabelled))
    fitted = [fit(positive, unlabelled, prior, seed) for seed in range(models)]
    weights, bias = np.mean([f.weights for f in fitted], axis=0), float(np.mean([f.bias for f in fitted]))
    of = np.repeat(np.arange(len(unlabelled)), [len(x) for x in unlabelled])
    margin = np.bincount(of, weights[np.concatenate(unlabelled)], len(unlabelled)) + bias
    levels, counts = np.unique(margin, return_counts=True)
    # half way between two margins, so that equal documents fall on one side
    cuts = np.concatenate(([levels[0] - 1], (levels[1:] + levels[:-1]) / 2, [levels[-1] + 1]))
    above = len(margin) - np.concatenate(([0], np.cumsum(counts)))
    cut = cuts[np.argmin(np.abs(above / len(margin) - prior))]
    return Model(weights, float(bias - cut))


def train(
    docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 9000, models: int = 3
) -> Model | None:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic 0/1, one row per id); see the module.

    `docs` are those that may be learnt from.
    """
    total, toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return None
    prior = min(max(toxic / total, 1e-4), 0.5)
    n_docs = docs.count()
    pick = F.abs(F.xxhash64("doc_id", F.lit(5)) % (1 << 30))
    # `sure` is bounded by max_positive.  The unlabelled set is drawn from all text, confirmed or not, as the prior is.
    sure = labels.where("toxic = 1").where(pick < int((1 << 30) * min(1.0, max_positive / toxic))).select("doc_id", "toxic")
    any_text = F.abs(F.xxhash64("doc_id", F.lit(6)) % (1 << 30)) < int((1 << 30) * min(1.0, max_unlabelled / max(1, n_docs)))
    sample = docs.join(F.broadcast(sure), "doc_id", "left").withColumn("any", any_text).where("toxic = 1 or any")
    rows = sample.select("toxic", "any", "text").mapInArrow(
        feature_rows, "toxic int, any boolean, features array<int>"
    ).toArrow()
    toxic_rows, any_rows = (rows.column(c).to_pylist() for c in ("toxic", "any"))
    column = rows.column("features").combine_chunks()
    flat, edges = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    found = [flat[s:e] for s, e in zip(edges[:-1], edges[1:])]
    positive = [x for x, t in zip(found, toxic_rows) if t == 1]
    unlabelled = [x for x, t in zip(found, any_rows) if t]
    if not positive or not unlabelled:
        return None
    return learn(positive, unlabelled, prior, models)


def scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                if model is None:
                    score = np.zeros(part.num_rows)
                else:
                    score = model.score(*features(part.column("text").to_pylist()), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"]
                )
    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = 3000, max_unlabelled: int = 9000,
) -> Model | None:
    """The model learnt from all rows but those held out; None without a toxic label."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", FOLDS) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    learnt = texts(docs, id_col, text_col).where(crc_mod("doc_id", FOLDS) != 0)
    return train(learnt, known, max_positive, max_unlabelled)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = 3000, max_unlabelled: int = 9000,
) -> DataFrame:
    """One row per document: id, held_out, score and predicted.

    Held out are ids whose crc32 modulo 5 is 0; nothing is learnt from them.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, max_positive, max_unlabelled)
    own = texts(docs, id_col, text_col).withColumn("held_out", crc_mod("doc_id", FOLDS) == 0)
    return own.mapInArrow(scored(model), "doc_id long, held_out boolean, score double").select(
        F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """The documents, all their columns, that score below 0.5; where they are, without a shuffle."""
    model = fit_toxicity(docs, labels, id_col, text_col, label_col)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                found = features([t or "" for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array(model.score(*found, part.num_rows) < 0.5))

    return docs.mapInArrow(run, docs.schema)
