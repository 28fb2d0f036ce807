import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefit.llm import toxicity
from tablefit.llm.toxicity import features, fit, fit_toxicity, score_toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(400)]
    bad = ["vilefoo", "vilebar", "hatebaz", "hatequx"]
    docs, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.2
        words = rng.choices(plain, k=rng.randrange(5, 120)) + (rng.choices(bad, k=4) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy(spark, make_docs, corpus):
    docs, labels = corpus
    # a third of the toxic rows is confirmed, all others are unlabelled or wrongly taken for clean
    known = [(i, t) for i, t in labels if i % 3 == 0]
    rows = score_toxicity(make_docs(docs), label_table(spark, known)).collect()
    truth = dict(labels)
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(docs)
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    # what held-out labels say changes nothing
    other = [(i, 1 - t if held_out(i) else t) for i, t in known]
    again = score_toxicity(make_docs(docs), label_table(spark, other)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in rows}


def test_edge_cases(spark, make_docs, corpus):
    docs, labels = corpus
    odd = [(None, "vilefoo vilebar"), (5000, None), (5001, ""), (5002, "vilefoo, (vilebar) HATEBAZ! hatequx. " * 4000),
           (0, docs[0][1]), (5003, "word1 word2 word3")]
    known = [*labels, (None, 1), (3, None), (1, labels[1][1])]
    rows = score_toxicity(make_docs([*docs, *odd]), label_table(spark, known)).collect()
    assert len(rows) == len(docs) + len(odd)
    found = {r.doc_id: r for r in rows}
    assert found[5002].predicted == 1 and found[5000].predicted == 0 and found[5003].predicted == 0
    assert found[5000].score == found[5001].score
    none = score_toxicity(make_docs(docs[:50]), label_table(spark, [(1, 0)])).collect()
    assert {r.score for r in none} == {0.0}
    assert score_toxicity(make_docs([]), label_table(spark, known)).count() == 0
    assert score_toxicity(make_docs(docs[:9]), label_table(spark, [])).count() == 9


def test_hidden_positives_are_not_learnt_as_clean():
    """With few confirmed rows the estimator still finds the toxic rows among the unlabelled."""
    rng = np.random.default_rng(0)
    def rows(n, toxic):
        return [np.unique(np.concatenate((rng.integers(100, 200, 10), [7] if toxic else []))).astype(int) for _ in range(n)]
    positive, hidden, clean = rows(150, True), rows(300, True), rows(700, False)
    model = fit(positive, hidden + clean, 0.3)
    assert model.weights[7] > 0.5
    of, found = features(["A, b b"])
    assert of.tolist() == [0] * len(found) and len(set(found.tolist())) == len(found)


def plain_fit(positive, unlabelled, prior, seed, epochs=12, rate=0.01, decay=1e-4, batch=256):
    """Adam on the non-negative risk, in dense matrices and with numeric derivatives of the stated loss."""
    used = sorted({f for row in positive + unlabelled for f in row.tolist()})
    place = {f: i for i, f in enumerate(used)}
    dense = np.zeros((len(positive) + len(unlabelled), len(used) + 1))
    for i, row in enumerate(positive + unlabelled):
        dense[i, [place[f] for f in row.tolist()]] = 1
    dense[:, -1] = 1
    n_p, n_u = len(positive), len(unlabelled)
    rng = np.random.default_rng(seed)
    w = np.zeros(len(used) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    step, each = 0, min(n_u, batch)
    steps = -(-n_u // each)
    for _ in range(max(epochs, -(-400 // steps))):
        order_u = rng.permutation(n_u) + n_p
        order_p = np.concatenate([rng.permutation(n_p) for _ in range(-(-steps * (batch // 2) // n_p))])
        for i in range(steps):
            u, p = dense[order_u[i * each:(i + 1) * each]], dense[order_p[i * (batch // 2):(i + 1) * (batch // 2)]]

            def parts(w):
                plus = prior * np.log1p(np.exp(-(p @ w))).mean()
                return plus, np.log1p(np.exp(u @ w)).mean() - prior * np.log1p(np.exp(p @ w)).mean()

            rest = parts(w)[1]
            # below zero the step goes against the second part alone
            risk = (lambda w: sum(parts(w))) if rest >= 0 else (lambda w: -parts(w)[1])
            slope = np.array([(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5])
            slope[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return dict(zip(used, w)), w[-1]


def test_fit_against_the_stated_risk():
    """Weights are those of steps along numeric derivatives of the risk, on both of its sides."""
    rng = np.random.default_rng(2)
    def rows(n, toxic):
        return [np.unique(np.concatenate((rng.integers(20, 26, 3), rng.integers(10, 13, 2) if toxic else [])).astype(int)) for _ in range(n)]
    positive, unlabelled = rows(30, True), rows(20, True) + rows(60, False)
    for prior in (0.25, 0.5):
        model = fit(positive, unlabelled, prior, seed=3)
        weights, bias = plain_fit(positive, unlabelled, prior, 3)
        found = {f: model.weights[f] for f in weights}
        assert np.allclose([found[f] for f in weights], list(weights.values()), atol=2e-2)
        assert np.isclose(model.bias, bias, atol=2e-2) and np.count_nonzero(model.weights) <= len(weights)


def test_scores_against_plain_sums(spark, make_docs, corpus):
    """Every score is the logistic of the bias and the weights of the text's own distinct features."""
    docs, labels = corpus
    known = label_table(spark, labels)
    model = fit_toxicity(make_docs(docs), known)
    rows = score_toxicity(make_docs(docs[:300]), known)
    # the same model: fitted on all, applied to some
    found = {r.doc_id: r.score for r in make_docs(docs[:300]).select("doc_id", "text").withColumn(
        "held_out", F.lit(False)
    ).mapInArrow(toxicity.scored(model), "doc_id long, held_out boolean, score double").collect()}
    assert rows.count() == len(found) == 300
    for doc_id, text in docs[:300]:
        words = {w for w in text.lower().split()}
        own = set()
        for word in words:
            own |= set(features([word])[1].tolist())
        margin = model.bias + sum(model.weights[f] for f in own)
        assert np.isclose(found[doc_id], 1 / (1 + np.exp(-margin)), rtol=1e-9)
