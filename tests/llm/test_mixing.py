import random

import numpy as np
import pytest

from tablefit.llm import mixing
from tablefit.llm.mixing import fit_rates, mix

WEIGHTS = {"en": 0.4, "fr": 0.25, "de": 0.2, "es": 0.15}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = {d: [f"{d}{i}" for i in range(50)] for d in WEIGHTS}
    docs, domains = [], {}
    for i in range(900):
        d = rng.choices(list(WEIGHTS), [6, 2, 1, 1])[0]
        other = rng.choice(list(WEIGHTS))
        n = rng.randrange(3, 200)
        docs.append((i, " ".join(rng.choices(vocabulary[d], k=n) + rng.choices(vocabulary[other], k=n // 4))))
        domains[i] = d
    return docs, domains


def labelled(spark, domains, every=3):
    return spark.createDataFrame([(i, d) for i, d in domains.items() if i % every == 0], "doc_id long, domain string")


def totals(rows):
    return np.array([sum(r.rate * r.tokens * r.posterior[i] for r in rows) for i in range(len(WEIGHTS))])


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_totals_match_targets(spark, make_docs, corpus, floor):
    docs, domains = corpus
    rows = mix(make_docs(docs), labelled(spark, domains), WEIGHTS, floor=floor).collect()
    assert sorted(r.doc_id for r in rows) == sorted(domains)
    share = np.array([WEIGHTS[d] for d in sorted(WEIGHTS)])
    found = totals(rows)
    # a floor keeps overfull mixed documents from falling further
    assert np.abs(found / found.sum() - share).max() < (0.03 if floor else 0.001)
    assert all(r.rate >= floor and abs(r.copies - r.rate) < 1 for r in rows)
    assert abs(sum(r.copies for r in rows) / sum(r.rate for r in rows) - 1) < 0.1
    unseen = [r for r in rows if r.doc_id % 3]
    assert np.mean([r.domain == domains[r.doc_id] for r in unseen]) > 0.95
    assert all(r.tokens == len(dict(docs)[r.doc_id].split()) for r in rows)


def projected_gradient(p, t, target, floor, steps=20_000):
    """Least squares on all rates at once by plain steps, in the metric of fit_rates; the totals where they end."""
    share, a = target / target.sum(), (p * t[:, None]).T / target.sum()
    rate = np.full(len(t), max(1.0, floor))
    metric = np.linalg.inv(a @ p + 1e-9 * np.eye(len(share)))
    for _ in range(steps):
        rate = np.maximum(floor, rate - p @ (metric @ (a @ rate - share)))
    return a @ rate * target.sum()


@pytest.mark.parametrize("floor, aim", [(0.0, (0.1, 0.2, 0.7)), (0.5, (0.3, 0.2, 0.5))])
def test_least_squares_against_brute_force(spark, monkeypatch, floor, aim):
    """The totals where plain projected gradient on all rates ends, met or not."""
    monkeypatch.setattr(mixing, "REPLAYED", 3)
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5] * 3, 60)
    t = rng.integers(1, 100, 60)
    rows = [(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p))]
    table = spark.createDataFrame(rows, "i int, tokens long, posterior array<double>").coalesce(2)
    target = np.array(aim) * t.sum()
    fit = fit_rates(table, target.tolist(), floor)
    rate = np.array([r.rate for r in fit.table.orderBy("i").collect()])
    totals, plain = (p * t[:, None]).T @ rate, projected_gradient(p, t, target, floor)
    # where targets cannot be met the last thousandths are not worth their passes
    assert np.abs(totals - plain).max() < (5e-3 if fit.unmet else 1e-3) * t.sum()
    assert bool(fit.unmet) == (np.abs(plain - target).max() > 1e-3 * t.sum()) and (rate >= floor).all()
    assert all(abs(v - (totals - target)[i] / t.sum()) < 1e-5 for i, v in fit.unmet.items())


@pytest.mark.parametrize("aim", [(0.1, 0.2, 0.7), (0.45, 0.35, 0.2)])
def test_rates_against_brute_force(spark, aim):
    """Where no rate reaches the floor, they are the rates that differ least from 1, weighed by tokens."""
    rng = np.random.default_rng(3)
    p = 0.3 * rng.dirichlet([1] * 3, 80) + 0.7 * np.eye(3)[rng.integers(0, 3, 80)]
    t = rng.integers(1, 100, 80)
    a = (p * t[:, None]).T
    target = 0.5 * a.sum(axis=1) + 0.5 * np.array(aim) * t.sum()
    rows = [(i, int(x), b.tolist()) for i, (x, b) in enumerate(zip(t, p))]
    fit = fit_rates(spark.createDataFrame(rows, "i int, tokens long, posterior array<double>").coalesce(2), target.tolist(), tolerance=1e-9)
    rate = np.array([r.rate for r in fit.table.orderBy("i").collect()])
    least = 1 - p @ np.linalg.solve(a @ p, a.sum(axis=1) - target)
    assert least.min() > 0 and np.abs(rate - least).max() < 1e-6


def test_edge_cases(spark, make_docs, corpus):
    docs, domains = corpus
    odd = [(None, "en1 en2"), (5000, None), (5001, ""), (5002, " \n\t"), (5003, "fr1 " * 30000), (0, docs[0][1])]
    known = spark.createDataFrame([*((i, d) for i, d in domains.items()), (None, "en"), (1, None), (2, "xx")],
                                  "doc_id long, domain string")
    rows = mix(make_docs([*docs, *odd]), known, WEIGHTS).collect()
    assert len(rows) == len(docs) + len(odd)
    found = {r.doc_id: r for r in rows}
    assert found[5003].domain == "fr" and found[5003].tokens == 30000 and found[5001].tokens == 0
    assert mix(make_docs([]), known, WEIGHTS).count() == 0
    one = mix(make_docs(docs[:20]), known.where("domain = 'fr'"), WEIGHTS, total_tokens=1000).collect()
    assert {r.domain for r in one} == {"fr"}
    assert mix(make_docs(docs[:5]), known.limit(0), WEIGHTS).count() == 5
    with pytest.raises(ValueError):
        mix(make_docs(docs), known, {"en": 0.0})


SKEWED = [(0.85, 0.10, 0.04, 0.01), (0.97, 0.01, 0.01, 0.01), (0.9989, 0.001, 0.00009, 0.00001)]


@pytest.mark.parametrize("shares, leak", [(SKEWED[0], 0.0), (SKEWED[1], 0.002), (SKEWED[2], 0.0)])
def test_scarce_domains_meet_their_targets(spark, shares, leak):
    """Domains of 1 % and less reach their shares, however skewed the tokens are."""
    p = np.full((4, 4), leak)
    np.fill_diagonal(p, 1 - 3 * leak)
    tokens = [round(s * 10**6) for s in shares]
    table = spark.createDataFrame(list(zip(tokens, p.tolist())), "tokens long, posterior array<double>").coalesce(1)
    target = np.array([0.5, 0.2, 0.18, 0.12]) * sum(tokens)
    fit = fit_rates(table, target.tolist())
    rate = np.array([r.rate for r in fit.table.collect()])
    assert np.abs(p.T @ (rate * tokens) - target).max() < 1e-3 * sum(tokens)
    assert not fit.unmet


def test_unmet_targets_are_reported(spark):
    """No rate can help a missing domain; the others still meet their targets."""
    rows = [(90, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame(rows, "tokens long, posterior array<double>").coalesce(1)
    fit = fit_rates(table, [50.0, 30.0, 20.0])
    assert set(fit.unmet) == {2} and abs(fit.unmet[2] + 0.2) < 1e-6
    rate = np.array([r.rate for r in fit.table.collect()])
    assert np.allclose(rate * [90, 10], [50, 30], atol=0.1)


def test_unmet_targets_warn_or_raise(spark, make_docs, corpus):
    docs, domains = corpus
    known = labelled(spark, domains).where("domain = 'fr'")
    with pytest.warns(UserWarning, match="unmet"):
        mix(make_docs(docs[:20]), known, WEIGHTS)
    with pytest.raises(ValueError, match="unmet"):
        mix(make_docs(docs[:20]), known, WEIGHTS, strict=True)
