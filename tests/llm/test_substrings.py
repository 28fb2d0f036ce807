import random

import numpy as np
import pytest

from tablefit.llm import substrings
from tablefit.llm.substrings import cut_repeats


def plain(docs, threshold):
    """By comparing every window with every window of documents before."""
    data = [(i, (t or "").encode()) for i, t in docs]
    least = {}
    order = lambda i: (i is None, i or 0)
    for i, b in data:
        for p in range(len(b) - threshold + 1):
            w = b[p:p + threshold]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - threshold + 1):
            if least[b[p:p + threshold]] < order(i):
                gone[p:p + threshold] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((i, len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=repr)


def test_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    expected = plain(docs, 50)
    assert found(cut_repeats(documents)) == expected
    assert any(spans for _, _, spans, _ in expected)


def mosaic(seed, n, alphabet="ab"):
    """Texts put together from few passages, with cuts and repeats at all places."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(8)]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(passages)[rng.randrange(3):] for _ in range(rng.randrange(8)))
        docs.append((i // 2 if rng.random() < 0.1 else i, text))
    return docs


@pytest.mark.parametrize("crowd,held", [(3, 500_000), (50_000, 20)])
@pytest.mark.parametrize("seed,threshold,gram,alphabet", [(1, 10, 4, "ab"), (2, 12, None, "é日x"), (3, 10, 10, "abc"), (4, 50, 20, "ab")])
def test_mosaics(make_docs, spark, monkeypatch, crowd, held, seed, threshold, gram, alphabet):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "HELD", held)
    docs = mosaic(seed, 120, alphabet)
    # small batches, so that runs go over their edges
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = found(cut_repeats(make_docs(docs).repartition(5), threshold=threshold, gram=gram))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(docs, threshold)


def test_edge_cases(make_docs):
    passage = "0123456789" * 6
    long = "".join(random.Random(5).choices("abcdefgh ", k=300_000))
    docs = [(3, None), (1, ""), (2, "x" * 49), (9, "x" * 51), (4, passage), (5, passage[1:]), (5, passage), (5, "A" + passage),
            (None, passage + "B"), (None, passage), (6, "a" * 500), (7, "a" * 300 + "b"), (8, long), (10, "q" + long[1000:250_000] + "é"),
            (11, "short")]
    got = found(cut_repeats(make_docs(docs)))
    small = [d for d in docs if d[0] not in (8, 10)]
    assert [g for g in got if g[0] not in (8, 10)] == plain(small, 50)
    assert [g[2] for g in got if g[0] == 10] == [[(1, 249_001)]] and [g[2] for g in got if g[0] == 8] == [[]]
    assert cut_repeats(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        cut_repeats(make_docs(docs), threshold=200, gram=20)


def test_rows_of_one_id_whose_texts_hash_alike(make_docs):
    """Two texts of equal 32-bit hash, under null ids: each loses its own bytes only."""
    words = " some text of its own that is a bit longer than fifty bytes "
    a, b = f"t39794{words}315128686", f"t184635{words}1462124565"
    docs = [(1, a), (None, a), (None, b)]
    assert found(cut_repeats(make_docs(docs))) == plain(docs, 50)


@pytest.mark.parametrize("crowd", [5, 50_000])
def test_many_rows_without_an_id(make_docs, monkeypatch, crowd):
    """A third of the rows are one, and many texts share the null id."""
    monkeypatch.setattr(substrings, "CROWD", crowd)
    passage = "this passage of more than fifty bytes is in very many of the rows here"
    docs = [(1, f"x{passage}y")] + [(None, f"{i % 9}{passage}{i % 7}") for i in range(60)] + [(None, passage)] * 30 + [(7, passage)] * 30
    assert found(cut_repeats(make_docs(docs).repartition(5))) == plain(docs, 50)
