import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablefit.llm import lexical
from tablefit.llm.lexical import Best, Postings, Tree, search, terms

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [t.translate(LOWER) for t in PATTERN.findall(text or "")]


def plain(docs, items, k=50):
    """[(item, rank, doc, score)] by scoring every document for every item."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "", "") for i, t in rows], "item_id long, text string, doc_id string, rank string")


def test_terms():
    for text in ("", "A-b_c 1é2 Ünïcode\x00x\x7fy {z} `q` [w] @r :s ¿qué? naïve space 日本", None):
        assert [t.decode() for t in terms(text.encode() if text is not None else None)] == words(text)
    everything = "".join(map(chr, [*range(0x0, 0x200), 0x2028, 0x1F600]))
    assert [t.decode() for t in terms(everything.encode())] == words(everything)


def test_table_against_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = search(documents, items)
    assert found(got) == expected
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


@pytest.mark.parametrize("tree, leaf, item_bytes", [(7, 1, 40), (64, 4, 1 << 24), (8192, 32, 200)])
def test_many_trees_and_blocks(spark, make_docs, monkeypatch, tree, leaf, item_bytes):
    """A third of the documents are copies; ties are many."""
    for name, value in (("TREE_DOCS", tree), ("LEAF", leaf), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopq"))
    share = 1 / np.arange(1, 18) / (1 / np.arange(1, 18)).sum()
    docs = [(i, "a b c d e q" if i % 3 == 0 else " ".join(rng.choice(letters, rng.integers(1, 30), p=share))) for i in range(240)]
    items = [(j, " ".join(rng.choice(letters, 4))) for j in range(12)] + [(50, "q"), (51, "zebra"), (52, "a a a A")]
    got = search(make_docs(docs).repartition(3), _items(spark, items), k=10)
    assert found(got) == plain(docs, items, k=10)


def test_edge_cases(spark, make_docs):
    docs = [(None, "red fox"), (None, "red fox"), (None, None), (1, ""), (2, "---"), (3, "red fox"), (3, "red fox"), (3, "Red red fox runs"),
            (4, "blue ÉTÉ été"), (5, "fox " * 30000), (6, "x"), (2**62, "red fox")]
    items = [(None, "red"), (1, None), (2, ""), (3, "fox RED"), (3, "blue"), (4, "été"), (4, "été"), (5, "unknown words")]
    assert found(search(make_docs(docs), _items(spark, items))) == plain(docs, items)
    assert found(search(make_docs(docs), _items(spark, items), k=2)) == plain(docs, items, k=2)
    assert search(make_docs([]), _items(spark, items)).count() == 0
    assert search(make_docs([(1, None), (2, "!")]), _items(spark, items)).count() == 0
    assert search(make_docs(docs), _items(spark, [])).count() == 0


def _tree(docs, weights):
    ends = np.concatenate(([0], np.cumsum([len(d) for _, _, d in docs]))).astype(np.int64)
    ranks = np.array([r for _, _, d in docs for r in sorted(d)], np.int32)
    tfs = np.array([d[r] for _, _, d in docs for r in sorted(d)], np.int64)
    ids, m = np.array([i for i, _, _ in docs]), np.array([m for _, m, _ in docs])
    return Tree(Postings(ids, np.ones(len(docs), bool), m, ends, ranks, tfs), weights)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(50, 300), st.dictionaries(st.integers(0, 7), st.integers(1, 5))), min_size=1, max_size=60),
       st.sets(st.integers(0, 7), min_size=1), st.integers(1, 5))
def test_tree(docs, wanted, k):
    """Bounds hold for every document below a node, and the search finds the best."""
    docs, wanted = [(i, m, d) for i, (m, d) in enumerate(docs)], np.array(sorted(wanted))
    weights = np.array([0, 3, 10, 50, 200, 900, 4000, 9000])
    kept_leaf, lexical.LEAF = lexical.LEAF, 2
    try:
        tree = _tree(docs, weights)
    finally:
        lexical.LEAF = kept_leaf
    score = {i: sum(int(weights[t]) * ((10**9 * d[t]) // (1000 * d[t] + 20 * m)) for t in wanted if t in d) for i, m, d in docs}
    bounds = tree.bounds(wanted)
    for node, (low, high) in enumerate(zip(tree.low, tree.high)):
        assert all(score[i] <= bounds[node] for i in tree.docs.ids[low:high].tolist())
    mask = np.zeros(8, bool)
    mask[wanted] = True
    best = Best(k)
    tree.search(wanted, mask, best)
    assert list(zip(best.scores.tolist(), best.ids.tolist())) == sorted(
        ((s, i) for i, s in score.items() if s > 0), key=lambda x: (-x[0], x[1])
    )[:k]


def test_subtrees_are_cut_off():
    rng = np.random.default_rng(8)
    docs = [(i, 100, {int(r): 1 for r in set((rng.random(12) ** 2 * 400).astype(int))}) for i in range(4000)]
    docs += [(5000 + i, 100, {r: 1 for r in range(300, 312)}) for i in range(50)]
    tree = _tree(docs, np.arange(400) * 10 + 1)
    mask = np.zeros(400, bool)
    wanted = np.arange(300, 312)
    mask[wanted] = True
    best = Best(50)
    assert tree.search(wanted, mask, best) < 0.5 * len(docs)
    assert sorted(best.ids.tolist()) == list(range(5000, 5050))
