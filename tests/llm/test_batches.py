import numpy as np
import pyarrow as pa
import pytest

from tablefit.llm.batches import Links, Words, forest, text_slices, whole_runs


def test_words_are_hashed_by_what_they_spell():
    texts = [b"The cat  sat", b"", b"\t", b"a", b"the\ncat\x0bsat the CAT", "é日 x".encode()]
    words = Words(texts)
    found = [(int(of), words.joined[b:e]) for of, b, e in zip(words.of, words.begin, words.end)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
    by_word = {}
    for (_, w), h in zip(found, words.hashes):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles(k):
    texts = [b"a b c d e f g", b"a b", b"", b"a b c d e", b"c d e f g"]
    hashes, of = Words(texts).shingles(k)
    expected = {}
    for i, t in enumerate(texts):
        words = t.split()
        for j in range(max(1, len(words) - k + 1) if words else 0):
            expected.setdefault(i, []).append(b" ".join(words[j:j + k]))
    assert np.bincount(of, minlength=5).tolist() == [len(expected.get(i, [])) for i in range(5)]
    spelled = [s for i in range(5) for s in expected.get(i, [])]
    meaning = {}
    for h, s in zip(hashes, spelled):
        assert meaning.setdefault(s, h) == h
    assert len(set(meaning.values())) == len(meaning)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_whole_runs_are_never_cut(size):
    keys = [(None, 1), (None, 1), (1, 1), (1, 2), (1, 2), (1, 2), (1, 2), (2, None), (3, 0), (3, 0)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(range(10))], ["a", "b", "v"]
    )
    batches = iter([rows.slice(i, size) for i in range(0, 10, size)])
    found = []
    for table, starts in whole_runs(batches, ("a", "b")):
        v = table.column("v").to_pylist()
        found += [v[s:e] for s, e in zip(starts[:-1], starts[1:])]
    assert found == [[0, 1], [2], [3, 4, 5, 6], [7], [8, 9]]


def test_forest_and_links():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, (2, 400))
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    expected = {i: find(i) for i in range(500) if find(i) != i}
    assert dict(zip(*(x.tolist() for x in forest(a, b)))) == expected
    links = Links(most=10)
    for i in range(0, 400, 7):
        links.add(a[i:i + 7], b[i:i + 7])
    got = {x: y for batch in links.batches(3) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())}
    assert got == expected


def test_slices_by_size():
    rows = pa.RecordBatch.from_arrays([pa.array(["x" * 10, "", None, "y" * 1000, "z", "w" * 9])], ["t"])
    parts = [p.column("t").to_pylist() for p in text_slices(rows, "t", most=20)]
    assert sum(parts, []) == rows.column("t").to_pylist()
    assert parts == [["x" * 10, "", None], ["y" * 1000], ["z", "w" * 9]]
