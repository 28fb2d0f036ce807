import hashlib

import numpy as np

from tablefit.llm import fingerprints as fp


def plain(docs):
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=repr)


def shingle_set(text, k=5):
    words = text.lower().split()
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows = fp.fingerprint_edits(documents, rows_per_part=17).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == plain(docs)
    by_text, text_of = {}, dict(docs)
    for r in rows:
        assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) > 0.98 * len(by_text)
    order = sorted(text_of)
    close = []
    for r in rows:
        following = text_of[order[(order.index(r.doc_id) + 1) % len(order)]]
        text = text_of[r.doc_id]
        half = len(text) // 2
        a, b = shingle_set(text), shingle_set(text[: len(text) - half] + following[:half])
        if len(a | b) > 400:
            close.append(abs(r.near_edited - len(a & b) / len(a | b)))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert len(close) > 20 and np.mean(close) < 0.06
    assert {(r.doc_id, r.fingerprint) for r in rows} == {tuple(r) for r in fp.fingerprint(documents).collect()}


def test_edge_cases(make_docs):
    docs = [(3, None), (1, ""), (2, "x"), (5, "a b"), (5, "a b"), (4, "a b c d e f"), (None, "q r"),
            (7, "word " * 50000), (8, "é\U0001f600z" * 3), (9, "A b")]
    for rows_per_part in (1, 3, 1000):
        rows = fp.fingerprint_edits(make_docs(docs).repartition(3), rows_per_part=rows_per_part).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == plain(docs)
    found = {r.doc_id: r for r in rows}
    assert found[3].fingerprint == found[1].fingerprint == ""
    assert found[5].fingerprint == found[9].fingerprint != found[2].fingerprint
    assert fp.fingerprint_edits(make_docs([])).count() == 0
    one = fp.fingerprint_edits(make_docs([(1, "a b c d")])).collect()
    assert [(r.near_next, r.doc_id) for r in one] == [(1.0, 1)]


def test_sketches_merge():
    rng = np.random.default_rng(1)
    below = fp.threshold(1 / 8)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    a, b = " ".join(words[:3000]), " ".join(words[2000:])
    small, large, both = fp.sketches(["w1 w2 w3 w4 w5", a, b], 5, below)
    assert np.array_equal(fp.merge(large, both, below), fp.merge(both, large, below))
    sketch_a, sketch_b = fp.sketches([a, b], 5, below)
    assert abs(fp.containment(sketch_b, sketch_a) - 0.5) < 0.1
    assert np.array_equal(fp.decode(fp.encode(sketch_a)), sketch_a)
    assert fp.encode(fp.merge(small, small, below)) == fp.encode(small)
    # hashes do not depend on what stands beside a text
    for texts in (["x", a], [a, b], ["", "", a, "z z"]):
        assert np.array_equal(fp.sketches(texts, 5, below)[texts.index(a)], sketch_a)


def plain_resemblance(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_short_texts(make_docs):
    """Texts of 1 to 30 words are compared exactly, with each other and with what holds them."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words[: 4 + i % 30], 1 + i % 30))) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " and " + docs[i + 1][1]) for i in range(0, 60)]
    rows = {r.doc_id: r for r in fp.fingerprint_edits(make_docs(docs), rows_per_part=50).collect()}
    order = sorted(docs)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = rows[i]
        assert np.isclose(r.near_edited, plain_resemblance(text, changed))
        assert np.isclose(r.near_next, plain_resemblance(text, following))
        a, b = shingle_set(text), shingle_set(following)
        assert np.isclose(r.next_holds, len(a & b) / len(a))


def test_short_in_long():
    rng = np.random.default_rng(5)
    below = fp.threshold(1 / 8)
    told = []
    for size in range(5, 31):
        for _ in range(12):
            words = [f"w{i}" for i in rng.integers(0, 10**6, 1000)]
            at = int(rng.integers(0, 900))
            short, long, other = fp.sketches([" ".join(words[at:at + size]), " ".join(words), " ".join(words[::-1])], 5, below)
            assert fp.is_whole(short) and not fp.is_whole(long)
            # wholly held wherever a hash tells it, never taken as apart
            assert fp.containment(short, long, below) in (1.0, None) and fp.containment(short, other, below) in (0.0, None)
            told.append(fp.containment(short, long, below) is not None)
            assert 0 <= fp.resemblance(long, short, below) <= 0.2
    assert np.mean(told) > 0.6


def test_merging_gives_the_sketch_of_both():
    rng = np.random.default_rng(6)
    below = fp.threshold(1 / 8)
    for sizes in ((3, 10), (40, 50), (30, 400), (0, 20), (600, 500), (1, 1)):
        texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, n)) for n in sizes]
        a, b = fp.sketches(texts, 5, below)
        sets = [shingle_set(t) for t in texts]
        both = np.unique(np.concatenate([fp.sketches([s], 5, below)[0][:1] if s else np.empty(0, np.uint64)
                                         for s in sets[0] | sets[1]]))
        whole = len(sets[0] | sets[1]) <= fp.SHORT
        expected = np.append(both, fp.WHOLE) if whole else both[both < below]
        assert np.array_equal(fp.merge(a, b, below), expected) and np.array_equal(fp.merge(b, a, below), expected)
    repeated = fp.sketches(["x y " * 9000], 5, below)[0]
    assert fp.is_whole(repeated) and len(repeated) == 3
