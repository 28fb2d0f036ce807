import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tablefit.llm.lattice import Pieces
from tablefit.llm.scoring import load_pieces, score_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_base(docs):
    split = [(i, (t or "").encode().lower().split()) for i, t in docs]
    counts = Counter(w for i, words in split if not fold(i) for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, words in split:
        tokens = [*words, None]
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in tokens)
        out.append((i, fold(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


@pytest.mark.parametrize("head", [100, 1 << 20])
def test_base_of_documents(documents, head):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got, expected = found(score_documents(documents, PATH, head=head)), plain_base(docs)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(abs(g[5] - e[5]) < 1e-5 for g, e in zip(got, expected))


def test_scores_do_not_depend_on_the_head(documents):
    few, many = (
        {r.doc_id: r.score for r in score_documents(documents, PATH, head=h).collect()} for h in (50, 1 << 20)
    )
    assert all(abs(few[i] - many[i]) < 1e-6 * abs(many[i]) for i in many)


def test_edge_cases(make_docs):
    docs = [(1, None), (2, ""), (2, "the the"), (None, "a b"), (3, "x" * 500), (4, "日本 \x00 é"), (5, "the " * 20000),
            (6, "The THE the\x0bend"), (13, "unseen-word zzz")]
    rows = make_docs(docs)
    got, expected = found(score_documents(rows, PATH)), plain_base(docs)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(abs(g[5] - e[5]) < 1e-5 * abs(e[5]) for g, e in zip(got, expected))
    assert score_documents(make_docs([]), PATH).count() == 0
    only_held = [(i, "some text") for i in range(60) if fold(i)]
    assert {r.train_tokens for r in score_documents(make_docs(only_held), PATH).collect()} == {0}


def brute(word, spelled, p):
    """Sum over all segmentations, by trying each."""
    def rest(at, start):
        total = 1.0 if at == len(word) and not start else 0.0
        for (begins, b), weight in zip(spelled, p):
            if begins == start and word.startswith(b, at) and (b or start):
                total += weight * rest(at + len(b), False)
        return total
    return rest(0, True)


def test_lattice_against_all_segmentations():
    spelled = [(True, b""), (True, b"a"), (True, b"ab"), (False, b"a"), (False, b"b"), (False, b"ab"), (False, b"ba"),
               (False, b"abab"), (False, b"a"), (True, b"abab")]
    p = np.random.default_rng(0).dirichlet(np.ones(len(spelled)))
    pieces = Pieces(spelled, np.log(p))
    words = [b"a", b"ab", b"ababa", b"bbaab", b"abababab", b"ab"]
    assert np.allclose(np.exp(pieces.marginal(words)), [brute(w, spelled, p) for w in words])
    use = pieces.expected(words, np.ones(len(words)))
    # expected uses are derivatives of the log likelihood
    for i in range(len(spelled)):
        q = p.copy()
        q[i] *= 1 + 1e-6
        slope = sum(math.log(brute(w, spelled, q)) - math.log(brute(w, spelled, p)) for w in words) / 1e-6
        assert abs(slope - use[i]) < 1e-3
    long = b"ab" * 70
    short_way = pieces._forward(pieces._arcs(np.frombuffer(long, np.uint8).reshape(1, -1)), len(long), 1)[-1][0]
    assert abs(pieces.marginal([long])[0] - short_way) < 1e-9
    out = np.zeros(len(spelled))
    pieces._long_expected(b"ababa", 1.0, out)
    both = pieces.expected([b"ababa"], np.ones(1))
    assert np.allclose(out[3] + out[8], both[3] + both[8]) and np.allclose(out[[0, 1, 2, 4, 5, 6]], both[[0, 1, 2, 4, 5, 6]])


def test_refit_beats_the_vocabulary_alone(documents):
    zero, two = (
        {r.doc_id: r.score for r in score_documents(documents, PATH, rounds=n).where("held_out").collect()} for n in (0, 2)
    )
    assert sum(two.values()) > sum(zero.values())
    assert len(load_pieces(PATH).spelled) > 30000


def ways(word, spelled):
    """All segmentations of a word, as lists of piece numbers."""
    by_start = {True: {}, False: {}}
    for number, (begins, b) in enumerate(spelled):
        by_start[begins].setdefault(b, []).append(number)

    def rest(at, start):
        if at == len(word) and not start:
            yield []
        for end in range(at if start else at + 1, len(word) + 1):
            for number in by_start[start].get(word[at:end], []):
                for onward in rest(end, False):
                    yield [number, *onward]

    return list(rest(0, True))


@pytest.mark.parametrize("head", [1, 1 << 20])
def test_whole_scores_against_all_segmentations(make_docs, head):
    """Expectation maximisation and all three scores, from lists of every segmentation."""
    docs = [(0, "the cat sat"), (1, "The dog the"), (2, "a cat é"), (3, "sat on a on"), (5, ""), (8, "zebra the a"), (None, "dog dogs")]
    docs += [(i, "the unseen cats a") for i in range(9, 30) if fold(i)]
    split = [(i, t.encode().lower().split()) for i, t in docs]
    train = [words for i, words in split if not fold(i)]
    counts, n_ends = Counter(w for words in train for w in words), len(train)
    total = sum(counts.values())
    existing = load_pieces(PATH)
    listed = {w: ways(w, existing.spelled) for _, words in split for w in words}
    own = p = np.exp(existing.logp)

    def lattice(word, p):
        return sum(math.prod(p[x] for x in way) for way in listed[word])

    for _ in range(2):
        use = 1000.0 * own
        for word in counts:
            for way in listed[word]:
                part = math.prod(p[x] for x in way) / lattice(word, p)
                for x in way:
                    use[x] += part
        p = use / use.sum()
    share = 1 - sum(c == 1 for c in counts.values()) / total
    end = (n_ends + 1) / (total + n_ends + 2)

    def text(words, chance):
        return sum(math.log10((1 - end) * chance(w)) for w in words) + math.log10(end)

    expected = sorted((i if i is not None else -1, *(text(words, chance) for chance in (
        lambda w: share * counts[w] / total + (1 - share) * lattice(w, p), lambda w: lattice(w, p), lambda w: lattice(w, own),
    ))) for i, words in split)
    rows = score_documents(make_docs(docs), PATH, head=head).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score, r.lattice_score, r.vocabulary_score) for r in rows)
    assert [g[0] for g in got] == [e[0] for e in expected] and any(fold(i) for i, _ in docs)
    assert np.allclose([g[1:] for g in got], [e[1:] for e in expected], atol=1e-6)
