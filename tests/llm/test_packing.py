import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablefit.llm.packing import Places, WordTokenizer, fullest, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity=4096):
    """Every piece of every document, each sequence gapless, and near the least number of sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start:start + capacity]
            expected.append((doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    n, tokens = check(pack(documents, PATH).collect(), docs)
    assert n <= -(-tokens // 4096) * 1.02 + 2


def test_edge_cases(make_docs):
    docs = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, "a b"), (4, "don't  STOP\x0b'S it x y é ́a"),
            (5, "word " * 20000), (6, "x" * 30000), (7, "<|endoftext|> 1234 ½ ʼn İ ΑΣ"), (8, "a\x85b\x1cc d")]
    check(pack(make_docs(docs), PATH).collect(), docs)
    assert pack(make_docs([]), PATH).count() == 0


def test_small_capacity(make_docs):
    docs = [(i, "the of and " * (i % 7)) for i in range(200)]
    n, tokens = check(pack(make_docs(docs).repartition(7), PATH, capacity=16).collect(), docs, 16)
    # every length is 1 modulo 3, so few combinations fill a sequence
    assert n <= -(-tokens // 16) * 1.05 + 3


def test_words_forgotten():
    texts = ["a b c d e", "f g a", "c q"] * 3
    small, large = WordTokenizer(PATH, cached=3), WordTokenizer(PATH)
    assert [list(small.encode([t])) for t in texts] == [list(large.encode([t])) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_fullest(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
    room = rng.randrange(0, 60)
    sums = {0}
    for n, c in counts.items():
        sums |= {s + n * k for s in sums for k in range(c + 1)}
    chosen = fullest(counts, room)
    assert all(chosen[n] <= counts[n] for n in chosen)
    assert sum(n * m for n, m in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_of_many():
    counts = {n: 10**9 + n for n in range(1, 4097, 3)}
    patterns = plan(counts, 4096)
    used = defaultdict(int)
    for repeats, pattern in patterns:
        assert sum(n * m for n, m in pattern.items()) <= 4096
        for n, m in pattern.items():
            used[n] += repeats * m
    assert used == counts
    sequences = sum(r for r, _ in patterns)
    assert sequences <= sum(n * c for n, c in counts.items()) / 4096 * 1.001
    places = Places(patterns, 4096)
    s, o = places.find(np.array([4096, 1, 1]), np.array([0, 0, 10**9]))
    assert (s >= 0).all() and (o <= 4095).all()


def test_words_of_documents(documents):
    """Word by word the ids are the tokenizer's own."""
    tokenizer, own = Tokenizer.from_file(PATH), WordTokenizer(PATH, cached=5000)
    texts = [r.text for r in documents.select("text").collect()]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
