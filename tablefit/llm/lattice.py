"""Subword lattices of words, in numpy: marginal probabilities over all segmentations.

A word's lattice has an arc for each vocabulary piece that stands in it; its
first piece carries the vocabulary's word-start mark.  The forward recursion
sums, in log space, over all paths.  Bytes have pieces of their own, so every
word has a path.  Words of one length are done together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tablefit.llm.batches import _BYTES, _INVERSE, U64, mix, powers

START = "▁"
#: Words are done together by these greatest lengths in bytes, longer ones one by one.
WIDTHS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 96)
LONG = WIDTHS[-1]
SLOTS = 17


def piece_bytes(piece: str) -> tuple[bool, bytes]:
    """Whether the piece begins a word, and its bytes without the mark; `<0x41>` is the byte A."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return False, bytes([int(piece[3:5], 16)])
    begins = piece.startswith(START)
    return begins, piece[begins:].encode()


def _hash(data: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Scrambled hash of each row of a byte matrix."""
    return mix((_BYTES[data] * ones[: data.shape[1]]).sum(axis=1, dtype=U64) + U64(data.shape[1]))


class _Table:
    """Piece numbers by hash: slots by some bits of it, and a further table by other bits for what clashes."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.levels, turn = [], 0
        while len(keys):
            slot = self._slot(keys, turn)
            _, first = np.unique(slot, return_index=True)
            held, number = np.zeros(1 << SLOTS, U64), np.full(1 << SLOTS, -1, np.int32)
            held[slot[first]], number[slot[first]] = keys[first], numbers[first]
            self.levels.append((held, number))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, numbers, turn = keys[rest], numbers[rest], turn + 1

    @staticmethod
    def _slot(hashes: np.ndarray, turn: int) -> np.ndarray:
        if turn >= 3:
            hashes, turn = mix(hashes + U64(turn)), 0
        return ((hashes >> U64(64 - SLOTS * (turn + 1))) & U64((1 << SLOTS) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, -1, np.int32)
        for turn, (held, number) in enumerate(self.levels):
            slot = self._slot(hashes, turn)
            own = held[slot] == hashes
            out[own] = number[slot[own]]
        return out


@dataclass
class Pieces:
    """A vocabulary: what each piece spells, whether it begins words, and its natural log probability."""

    spelled: list[tuple[bool, bytes]]
    logp: np.ndarray

    def __post_init__(self) -> None:
        self.most = max((len(b) for _, b in self.spelled), default=1)
        ones = powers(self.most + 1)
        self.bare_start = next((i for i, (begins, b) in enumerate(self.spelled) if begins and not b), -1)
        self.tables = []
        for begins in (True, False):
            keys, numbers = [], []
            for n in range(1, self.most + 1):
                own = [i for i, (s, b) in enumerate(self.spelled) if s == begins and len(b) == n]
                if own:
                    data = np.frombuffer(b"".join(self.spelled[i][1] for i in own), np.uint8).reshape(-1, n)
                    keys.append(_hash(data, ones))
                    numbers.append(np.array(own, np.int32))
            # two pieces may spell the same (a letter and its byte): the tables hold one, `twin` leads to the other
            keys, numbers = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, U64), (numbers, np.int32)))
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            self.twin = getattr(self, "twin", np.full(len(self.spelled), -1, np.int32))
            same = np.flatnonzero(first[back] != np.arange(len(keys)))
            self.twin[numbers[first[back[same]]]] = numbers[same]
            self.tables.append(_Table(keys[first], numbers[first]))
        self._weigh()

    def _weigh(self) -> None:
        both = np.where(self.twin >= 0, np.logaddexp(self.logp, self.logp[self.twin]), self.logp)
        self.arc = np.append(both, -np.inf)

    def weighted(self, logp: np.ndarray) -> Pieces:
        """The same pieces with other probabilities."""
        other = object.__new__(Pieces)
        other.__dict__.update(self.__dict__)
        other.logp = logp
        other._weigh()
        return other

    def _arcs(self, data: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers (-1: none) by begin and end, for a matrix of words of one length; begin -1: from word start."""
        words, n = data.shape
        sums = np.zeros((words, n + 1), U64)
        np.cumsum(_BYTES[data] * powers(n), axis=1, out=sums[:, 1:])
        back = powers(n + 1, _INVERSE)
        out = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.most) + 1):
                hashes = mix((sums[:, j] - sums[:, i]) * back[i] + U64(j - i))
                if not i:
                    out[-1, j] = self.tables[0].find(hashes)
                out[i, j] = self.tables[1].find(hashes)
        return out

    def _forward(self, arcs: dict, n: int, words: int) -> np.ndarray:
        alpha = np.full((n + 1, words), -np.inf)
        if self.bare_start >= 0:
            alpha[0] = self.logp[self.bare_start]
        for j in range(1, n + 1):
            terms = [self.arc[arcs[-1, j]]] if (-1, j) in arcs else []
            terms += [alpha[i] + self.arc[arcs[i, j]] for i in range(max(0, j - self.most), j)]
            alpha[j] = _logsum(terms)
        return alpha

    def _grouped(self, words: list[bytes], most: int = 1 << 20):
        """Places, byte matrix and sizes of words of like length, about `most` substrings at a time.

        Shorter words of a group are filled up; what stands behind a word's end is never read.
        """
        sizes = np.array([len(w) for w in words])
        low = 0
        for high in (*WIDTHS, int(sizes.max(initial=0))):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            if low >= LONG:
                for i in own:
                    yield [i], None, None
                continue
            step = max(1, most // int(high * min(high, self.most)))
            for at in range(0, len(own), step):
                some = own[at:at + step]
                filled = b"".join(words[i].ljust(high, b"\0") for i in some)
                yield some, np.frombuffer(filled, np.uint8).reshape(-1, high), sizes[some]
            low = high

    def marginal(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each (not empty) word's probability, summed over its segmentations."""
        return self.marginals(words)[0]

    def marginals(self, words: list[bytes], *others: Pieces) -> np.ndarray:
        """`marginal` by these probabilities and by others of the same pieces (see `weighted`), a row for each."""
        ways = (self, *others)
        out = np.empty((len(ways), len(words)))
        for some, data, sizes in self._grouped(words):
            arcs = None if data is None else self._arcs(data)
            for way, row in zip(ways, out):
                if data is None:
                    row[some[0]] = way._long_forward(words[some[0]])[len(words[some[0]])]
                else:
                    row[some] = way._forward(arcs, data.shape[1], len(some))[sizes, np.arange(len(some))]
        return out

    def _stretches(self, word: bytes, backwards: bool = False, size: int = 1 << 14):
        """Begin, and piece numbers by begin and length (-1: none), of stretches of a word of any length."""
        for at in sorted(range(0, len(word), size), reverse=backwards):
            stretch = np.frombuffer(word, np.uint8)[at:at + size + self.most]
            sums = np.concatenate(([U64(0)], np.cumsum(_BYTES[stretch] * powers(len(stretch)), dtype=U64)))
            back = powers(len(stretch) + 1, _INVERSE)
            last = min(size, len(word) - at)
            found = np.full((last, self.most), -1, np.int32)
            for n in range(1, self.most + 1):
                begin = np.arange(max(0, min(last, len(stretch) - n + 1)))
                found[begin, n - 1] = self.tables[1].find(mix((sums[begin + n] - sums[begin]) * back[begin] + U64(n)))
            yield at, found

    def _first(self, word: bytes) -> np.ndarray:
        """Numbers of the word-start pieces by length."""
        head = np.frombuffer(word[: self.most], np.uint8)
        sums = np.cumsum(_BYTES[head] * powers(len(head)), dtype=U64)
        return self.tables[0].find(mix(sums + np.arange(1, len(head) + 1, dtype=U64)))

    def _long_forward(self, word: bytes) -> np.ndarray:
        """The forward recursion for one word of any length."""
        alpha = np.full(len(word) + 1 + self.most, -np.inf)
        if self.bare_start >= 0:
            alpha[0] = self.logp[self.bare_start]
        first = self.arc[self._first(word)]
        alpha[1:len(first) + 1] = first
        for at, found in self._stretches(word):
            arcs = self.arc[found]
            for i in range(len(arcs)):
                j = at + i + 1
                alpha[j:j + self.most] = np.logaddexp(alpha[j:j + self.most], alpha[j - 1] + arcs[i])
        return alpha

    def _long_expected(self, word: bytes, count: float, out: np.ndarray) -> None:
        alpha = self._long_forward(word)
        total = alpha[len(word)]
        beta = np.full(len(alpha), -np.inf)
        beta[len(word)] = 0.0
        for at, found in self._stretches(word, backwards=True):
            arcs = self.arc[found]
            for i in range(len(arcs) - 1, -1, -1):
                j = at + i + 1
                through = arcs[i] + beta[j:j + self.most]
                beta[j - 1] = np.logaddexp.reduce(through)
                used = found[i] >= 0
                np.add.at(out, found[i][used], count * np.exp(alpha[j - 1] + through[used] - total))
        first = self._first(word)
        used = np.flatnonzero(first >= 0)
        np.add.at(out, first[used], count * np.exp(self.arc[first[used]] + beta[used + 1] - total))
        if self.bare_start >= 0:
            out[self.bare_start] += count * np.exp(alpha[0] + beta[0] - total)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in `counts` copies of the words, expected over segmentations."""
        out = np.zeros(len(self.spelled))
        for some, data, sizes in self._grouped(words):
            if data is None:
                self._long_expected(words[some[0]], counts[some[0]], out)
                continue
            n, arcs, c = data.shape[1], self._arcs(data), counts[some]
            alpha = self._forward(arcs, n, len(some))
            beta = np.full((n + 1, len(some)), -np.inf)
            beta[sizes, np.arange(len(some))] = 0.0
            for i in range(n - 1, -1, -1):
                onward = _logsum([self.arc[arcs[i, j]] + beta[j] for j in range(i + 1, min(n, i + self.most) + 1)])
                beta[i] = np.where(i < sizes, onward, beta[i])
            total = alpha[sizes, np.arange(len(some))]
            for (i, j), piece in arcs.items():
                own = np.flatnonzero((piece >= 0) & (j <= sizes))
                if len(own):
                    before = 0.0 if i < 0 else alpha[i, own]
                    used = c[own] * np.exp(before + self.arc[piece[own]] + beta[j, own] - total[own])
                    out += np.bincount(piece[own], used, len(out))
            if self.bare_start >= 0:
                out[self.bare_start] += (c * np.exp(alpha[0] + beta[0] - total)).sum()
        # what two pieces spell alike is theirs by their probabilities
        pair = np.flatnonzero(self.twin >= 0)
        share = np.exp(self.logp[self.twin[pair]] - self.arc[pair])
        out[self.twin[pair]] += out[pair] * share
        out[pair] *= 1 - share
        return out


def _logsum(terms: list[np.ndarray]) -> np.ndarray:
    top = terms[0]
    for t in terms[1:]:
        top = np.maximum(top, t)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.zeros_like(safe)
    for t in terms:
        total += np.exp(t - safe)
    with np.errstate(divide="ignore"):
        return np.log(total) + safe


def existing_logp(scores: np.ndarray, spelled: list[tuple[bool, bytes]]) -> np.ndarray:
    """Log probabilities from a vocabulary's own scores.

    Scores that are merge ranks (0, -1, -2 ...) say only the order of pieces;
    they are taken by Zipf's law, others as log probabilities.  Pieces of one
    byte, of which vocabularies score no use, weigh as little as the least.
    """
    raw = -np.log1p(-scores) if scores.min() < -1000 else np.array(scores)
    single = np.array([len(b) == 1 and not begins for begins, b in spelled])
    raw[single] = raw[~single].min() if (~single).any() else 0.0
    raw -= raw.max()
    return raw - np.log(np.exp(raw).sum())
