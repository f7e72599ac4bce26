"""The full-text index against plain search."""

import random

import numpy as np
import pytest

from panelmill.llm.fmindex import FAR, Bits, FMIndex, WaveletTree, code_lengths


def test_bits_and_tree():
    rng = np.random.default_rng(1)
    for n, s in ((1, 1), (63, 2), (64, 3), (200, 1), (1000, 40), (5000, 900)):
        row = np.minimum(rng.zipf(1.4, n) - 1, s - 1)
        bits = rng.random(n) < 0.3
        at = rng.integers(0, n + 1, 300)
        assert (Bits(bits).ones(at) == np.concatenate([[0], np.cumsum(bits)])[at]).all()
        tree, sym = WaveletTree(row, s), rng.integers(0, s, 300)
        assert (tree.rank(sym, at) == [(row[:a] == c).sum() for c, a in zip(sym, at)]).all()
    bits = code_lengths(np.array([5, 1, 1, 1]))
    assert (2.0 ** -bits).sum() == 1 and bits[0] == 1


def brute(texts, owner, query, length):
    def held(p):
        return [o for t, o in zip(texts, owner) for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p]

    count, least = [], []
    for i in range(len(query)):
        m = 0
        while m < length and i + m < len(query) and query[i + m] >= 0 and held(query[i : i + m + 1]):
            m += 1
        count.append(m)
        least.append(min(held(query[i : i + length])) if m == length else FAR)
    return count, least


@pytest.mark.parametrize("length", [4, 5, 8])
def test_matching_statistics(length):
    rng = random.Random(length)
    for symbols in (1, 2, 4, 30):
        texts = [[rng.randrange(symbols) for _ in range(rng.randint(length, 25))] for _ in range(12)]
        texts += [texts[0], texts[1][2:] + texts[2], [0] * 20]
        owner = [rng.randrange(9) for _ in texts]
        index = FMIndex([np.array(t) for t in texts], np.array(owner), symbols, length)
        asked = texts + [[rng.randrange(-1, symbols) for _ in range(rng.randint(0, 30))] for _ in range(20)]
        asked += [texts[3][:6] + texts[4][:9], []]
        count, least = index.matches([np.array(t, np.int64) for t in asked])
        for q, c, o in zip(asked, count, least):
            assert (c.tolist(), o.tolist()) == brute(texts, owner, q, length)
