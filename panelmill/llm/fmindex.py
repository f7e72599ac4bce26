"""A compressed full-text index over numbers: backward search on a Huffman-shaped wavelet tree, many patterns at a time."""

from __future__ import annotations

import numpy as np

FAR = np.iinfo(np.int64).max


class Bits:
    """A packed row of bits that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol in a Huffman code; a lone symbol needs none."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].tolist()
    up = [0] * (2 * n - 1)
    leaf, node = 0, n
    for made in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= made or weight[leaf] <= weight[node]):
                took, leaf = leaf, leaf + 1
            else:
                took, node = node, node + 1
            total += weight[took]
            up[took] = made
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[up[i]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


class WaveletTree:
    """Counts of a symbol before a place of a row of symbols, in about as many bits a symbol as its entropy.

    Symbols are renamed by their canonical code, so that the nodes of a level stand in the order of their symbols and those whose code
    has ended stand before them.
    """

    def __init__(self, row: np.ndarray, symbols: int):
        counts = np.bincount(row, minlength=symbols)
        length = code_lengths(counts)
        order = np.argsort(length, kind="stable")
        self.name = np.empty(symbols, np.int64)
        self.name[order] = np.arange(symbols)
        self.length = length[order]
        counts = counts[order]
        code = np.zeros(symbols, np.uint64)
        steps = self.length.tolist()
        now = 0
        for i in range(1, symbols):
            now = (now + 1) << (steps[i] - steps[i - 1])
            code[i] = now
        self.levels: list[tuple[int, Bits, np.ndarray, np.ndarray, np.ndarray]] = []
        held = self.name[row]
        for level in range(int(self.length.max(initial=0))):
            first = int(np.searchsorted(self.length, level, "right"))
            start = self._starts(code, counts, level, first)
            bit = (code[first:] >> (self.length[first:] - 1 - level).astype(np.uint64) & np.uint64(1)).astype(bool)
            own = held - first
            ones = bit[own]
            bits = Bits(ones)
            begun = bits.ones(start)
            self.levels.append((first, bits, start, begun, bit))
            # place of each symbol in the next level: the start of its child, and how many of its node went there before it
            after = int(np.searchsorted(self.length, level + 1, "right"))
            stays = held >= after
            at, own = np.flatnonzero(stays), own[stays]
            inside = bits.ones(at) - begun[own]
            inside = np.where(ones[at], inside, at - start[own] - inside)
            nxt = np.empty(len(at), np.int64)
            if len(at):
                nxt[self._starts(code, counts, level + 1, after)[held[at] - after] + inside] = held[at]
            held = nxt

    def _starts(self, code: np.ndarray, counts: np.ndarray, level: int, first: int) -> np.ndarray:
        """Where the node of each symbol from ``first`` on starts in a level."""
        prefix = code[first:] >> (self.length[first:] - level).astype(np.uint64)
        new = np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)]
        done = np.cumsum(counts[first:]) - counts[first:]
        return done[np.flatnonzero(new)][np.cumsum(new) - 1] if len(prefix) else done

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        name, out = self.name[symbol], at.copy()
        live = np.arange(len(name))
        for first, bits, start, begun, bit in self.levels:
            if first:
                live = live[name[live] >= first]
            own, i = name[live] - first, out[live]
            ones = bits.ones(start[own] + i) - begun[own]
            out[live] = np.where(bit[own], ones, i - ones)
        return out


class FMIndex:
    """Texts of numbers (0 .. symbols - 1), searched for what they share with other texts, up to ``length`` numbers.

    Suffixes are put in the order of ``length`` numbers or more; the transform (the number before each suffix) goes into a wavelet tree. Of the
    suffix order itself only the lengths shared by neighbours and the smallest owner of each string of ``length`` numbers are kept.
    """

    def __init__(self, texts: list[np.ndarray], owner: np.ndarray, symbols: int, length: int):
        self.length, self.symbols = length, symbols
        end = np.full(1, symbols)
        flat = np.concatenate([x for t in texts for x in (t, end)]).astype(np.int64)
        self.size = n = len(flat)
        rank, k, ranks = flat.copy(), 1, []
        while True:
            ranks.append(rank.astype(np.int32))
            key = rank << 32
            key[: n - k] |= rank[k:] + 1
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
            k *= 2
            if k >= length:
                break
        a, b = order[:-1], order[1:]
        same = np.zeros(n - 1, np.int64)
        for step, r in [(k, rank.astype(np.int32)), *((1 << i, ranks[i]) for i in range(len(ranks) - 1, -1, -1))]:
            # suffixes that agree in all of the last rank's numbers have reached the limit
            fits = np.maximum(a, b) + same < n
            hit = fits & (r[np.minimum(a + same, n - 1)] == r[np.minimum(b + same, n - 1)]) & (same < length)
            same[hit] += step
        self.shared = np.append(-1, np.minimum(same, length)).astype(np.int16)
        self.tree = WaveletTree(flat[order - 1], symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=symbols + 1))])
        self.near, self.near_at = self._classes(length - 1)
        self.whole, at = self._classes(length)
        whose = np.repeat(owner, [len(t) + 1 for t in texts])[order]
        self.least = np.minimum.reduceat(whose, at[:-1])
        self.jumps: list[np.ndarray] | None = None

    def _classes(self, depth: int) -> tuple[Bits, np.ndarray]:
        """Rows that start a class of suffixes with the same first ``depth`` numbers."""
        new = self.shared < depth
        return Bits(new), np.append(np.flatnonzero(new), self.size)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffix starts with the symbol, followed by what the rows lo .. hi start with."""
        n = len(lo)
        at = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.first[symbol] + at[:n], self.first[symbol] + at[n:]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest shorter match that more rows start with: its length and rows."""
        if self.jumps is None:  # least shared length of 1, 2, 4 ... rows from each on
            self.jumps = [self.shared]
            while 2 << (len(self.jumps) - 1) <= self.size:
                x, s = self.jumps[-1], 1 << (len(self.jumps) - 1)
                self.jumps.append(np.minimum(x[: len(x) - s], x[s:]))
        depth = np.maximum(self.shared[lo], np.where(hi < self.size, self.shared[np.minimum(hi, self.size - 1)], 0)).astype(np.int64)
        depth = np.maximum(depth, 0)
        for k in range(len(self.jumps) - 1, -1, -1):
            s, x = 1 << k, self.jumps[k]
            back = lo - s + 1
            go = (back > 0) & (x[np.clip(back, 0, len(x) - 1)] >= depth)
            lo = np.where(go, lo - s, lo)
            go = (hi + s <= self.size) & (x[np.clip(hi, 0, len(x) - 1)] >= depth)
            hi = np.where(go, hi + s, hi)
        return lo, hi, depth

    def matches(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Matching statistics: for each place of each text, how many numbers from it on the index holds (``length`` at most), and the
        smallest owner where it is ``length`` (a large number elsewhere).

        The texts are streamed from their ends, all in step. A match of full length first drops its last number; one that the index cannot extend
        is shortened until it can. Numbers that the index does not hold are negative.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
        stop = np.cumsum(sizes)[order]
        count, least = np.zeros(len(flat), np.int16), np.full(len(flat), FAR)
        n = len(texts)
        lo, hi, m = np.zeros(n, np.int64), np.full(n, self.size), np.zeros(n, np.int64)
        down = -sizes[order]
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(down, -t))
            lo, hi, m = lo[:n], hi[:n], m[:n]
            at = stop[:n] - 1 - t
            c = flat[at]
            full = np.flatnonzero(m == self.length)
            k = self.near.ones(lo[full] + 1) - 1
            lo[full], hi[full], m[full] = self.near_at[k], self.near_at[k + 1], self.length - 1
            lost = c < 0
            lo[lost], hi[lost], m[lost] = 0, self.size, 0
            todo = np.flatnonzero(~lost)
            while len(todo):
                a, b = self.step(c[todo], lo[todo], hi[todo])
                good = a < b
                w = todo[good]
                lo[w], hi[w] = a[good], b[good]
                m[w] += 1
                todo = todo[~good]
                todo = todo[m[todo] > 0]
                if len(todo):
                    lo[todo], hi[todo], m[todo] = self.shorten(lo[todo], hi[todo])
            count[at] = m
            full = np.flatnonzero(m == self.length)
            least[at[full]] = self.least[self.whole.ones(lo[full] + 1) - 1]
        cut = np.cumsum(sizes)[:-1]
        return np.split(count, cut), np.split(least, cut)
