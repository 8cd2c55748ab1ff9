"""FM-index over a sequence of word numbers, in numpy.

The suffix array is sorted by prefix doubling, the Burrows-Wheeler transform
sits in a wavelet matrix with block ranks, and every fourth text position is
sampled for locating. All operations work on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

#: number of the symbol that ends a text; texts never compare beyond it
END = 0
SAMPLE = 4


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of ``s``; a suffix ends at its first ``END``, equal ones keep their order in the text."""
    n = len(s)
    ends = np.flatnonzero(s == END)
    stop = ends[np.searchsorted(ends, np.arange(n))]  # the END of each position's text
    take = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(take):
        at = np.arange(n) + j
        inside = at <= stop
        key <<= bits
        key[inside] |= s[at[inside]].astype(np.int64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    # the ends themselves are told apart by their place
    rank[ends] = np.arange(len(ends))
    order[: len(ends)] = ends
    new[: len(ends)] = True
    done = take
    while True:
        # positions in the order whose group has several members
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, n))
        open_ = np.repeat(size > 1, size)
        slots = np.flatnonzero(open_)
        if not len(slots):
            return order
        at = order[slots]
        second = rank[np.minimum(at + done, stop[at])]
        head = rank[at]
        by = np.lexsort((second, head)) if n >= 1 << 31 else np.argsort(head * n + second)
        at, head, second = at[by], head[by], second[by]
        order[slots] = at
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])])
        new[slots] = fresh
        first = slots[fresh]
        count = np.diff(np.append(np.flatnonzero(fresh), len(slots)))
        rank[at] = np.repeat(first, count)
        done *= 2


class FMIndex:
    """Counts and places of phrases in a sequence; symbols are numbers below ``sigma``, ``END`` closes every text."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.n, self.bits = len(s), max(1, int(sigma - 1).bit_length())
        sa = suffix_array(s, self.bits)
        bwt = s[sa - 1].astype(np.int64)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=sigma), out=self.first[1:])
        # wavelet matrix: one level of bits per bit of a symbol, highest first
        self.blocks, self.counts, self.zeros = [], [], []
        cur = bwt
        for level in range(self.bits):
            bit = (cur >> (self.bits - 1 - level)) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.blocks.append(packed)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.counts.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])
        # where each symbol starts on the last level
        self.base = np.zeros(sigma, np.int64)
        present, starts = _starts(cur)
        self.base[present] = starts
        # sampled positions; the first of every text is one, since rows before an END don't keep its order
        mark = (sa % SAMPLE == 0) | (bwt == END)
        self.marks = np.packbits(mark, bitorder="little")
        self.marks = np.concatenate([self.marks, np.zeros(16 - len(self.marks) % 8, np.uint8)]).view(np.uint64)
        self.mark_counts = np.zeros(len(self.marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.marks), out=self.mark_counts[1:])
        self.samples = sa[mark].astype(np.int64)

    @staticmethod
    def _ones(blocks: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return counts[w] + np.bitwise_count(blocks[w] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` occurs among the first ``i`` of the transform."""
        for level in range(self.bits):
            ones = self._ones(self.blocks[level], self.counts[level], i)
            up = (c >> (self.bits - 1 - level)) & 1 == 1
            i = np.where(up, self.zeros[level] + ones, i - ones)
        return i - self.base[c]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: from the rows of phrases P to the rows of cP."""
        both = self.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        at = self.first[c]
        return at + both[: len(c)], at + both[len(c) :]

    def before(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is longer by one symbol."""
        c = np.zeros(len(i), np.int64)
        at = i
        for level in range(self.bits):
            w = at >> 6
            bit = (self.blocks[level][w] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(self.blocks[level], self.counts[level], at)
            c = (c << 1) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return self.first[c] + at - self.base[c]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to the next sampled position."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            w = at >> 6
            hit = (self.marks[w] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            if hit.any():
                out[todo[hit]] = self.samples[self._ones(self.marks, self.mark_counts, at[hit])] + steps
                todo, at = todo[~hit], at[~hit]
            if len(todo):
                at = self.before(at)
                steps += 1
        return out

    def shortest_rare(
        self, phrase: np.ndarray, start: np.ndarray, most: int, least_len: int, longest: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every end in ``phrase``, the shortest phrase that ends there and has at most ``most`` places.

        ``start`` has, for every place of ``phrase``, how far back a phrase may
        reach. Phrases that are still frequent at ``longest`` symbols are
        returned as well. Gives ends, lengths and row ranges.
        """
        end = np.arange(len(phrase))
        lo, hi = np.zeros(len(phrase), np.int64), np.full(len(phrase), self.n, np.int64)
        out = []
        for k in range(1, longest + 1):
            at = end - (k - 1)
            ok = at >= start[end]
            end, lo, hi, at = end[ok], lo[ok], hi[ok], at[ok]
            lo, hi = self.step(phrase[at], lo, hi)
            some = hi > lo
            end, lo, hi = end[some], lo[some], hi[some]
            rare = (hi - lo <= most) & (k >= least_len)
            if k == longest:
                rare[:] = True
            if rare.any():
                out.append((end[rare], np.full(int(rare.sum()), k), lo[rare], hi[rare]))
                end, lo, hi = end[~rare], lo[~rare], hi[~rare]
            if not len(end):
                break
        if not out:
            e = np.zeros(0, np.int64)
            return e, e, e, e
        return tuple(np.concatenate(x) for x in zip(*out))


def _starts(cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the last level and where each begins; equal symbols lie together there."""
    new = np.flatnonzero(np.concatenate([[True], cur[1:] != cur[:-1]]))
    return cur[new], new
