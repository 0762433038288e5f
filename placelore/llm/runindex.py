"""A run-length compressed Burrows-Wheeler index with sampled run ends, and matching statistics streamed over it."""

from __future__ import annotations

import numpy as np

from placelore.llm.anchors import ranges
from placelore.llm.arrays import mix, prefix, span


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """By prefix doubling; sym must end all suffixes differently (unique separators do)."""
    n = len(sym)
    if not n:
        return np.zeros(0, np.int64)
    low = int(sym.min())
    wide = int(sym.max()) - low + 2
    key, h = sym.astype(np.int64) - low + 1, 1
    while wide**2 < 1 << 62:  # as many symbols at once as a key holds
        key, wide, h = key * wide + np.r_[key[h:], np.zeros(min(h, n), np.int64)], wide**2, 2 * h
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    bits = n.bit_length()
    while int(rank.max()) < n - 1:
        ahead = np.zeros(n, np.int64)
        if h < n:
            ahead[:-h] = rank[h:] + 1
        if 3 * bits < 63:  # rank, rank ahead and place in one number: a plain sort orders them
            both = np.sort((((rank << bits) | ahead) << bits) | np.arange(n))
            place = both & ((1 << bits) - 1)
            both >>= bits
            rank = np.empty(n, np.int64)
            rank[place] = np.cumsum(np.r_[False, both[1:] != both[:-1]])
        else:
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """Holds runs: head symbol, begin, where the run's first symbol goes (LF), and the text positions of both ends.

    Beside them stand prefix hashes of the text, eight bytes a symbol, which compare two places of it; a block is bounded.
    """

    def __init__(self, sym: np.ndarray):
        n = len(sym)
        sa = suffix_array(sym)
        last = sym[sa - 1]
        self.begin = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        self.end = np.r_[self.begin[1:], n] - 1
        self.head = last[self.begin]
        self.first_at, self.last_at = sa[self.begin], sa[self.end]
        order = np.lexsort((self.begin, self.head))
        many = (self.end - self.begin + 1)[order]
        self.goes = np.empty(len(order), np.int64)
        self.goes[order] = np.cumsum(many) - many
        self.order, self.head_sorted = order, self.head[order]
        self.key = self.head_sorted * len(order) + order
        self.pre = prefix(mix(sym.astype(np.uint64)))

    def extension(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the text at p and at q, up to most."""
        n = len(self.pre) - 1
        low = np.minimum(most, n - np.maximum(p, q))
        part = np.flatnonzero(low > 0)
        part = part[span(self.pre, p[part], p[part] + low[part]) != span(self.pre, q[part], q[part] + low[part])]
        a, b, high = p[part], q[part], low[part] - 1
        short = np.zeros(len(part), np.int64)
        while (short < high).any():
            mid = (short + high + 1) >> 1
            same = span(self.pre, a, a + mid) == span(self.pre, b, b + mid)
            short, high = np.where(same, mid, short), np.where(same, high, mid - 1)
        low[part] = short
        return low

    def statistics(self, sym: np.ndarray, off: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Matching statistics of many patterns side by side, each streamed from its end to its begin.

        On a mismatch the match goes on from the nearest run end above or run begin below with the wanted symbol, whichever
        shares the longer prefix with what has matched so far: their sampled positions tell.
        """
        out = np.zeros(lens.sum(), np.int64)
        place = np.cumsum(lens) - lens
        runs = len(self.begin)
        row, have = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        at = np.full(len(lens), self.first_at[0])  # the suffix in row 0
        live = np.argsort(-lens, kind="stable")
        for t in range(int(lens.max(initial=0))):
            live = live[: np.searchsorted(-lens[live], -t, side="left")]
            c = sym[off[live] + lens[live] - 1 - t]
            x, p, ell = row[live], at[live], have[live]
            run = np.searchsorted(self.begin, x, side="right") - 1
            fits = self.head[run] == c
            y, q, m = self.goes[run] + (x - self.begin[run]), p - 1, ell + 1
            miss = np.flatnonzero(~fits)
            if len(miss):
                c2, k = c[miss], np.searchsorted(self.key, c[miss] * runs + run[miss])
                up, down = np.maximum(k - 1, 0), np.minimum(k, runs - 1)
                has_up = (k > 0) & (self.head_sorted[up] == c2)
                has_down = (k < runs) & (self.head_sorted[down] == c2)
                up, down = self.order[up], self.order[down]
                here, bound = p[miss], ell[miss]
                shared = self.extension(np.r_[here, here], np.r_[self.last_at[up], self.first_at[down]], np.r_[bound * has_up, bound * has_down])
                len_up, len_down = np.where(has_up, shared[: len(miss)], -1), np.where(has_down, shared[len(miss) :], -1)
                above = len_up >= len_down
                y[miss] = np.where(above, self.goes[up] + self.end[up] - self.begin[up], self.goes[down])
                q[miss] = np.where(above, self.last_at[up], self.first_at[down]) - 1
                m[miss] = np.maximum(len_up, len_down) + 1
                lost = miss[~(has_up | has_down)]
                y[lost], q[lost], m[lost] = 0, self.first_at[0], 0
            n = len(self.pre) - 1
            row[live], at[live], have[live] = y, np.where(q < 0, n - 1, q), m
            out[place[live] + lens[live] - 1 - t] = m
        return out


def match(W: int, raw, off, lens, block, off2, lens2, block2) -> np.ndarray:
    """Streams the patterns of bytes (off2, lens2) over a run index of the phrases (off, lens). True for each window that matches.

    A byte of raw is coded with its block, so that phrases meet only those of their own round.
    """
    place = raw[ranges(off, lens)].astype(np.int64)
    pattern = raw[ranges(off2, lens2)].astype(np.int64)
    m = len(lens)
    code = m + np.repeat(block, lens) * 256 + place
    code2 = m + np.repeat(block2, lens2) * 256 + pattern
    text = np.empty(len(code) + m, np.int64)
    stop = np.cumsum(lens) + np.arange(m)
    body = np.ones(len(text), bool)
    body[stop] = False
    text[stop] = np.arange(m)
    text[body] = code
    have = RunIndex(text).statistics(code2, np.cumsum(lens2) - lens2, lens2)
    begins = np.cumsum(lens2) - lens2
    return have[ranges(begins, lens2 - W + 1)] >= W
