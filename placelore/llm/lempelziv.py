"""Relative Lempel-Ziv parsing of many texts against a block of reference texts."""

from __future__ import annotations

import numpy as np

from placelore.llm.anchors import ranges
from placelore.llm.arrays import mix, prefix, span
from placelore.llm.runindex import suffix_array


def longest(code: np.ndarray, refs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position from refs on: the longest match that begins in code[:refs], and its place.

    The reference suffixes next to a suffix in sorted order share the most with it.
    """
    n = len(code)
    sa = suffix_array(code)
    where = np.where(sa < refs, np.arange(n), -1)
    up = np.maximum.accumulate(where)
    down = np.minimum.accumulate(np.where(sa < refs, np.arange(n), n)[::-1])[::-1]
    pre = prefix(mix(code.astype(np.uint64)))
    rows = np.flatnonzero(sa >= refs)
    best, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near, there in ((up[rows], up[rows] >= 0), (down[rows], down[rows] < n)):
        p, q = sa[rows[there]], sa[near[there]]
        low, high = np.zeros(len(p), np.int64), n - np.maximum(p, q)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = span(pre, p, p + mid) == span(pre, q, q + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        more = low > best[p]
        best[p[more]], place[p[more]] = low[more], q[more]
    return best[refs:], place[refs:]


def factors(best: np.ndarray, off: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of every text: (text, begin, length) of its factors; a symbol without a match is a factor of one."""
    at, live, out = off.copy(), np.arange(len(off)), []
    end = off + lens
    while len(live := live[at[live] < end[live]]):
        size = np.maximum(1, np.minimum(best[at[live]], end[live] - at[live]))
        out.append((live, at[live], size))
        at[live] += size
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))


def match(W: int, raw, off, lens, block, off2, lens2, block2) -> np.ndarray:
    """Parses the patterns (off2, lens2) against the phrases (off, lens). True for each window inside a match.

    A factor of W symbols or more is a duplicate span. A window that begins in a factor and passes its end may match
    elsewhere: at the boundaries the longest match of each such position decides.
    """
    both = np.concatenate([raw[ranges(off, lens)], raw[ranges(off2, lens2)]])
    values, code = np.unique(both, return_inverse=True)
    blocks = np.concatenate([np.repeat(block, lens), np.repeat(block2, lens2)])
    texts = len(lens) + len(lens2)
    code = texts + blocks * len(values) + code
    all_lens = np.concatenate([lens, lens2])
    text = np.empty(len(code) + texts, np.int64)
    stop = np.cumsum(all_lens) + np.arange(texts)
    body = np.ones(len(text), bool)
    body[stop] = False
    text[stop], text[body] = np.arange(texts), code
    refs = int(lens.sum()) + len(lens)
    best, _ = longest(text, refs)
    begin = np.cumsum(lens2 + 1) - (lens2 + 1)
    of, at, size = factors(best, begin, lens2)
    hit = np.zeros(len(best) + 1, bool)
    long = size >= W
    hit[ranges(at[long], size[long] - W + 1)] = True
    edge = ranges(np.maximum(at, at + size - W + 1), np.minimum(size, W - 1))
    hit[edge[best[edge] >= W]] = True
    return hit[ranges(begin, lens2 - W + 1)]
