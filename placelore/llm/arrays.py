"""Vectorised word splitting and rolling hashes on numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_pow = _inv = np.zeros(0, U)

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SEP = np.zeros(256, bool)
SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
BYTE2 = mix(BYTE ^ U(0x3C6EF372FE94F82B))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    global _pow, _inv
    if len(_pow) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        grown = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(1, U)
            while len(out) < size:
                out = np.concatenate([out, out * U(pow(b, len(out), 1 << 64))])
            grown.append(out)
        _pow, _inv = grown
    return _pow, _inv


def prefix(sym: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any range. sym: mixed 64-bit symbols."""
    up, _ = _powers(len(sym))
    out = np.zeros(len(sym) + 1, U)
    np.cumsum(sym * up[: len(sym)], out=out[1:])
    return out


def span(pre: np.ndarray, start, end) -> np.ndarray:
    """A hash of the symbols in [start, end) that does not depend on where they stand."""
    _, down = _powers(len(pre))
    return (pre[end] - pre[start]) * down[start]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that do not separate words."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = ~SEP[data]
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of data."""
    if not len(starts):
        return np.zeros(0, U)
    pre = prefix(BYTE[data])
    return mix(span(pre, starts, ends) + (ends - starts).astype(U) * U(BASE))


def pieces(data: np.ndarray, size: int = 1 << 20):
    """(begin, end) of pieces of about size bytes which end where a word ends."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data):
            stop = np.flatnonzero(SEP[data[end : end + size]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + size, len(data))
        yield at, end
        at = end


def groups(texts: list[bytes], size: int = 1 << 20):
    """(first, last) index ranges of texts of about size bytes together."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, starts, ends, the word's text (index) and the word's hash, for the words of all texts.

    data is the texts joined by a space. Memory stays in proportion to the bytes of the texts.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends, hashes = [], [], []
    for a, b in pieces(data):
        s, e = words_of(data[a:b])
        hashes.append(word_hashes(data[a:b], s, e))
        starts.append(s + a)
        ends.append(e + a)
    none = np.zeros(0, np.int64)
    s, e = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    stop = np.cumsum([len(t) + 1 for t in texts]) if texts else none
    return data, s, e, np.searchsorted(stop, s, side="right"), np.concatenate([np.zeros(0, U), *hashes])
