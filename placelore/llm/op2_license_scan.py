"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment measures them.

The templates are a small given table (not data of the corpus), so their index goes with the task. Texts never move: each is
scanned where it is read, so no key can be hot.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm.anchors import slices, texts_of
from placelore.llm.arrays import U, groups, mix, prefix, span, split_words
from placelore.llm.common import read
from placelore.llm.licenses import TEMPLATES
from placelore.shipping import ship

#: Words of a fingerprint and fingerprints of a winnowing window, at most; words off the diagonal that an alignment may stray,
#: at least: it may stray by as many as the coverage allows to be left out.
GRAM, WINDOW, BAND = 3, 2, 8
#: Least share of a template's words that must be matched.
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

_letters = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    """Lower case; ASCII characters that are neither letters nor digits become spaces. Places stay as they are."""
    return text.translate(_letters)


def winnow(sym: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint): of every window neighbouring grams the smallest, the last one on ties. Fewer grams: all of them."""
    if len(sym) < gram:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(len(sym) - gram + 1)
    g = mix(span(prefix(sym), at, at + gram))
    if len(g) <= window:
        return at, g
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    pick = np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))
    return pick, g[pick]


def intact(n: int, coverage: float) -> int:
    """The longest run of a template's n words that must be left when as many as the coverage allows are changed or missing."""
    lost = int((1 - coverage) * n + 1e-9)
    return -(-(n - lost) // (lost + 1))


class Index:
    """Templates' words, and an inverted index from fingerprint to (template, place) for each length of fingerprint.

    Fingerprint and winnowing window of a template are so short that some fingerprint lies in its longest intact run.
    """

    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW):
        self.names, self.words, self.sorted = [], [], []
        self.least: list[int] = []
        self.posts: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, (name, text) in enumerate(templates):
            *_, sym = split_words([plain(text.encode())])
            self.names.append(name)
            self.words.append(sym.tolist())
            self.sorted.append(np.sort(sym))
            self.least.append(math.ceil(coverage * len(sym) - 1e-9))
            run = intact(len(sym), coverage)
            size = min(gram, run)
            if size:
                for place, key in zip(*winnow(sym, size, min(window, run - size + 1)), strict=True):
                    self.posts[size][int(key)].append((i, int(place)))
        self.keys = {size: np.sort(np.array(list(posts), U)) for size, posts in self.posts.items()}

    def candidates(self, sym: np.ndarray) -> list[tuple[int, list[int]]]:
        """(template, diagonals) on which a text shares winnowed fingerprints with it; those with the most fingerprints first."""
        seen: dict[int, Counter] = defaultdict(Counter)
        for size, keys in self.keys.items():
            place, key = winnow(sym, size, 1)  # of the text every gram: a run of gram + window - 1 words can't be missed
            held = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            for p, k in zip(place[held].tolist(), key[held].tolist(), strict=True):
                for t, q in self.posts[size][k]:
                    seen[t][p - q] += 1
        return [(t, sorted(many, key=lambda d: (-many[d], d))) for t, many in seen.items()]

    def possible(self, t: int, part: np.ndarray) -> bool:
        """Does part hold enough of the template's words, wherever they stand?"""
        words = self.sorted[t]
        part = np.sort(part)
        at = np.minimum(np.searchsorted(part, words), len(part) - 1)
        return int((part[at] == words).sum()) >= self.least[t]


def align(template: list, words: list, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """The best local alignment near a diagonal: (score, matched words, begin, end) in words.

    A cell holds score, matches and begin; ties go to the earlier begin. Cells stray band words at most from the diagonal.
    """
    best = (0, 0, 0, 0)
    width = 2 * band + 1
    above = [(0, 0, 0)] * (width + 1)
    for i, t in enumerate(template):
        row = []
        left = (0, 0, 0)
        for c in range(width):
            j = i + diagonal - band + c
            if not 0 <= j < len(words):
                cell = (0, 0, 0)
            else:
                up, up_left = above[c + 1], above[c]
                same = t == words[j]
                s = up_left[0] + (MATCH if same else MISMATCH)
                cell = (s, up_left[1] + same, up_left[2] if up_left[0] > 0 else j)
                for near in (up, left):
                    if near[0] + GAP > cell[0]:
                        cell = (near[0] + GAP, near[1], near[2])
                if cell[0] <= 0:
                    cell = (0, 0, 0)
                elif (cell[0], -cell[2]) > (best[0], -best[2]):
                    best = (cell[0], cell[1], cell[2], j + 1)
            row.append(cell)
            left = cell
        above = [*row, (0, 0, 0)]
    return best


def matches(sym: np.ndarray, start: np.ndarray, end: np.ndarray, index: Index, band: int) -> list[tuple]:
    """(template, matched, coverage, begin, end) of a text, in bytes; of overlapping spans the best stays, of any template."""
    found = []
    for t, diagonals in index.candidates(sym):
        words = index.words[t]
        n, same = len(words), sorted(d for d in diagonals if d >= 0 and sym[d : d + len(words)].tolist() == words)
        wide = max(band, n - index.least[t])  # words left out move the rest by as many
        taken: list[tuple[int, int]] = []
        for d in same:  # nothing beats a whole copy
            if not taken or d >= taken[-1][1]:
                taken.append((d, d + n))
                found.append((-MATCH * n, d, d + n, t, n, 1.0))
        for diagonal in diagonals:
            low, high = max(0, diagonal - wide), min(len(sym), diagonal + n + wide)
            free = []
            for a, b in taken[max(0, bisect_left(taken, (low, 0)) - 1) : bisect_left(taken, (high, 0))]:
                free.append((low, a))
                low = max(low, b)
            free.append((low, high))
            while free:  # a short notice may stand several times within the band
                low, high = free.pop()
                if high - low < index.least[t] or not index.possible(t, sym[low:high]):
                    continue
                score, matched, a, b = align(words, sym[low:high].tolist(), diagonal - low, wide)
                if score:
                    if matched >= index.least[t]:
                        found.append((-score, low + a, low + b, t, matched, matched / n))
                        insort(taken, (low + a, low + b))
                    free += [(low, low + a), (low + b, high)]
    out: list[tuple] = []
    spans: list[tuple[int, int]] = []  # in order
    for _, a, b, t, matched, share in sorted(set(found)):
        at = bisect_left(spans, (a, b))
        if (at == 0 or spans[at - 1][1] <= a) and (at == len(spans) or spans[at][0] >= b):
            spans.insert(at, (a, b))
            out.append((t, matched, share, int(start[a]), int(end[b - 1]), a, b))
    return [o[:5] for o in sorted(out, key=lambda o: (o[3], o[0]))]


def scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, band: int = BAND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Finds the licence notices in every whole text.

    Returns a row for each match: doc_id, template, n_template_words, n_matched, coverage, begin and end (in characters) and
    found (the text's own words there). Words are compared in lower case without punctuation. Of overlapping matches the one
    with the highest score stays (twice its matched words less its gaps and changes), then the earlier one, then the earlier
    template; so a near relative does not take the name of the licence that is there.

    A notice whose words are changed or missing within the coverage is never passed over; one with words put in between them
    is found if a fingerprint of it (three words, two in a notice of five or less) is left whole. Templates without words
    match nothing; without templates the result is empty. Null and empty texts have no matches. Repeated rows each have their matches; a null id stays null. A notice that stands
    several times is several matches. An empty table gives an empty result. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    index = Index(templates, coverage)
    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def go(batches):
        for batch in slices(batches, 1024):
            ids, rows, of = batch.column("doc_id"), [], []
            texts = texts_of(batch, "body")
            for first, last in groups(texts):
                part = [plain(t) for t in texts[first:last]]
                _, start, end, owner, sym = split_words(part)
                begin = np.cumsum([0, *(len(t) + 1 for t in part)])
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in range(len(part)):
                    a, b = edge[i], edge[i + 1]
                    whole = texts[first + i]
                    for t, matched, share, x, y in matches(sym[a:b], start[a:b] - begin[i], end[a:b] - begin[i], index, band):
                        of.append(first + i)
                        at = len(whole[:x].decode())
                        said = whole[x:y].decode()
                        rows.append((index.names[t], len(index.words[t]), matched, share, at, at + len(said), said))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "template", "n_template_words", "n_matched", "coverage", "begin", "end", "found"])

    return kept.mapInArrow(go, f"doc_id {kind}, template string, n_template_words long, n_matched long, coverage double, begin long, end long, found string")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
