"""Best-fit packing with exact-complement hashing.

Documents become pieces of at most ``room`` tokens. Only the histogram of piece lengths (``room`` numbers, whatever the
corpus) reaches the driver. There, gaps are closed exactly: an index of single lengths, pair sums and triple sums names
combinations that fill what a piece leaves free, and they are consumed as often as their counts allow: single complements of
all lengths, then pairs, then triples. Best fit places the rest. Where fewer kinds of complements need fewer sequences, that
plan is taken. The plan is a short list of patterns with counts; every piece finds its place from its rank among pieces of
its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelore.llm.anchors import slices, texts_of
from placelore.llm.arrays import SEP
from placelore.llm.common import read, table
from placelore.shipping import ship

ROOM, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: A run of bytes without white space beyond this goes to the library whose merging stays fast on long runs.
LONG_RUN = 2000
#: Pieces, about, of one length that are ranked in one task.
RANKED = 1 << 16


@lru_cache(maxsize=2)
def encoders(name: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def long_run(text: bytes) -> bool:
    if len(text) <= LONG_RUN:
        return False
    gaps = np.flatnonzero(SEP[np.frombuffer(text, np.uint8)])
    return bool(np.diff(np.r_[-1, gaps, len(text)]).max() > LONG_RUN)


def token_ids(text: bytes, name: str = VOCABULARY) -> np.ndarray:
    """The ids that the tokenizers library gives for the .json vocabulary: the same merges from the .tiktoken ranks.

    The special string inside a text is its one id, as that library takes it by default.
    """
    fast, full = encoders(name)
    if long_run(text):
        return np.array(full.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
    return np.frombuffer(fast._core_bpe.encode_to_tiktoken_buffer(text.decode(), {SPECIAL}), np.uint32)


def cut(n: int, room: int) -> np.ndarray:
    """Lengths of the pieces of n tokens: full ones, and before them what is over."""
    return np.array([n % room] * (n % room > 0) + [room] * (n // room), np.int64)


class SumIndex:
    """The sums of one, two and three lengths, for the lengths that occur; left: how many pieces of each length there are.

    A pair stands under its sum, most even pairs first; a triple's sum is a length and the sum of a pair no longer than it.
    """

    def __init__(self, left: np.ndarray):
        lengths = np.flatnonzero(left)
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        fits = np.flatnonzero((a >= b) & (a + b < len(left)))
        fits = fits[np.lexsort((a[fits], a[fits] + b[fits]))]
        self.left, self.big, self.small = left, a[fits], b[fits]
        self.begin = np.searchsorted(self.big + self.small, np.arange(len(left) + 1))

    def singles(self, total: int, most: int):
        """Lengths no longer than most that are the sum themselves."""
        if total <= most and self.left[total]:
            yield (total,)

    def pairs(self, total: int, most: int):
        i, j = self.begin[total], self.begin[total + 1]
        j = i + np.searchsorted(self.big[i:j], most, side="right")
        some = np.flatnonzero((self.left[self.big[i:j]] > 0) & (self.left[self.small[i:j]] > 0)) + i
        yield from zip(self.big[some].tolist(), self.small[some].tolist(), strict=True)

    def triples(self, total: int, most: int):
        least = -(-total // 3)
        for a in (np.flatnonzero(self.left[least : max(least, min(most, total - 2) + 1)]) + least).tolist():
            for pair in self.pairs(total - a, a):
                yield (a, *pair)


class Plan:
    """Patterns of lengths with counts, for count[length] pieces of each length.

    sums: exact complements of so many lengths are consumed before best fit, at most.
    """

    def __init__(self, count: np.ndarray, room: int = ROOM, sums: int = 3):
        self.room, self.left = room, count.astype(np.int64).copy()
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._take([room])
        index = SumIndex(self.left)
        for combinations in (index.singles, index.pairs, index.triples)[:sums]:
            self._exact(combinations)
        self._best_fit()

    @classmethod
    def best(cls, count: np.ndarray, room: int = ROOM) -> Plan:
        """The fewest sequences of four plans: complements up to triples, up to pairs, single ones, and best fit alone.

        Pairs and triples close some gaps exactly, but take short pieces that others need. Ties go to more complements.
        """
        return min((cls(count, room, sums) for sums in (3, 2, 1, 0)), key=lambda p: p.sequences)

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)

    def _take(self, lengths: list[int]) -> None:
        """Consumes the combination as often as the counts allow."""
        need = Counter(lengths)
        times = min(int(self.left[size]) // n for size, n in need.items())
        if times:
            for size, n in need.items():
                self.left[size] -= times * n
            self.patterns.append((tuple(lengths), times))

    def _exact(self, combinations: Callable) -> None:
        """Closes the gaps beside the longest pieces first, with pieces no longer than those."""
        for big in range(self.room - 1, 0, -1):
            if self.left[big]:
                for some in combinations(self.room - big, big):
                    self._take([big, *some])
                    if not self.left[big]:
                        break

    def _best_fit(self) -> None:
        """The rest, longest first, each into the fullest sequences that still hold it."""
        open_: dict[int, list[list]] = {}
        for size in range(self.room, 0, -1):
            n = int(self.left[size])
            while n:
                gap = next((g for g in range(size, self.room + 1) if open_.get(g)), None)
                if gap is None:  # new sequences, each with as many of this length as it holds
                    each = min(n, self.room // size)
                    times = n // each
                    open_.setdefault(self.room - each * size, []).append([(size,) * each, times])
                    n -= each * times
                    continue
                held = open_[gap].pop()
                each = min(n, gap // size)
                times = min(held[1], n // each)
                if held[1] > times:
                    open_[gap].append([held[0], held[1] - times])
                open_.setdefault(gap - each * size, []).append([held[0] + (size,) * each, times])
                n -= each * times
            self.left[size] = 0
        self.patterns += [(tuple(p), t) for some in open_.values() for p, t in some]

    def slots(self) -> dict[str, np.ndarray]:
        """For each length, in order: from which rank a slot takes pieces, the first sequence of the slot, the offset there."""
        rows, base = [], 0
        for lengths, times in self.patterns:
            at = 0
            for size in lengths:
                rows.append((size, times, base, at))
                at += size
            base += times
        size, times, first, at = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([],) * 4))
        order = np.argsort(size, kind="stable")
        size, times, first, at = size[order], times[order], first[order], at[order]
        total = np.cumsum(times) - times
        new = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]) if len(size) else np.zeros(0, np.int64)
        start = total - np.repeat(total[new], np.diff(np.r_[new, len(size)])) if len(size) else total
        return {"size": size, "start": start, "first": first, "at": at}


def pieces_of(docs: DataFrame, room: int, end: int, vocabulary: str, doc_id: str, text: str) -> DataFrame:
    def go(batches):
        for batch in slices(batches, 1024):
            ids = batch.column(0)
            of, nth, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts_of(batch, "body")):
                tokens = np.append(token_ids(t, vocabulary), np.uint32(end)).astype("<u4")
                at = 0
                for k, size in enumerate(cut(len(tokens), room).tolist()):
                    of.append(i)
                    nth.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(tokens[at : at + size].tobytes()))
                    at += size
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(go, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, room: int = ROOM, end: int = END, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most room tokens: a row for each piece, with its place.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Offsets of a sequence are gapless from 0.

    A null or empty text is the end id alone. Rows with one id, or none, each have pieces of their own. An empty table gives
    an empty result. Other columns are not looked at. Pieces are tokenised once, written to the shared scratch folder, and
    ranked among those of their length in salted groups, so that no length fills one task.
    """
    ship(docs.sparkSession)
    pieces = table(pieces_of(docs, room, end, vocabulary, doc_id, text), "pieces")
    counts = np.zeros(room + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most room rows
        counts[r["length"]] = r["count"]
    slots = Plan.best(counts, room).slots()
    salts = max(1, -(-int(counts.sum()) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside) - 1).join(base, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("base")).select("doc_id", "piece", "start", "length", "ids_crc32", "nth")
    big = int(counts.max(initial=0)) + 1
    key = slots["size"] * big + slots["start"]

    def place(batches):
        for batch in batches:
            size, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            at = np.searchsorted(key, size * big + nth, side="right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(slots["first"][at] + nth - slots["start"][at]), pa.array(slots["at"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
