"""Repeated windows across documents: content-defined phrases, routed to index blocks.

A window is W consecutive symbols (bytes or words) of one document. The anchor of a window is the smallest hash among its
k-grams, so equal windows have equal anchors wherever they stand. A phrase is a run of windows with one anchor; the phrases
of a document partition its windows. Hence a window can only repeat in phrases of the same anchor:

0. Copies of a whole text are told apart from its smallest document by their fingerprints and skip the steps that follow.
1. ``scan``     one pass over the texts sends each anchor to the block it hashes to (arrays in blobs, not rows).
2. ``recur``    a block finds the anchors that more than one document row has and tells the senders.
3. ``cut``      the texts that hold such anchors are cut into phrases, as prefix-free parsing does; each distinct phrase of a
                batch goes to its block once, with the smallest document that has it. Later copies within the batch are
                spans at once. This pre-aggregation keeps a phrase that a third of all documents hold from filling one task.
4. ``mark``     a block holds a dictionary of distinct phrases; the index named by the caller finds which windows of a phrase
                occur in phrases of smaller documents.
5. ``gather``   spans meet per document and are joined to the texts.

Anchors with more than HOT document rows are cut into phrases of a single window, keyed by the window itself, so that many
different contexts of one passage never meet in one task: all of them in one index would be a task without bound. Such
windows are equal or not as a whole, so the dictionary decides them, and they travel as hashes, without their symbols. Blocks
grow in number with the input, not in size.

What travels is numbers in a fitting order, as compressed differences (``tight``). Scan, recur and cut name an anchor by its
tag: its block and 32 more bits. Two anchors of one tag only make phrases travel that recur nowhere; the tag decides no match.

Equality of phrases is decided on 128 bits of hash (64 of the anchor's k-gram, or of the window if the anchor is hot, and 64
of the whole phrase with other symbol hashes) and their length. Words are told apart by 64 bits of hash.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from placelore.llm.arrays import BYTE, BYTE2, U, groups, mix, prefix, span, split_words
from placelore.llm.common import buckets, doc_key
from placelore.shipping import ship

#: Document rows from which an anchor's phrases are cut into single windows.
HOT = 1000
#: Anchors that a task gathers before it sends them on: bounds the task's memory.
FLUSH = 2_000_000
#: Symbols, about, of the phrases that one index holds.
PART = 1 << 18
#: Symbols that are hashed at once.
BLOCK = 1 << 20
#: Bytes of phrases that a task gathers before it sends them on: bounds the task's memory. Copies within them travel once.
HELD = 16 << 20
ANCHOR, DIRECT, DOCS, PHRASE, SPAN, WINDOW = range(6)
#: Blocks of phrases for one of spans, of which there are far fewer: every block of phrases sends to every block of spans.
SPREAD = 16
#: Kept for the process: making one takes longer than a small blob.
_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
ROUTED = "key long, kind int, flush long, blob binary"


@dataclass(frozen=True)
class Windows:
    """unit: 'bytes' or 'words'; W: symbols in a window; k: symbols in an anchor; hot: see HOT."""

    unit: str
    W: int
    k: int
    hot: int = HOT

    @property
    def w(self) -> int:
        """k-grams in a window, and most windows in a phrase."""
        return self.W - self.k + 1

    def symbols(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (hashed symbols, document of each stretch, where it begins in the document, its length)."""
        for first, last in groups(texts, BLOCK):
            some = texts[first:last]
            if self.unit == "bytes":
                sym = np.frombuffer(b"".join(some), np.uint8)
                lens = np.array([len(t) for t in some], np.int64)
            else:
                _, _, _, of, sym = split_words(some)
                lens = np.bincount(of, minlength=len(some)).astype(np.int64)
            if len(sym) <= 2 * BLOCK:
                yield self.hashed(sym), np.arange(first, last), np.zeros(last - first, np.int64), lens
                continue
            for at in range(0, max(1, len(sym) - self.W + 1), BLOCK):  # one long document, in overlapping stretches
                part = sym[at : at + BLOCK + self.W - 1]
                yield self.hashed(part), np.array([first]), np.array([at]), np.array([len(part)])

    def hashed(self, sym: np.ndarray) -> np.ndarray:
        return BYTE[sym] if self.unit == "bytes" else sym

    def second(self, sym: np.ndarray) -> np.ndarray:
        """Hashes of the symbols, as far as can be independent of those of hashed()."""
        return BYTE2[sym] if self.unit == "bytes" else mix(sym ^ U(0x3C6EF372FE94F82B))

    def phrases(self, sym: np.ndarray, docs: np.ndarray, base: np.ndarray, lens: np.ndarray):
        """Anchor, first window (index into sym), number of windows and stretch of each phrase."""
        n, none = len(sym), np.zeros(0, np.int64)
        if n < self.W:
            return none.astype(U), none, none, none
        pre = prefix(sym)
        at = np.arange(n - self.k + 1)
        gram = mix(span(pre, at, at + self.k))
        low, step = gram, 1
        while 2 * step <= self.w:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        few = n - self.W + 1
        low = np.minimum(low[:few], low[self.w - step : self.w - step + few]) & ~U(1)
        end = np.cumsum(lens)
        of = np.repeat(np.arange(len(lens)), lens)[:few]
        at = np.flatnonzero(np.arange(few) + self.W <= end[of])
        if not len(at):
            return none.astype(U), none, none, none
        low = low[at]
        new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (np.diff(at) != 1)])
        size = np.diff(np.r_[new, len(at)])
        cut = -(-size // self.w)
        nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        first = np.repeat(at[new], cut) + nth * self.w
        size = np.minimum(self.w, np.repeat(size, cut) - nth * self.w)
        return np.repeat(low[new], cut), first, size, of[first]


def pack(*arrays) -> bytes:
    """Arrays, or bytes, one after another behind their sizes."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts])


def unpack(blob: bytes, many: int) -> list[bytes]:
    """The parts of a blob that pack() made."""
    at, out = 8 * many, []
    for size in np.frombuffer(blob, "<i8", many).tolist():
        out.append(blob[at : at + size])
        at += size
    return out


def tight(*arrays: np.ndarray) -> bytes:
    """Whole numbers, arrays of one length, in few bytes: differences, laid out by byte place, compressed."""
    parts = []
    for a in arrays:
        d = np.diff(a.astype(np.int64), prepend=np.int64(0))
        parts.append(((d << 1) ^ (d >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes())
    return _zip.compress(b"".join(parts))


def loose(blob: bytes, many: int) -> np.ndarray:
    """The arrays of tight(), as the rows of one of int64."""
    planes = np.frombuffer(_unzip.decompress(blob), np.uint8).reshape(many, 8, -1)
    z = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(U)[..., 0]
    return np.cumsum((z >> U(1)) ^ (U(0) - (z & U(1))), axis=1, dtype=U).view(np.int64)


def loosed(blobs: list[bytes], many: int) -> np.ndarray:
    return np.concatenate([np.zeros((many, 0), np.int64), *(loose(b, many) for b in blobs)], axis=1)


def rows(keys, kinds, flushes, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(flushes, pa.int64()), pa.array(blobs, pa.binary())], ["key", "kind", "flush", "blob"])


def routed(kind: int, flush: int, key: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch | None:
    """One row for each key that occurs, with the entries of that key."""
    if not len(key):
        return None
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    arrays = [a[order] for a in arrays]
    ends = np.r_[cut[1:], len(key)]
    return rows(key[cut], [kind] * len(cut), [flush] * len(cut), [tight(*(a[i:j] for a in arrays)) for i, j in zip(cut, ends, strict=True)])


def span_blocks(n: int) -> int:
    return max(min(n, 256), n // SPREAD)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h.astype(U) ^ U(0xA5A5A5A5A5A5A5A5)) % U(n)).astype(np.int64)


def tag_of(h: np.ndarray, n: int) -> np.ndarray:
    """An anchor's name on its way: its block, 32 bits that are independent of it, and a bit (0 here) that says it is hot."""
    m = mix(h ^ U(0xA5A5A5A5A5A5A5A5))
    return ((m % U(n)) << U(33) | (m >> U(32)) << U(1)).astype(np.int64)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def scan(win: Windows, n: int) -> Callable:
    def go(batches):
        part, count = TaskContext.get().partitionId(), 0
        held: list = []
        did, fp, size = [], [], 0

        def flush():
            nonlocal count, held, did, fp, size
            mark = (part << 24) + count
            count += 1
            h, idx = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            yield rows([mark % n], [DOCS], [mark], [tight(np.array(did, np.int64), np.array(fp, np.int64))])
            held, did, fp, size = [], [], [], 0
            if not len(h):
                return
            order = np.lexsort((idx, h))
            h, idx = h[order], idx[order]
            own = np.r_[True, (h[1:] != h[:-1]) | (idx[1:] != idx[:-1])]  # an anchor counts once for a document
            h, idx = h[own], idx[own]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size_of = np.diff(np.r_[first, len(h)])
            yield routed(ANCHOR, mark, h[first] >> 33, h[first] & ((1 << 33) - 1), idx[first], size_of)
            again = np.repeat(size_of > 1, size_of)  # known here already
            yield rows([mark % n], [DIRECT], [mark], [tight(h[again], idx[again])])

        for batch in batches:
            texts = opened(batch)
            new_did, new_fp = batch.column("did").to_pylist(), batch.column("fp").to_pylist()
            from_text = 0
            for first, last in groups(texts, 4 * BLOCK):
                for sym, docs, base, lens in win.symbols(texts[first:last]):
                    h, _, _, of = win.phrases(sym, docs, base, lens)
                    held.append((tag_of(h, n), docs[of] + len(did)))
                    size += len(h)
                did += new_did[first:last]
                fp += new_fp[first:last]
                from_text = last
                if size >= FLUSH:
                    yield from (x for x in flush() if x is not None)
            assert from_text == len(texts)
        if did:
            yield from (x for x in flush() if x is not None)

    return go


def recur(win: Windows) -> Callable:
    """In a block: each anchor that two senders have, or that one sender has in several documents, goes back."""

    def go(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kind != ANCHOR))]
        mine = table.filter(pa.array(kind == ANCHOR))
        if mine.num_rows:
            parts = [loose(b, 3) for b in mine.column("blob").to_pylist()]
            h, idx, many = np.concatenate(parts, axis=1)
            h |= mine.column("key")[0].as_py() << 33
            flush = np.repeat(mine.column("flush").to_numpy(), [p.shape[1] for p in parts])
            order = np.argsort(h, kind="stable")
            h, idx, many, flush = h[order], idx[order], many[order], flush[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            docs = np.add.reduceat(many, first, dtype=np.int64)
            size = np.diff(np.r_[first, len(h)])
            keep = np.repeat(docs > 1, size)
            h = h | np.repeat(docs > win.hot, size)  # the lowest bit says that the anchor is hot
            if keep.any():
                back = routed(ANCHOR, 0, flush[keep], h[keep], idx[keep])
                back = back.set_column(2, "flush", back.column("key"))
                out.append(pa.Table.from_batches([back]))
        return pa.concat_tables([t.select(["key", "kind", "flush", "blob"]) for t in out])

    return go


def told(table: pa.Table) -> pa.Table:
    """For a sender's documents: the recurring anchors that each has."""
    kind, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
    did, fp = loosed([b for b, k in zip(blobs, kind, strict=True) if k == DOCS], 2)
    h, idx = loosed([b for b, k in zip(blobs, kind, strict=True) if k == DIRECT], 2)
    h2, idx2 = loosed([b for b, k in zip(blobs, kind, strict=True) if k == ANCHOR], 2)
    hot = np.sort(h2[(h2 & 1) == 1] & ~1)
    if len(hot) and len(h):
        at = np.searchsorted(hot, h)
        h = h | ((at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == h))
    h, idx = np.concatenate([h, h2]), np.concatenate([idx, idx2])
    order = np.lexsort((h, idx))
    h, idx = h[order], idx[order]
    cut = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]]) if len(idx) else np.zeros(0, np.int64)
    return pa.table({"did": pa.array(did[idx[cut]], pa.int64()), "fp": pa.array(fp[idx[cut]], pa.int64()), "anchors": pa.array([tight(h[i:j]) for i, j in zip(cut, np.r_[cut[1:], len(h)], strict=True)] if len(cut) else [], pa.binary())})


def packed(batches):
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([press.compress(t) for t in texts_of(batch, "body")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "body"), z], [*(c for c in batch.schema.names if c != "body"), "z"])


def opened(batch: pa.RecordBatch) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(z) for z in batch.column("z").to_pylist()]


def slices(batches, rows_each: int = 256):
    for batch in batches:
        for i in range(0, batch.num_rows, rows_each):
            yield batch.slice(i, rows_each)
    trim()


def trim() -> None:
    """Hands freed memory back to the system, so that a worker which waits for its next task is small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ranges(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after another."""
    lens = np.asarray(lens, np.int64)
    return np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def cut(win: Windows, n: int) -> Callable:
    def go(batches):
        whole, alone, size = [], [], 0
        for batch in slices(batches):
            texts = opened(batch)
            did, fp, nth = (batch.column(c).to_numpy().astype(np.int64) for c in ("did", "fp", "nth"))
            lists = [loose(x, 1)[0] for x in batch.column("anchors").to_pylist()]
            some = [np.zeros(0, np.int64)]
            for sym, docs, base, lens in win.symbols(texts):
                h, first, many, of = win.phrases(sym, docs, base, lens)
                known, tag = np.unique(np.concatenate([lists[d] for d in docs])), tag_of(h, n)
                low = known & ~1
                at = np.minimum(np.searchsorted(low, tag), len(low) - 1)
                keep = low[at] == tag
                if not keep.any():
                    continue
                hot = (known[at] & 1).astype(bool)[keep]
                h, first, many, of = h[keep], first[keep], many[keep], of[keep]
                some.append(docs[of])
                raw = sym if win.unit == "words" else np.frombuffer(b"".join(texts[docs[0] : docs[-1] + 1]), np.uint8)[base[0] : base[0] + len(sym)]
                two, shift = prefix(win.second(raw)), base - (np.cumsum(lens) - lens)
                if hot.any():
                    at, where = ranges(first[hot], many[hot]), np.repeat(of[hot], many[hot])
                    alone.append((mix(span(prefix(sym), at, at + win.W)) & ~U(1), mix(span(two, at, at + win.W)), did[docs[where]], nth[docs[where]], at + shift[where]))
                    size += 40 * len(at)
                if hot.all():
                    continue
                h, first, many, of = h[~hot], first[~hot], many[~hot], of[~hot]
                lens_of = many + win.W - 1
                held = raw[ranges(first, lens_of)]
                whole.append((h, mix(span(two, first, first + lens_of)), many, did[docs[of]], nth[docs[of]], first + shift[of], held))
                size += 48 * len(h) + held.nbytes
            some = np.unique(np.concatenate(some))
            if len(some):  # which row an id and number stand for
                yield routed(DOCS, 0, bucket_of(did[some], span_blocks(n)), did[some], nth[some], fp[some])
            if size >= HELD:
                yield from sent(win, n, whole, alone)
                whole, alone, size = [], [], 0
        yield from sent(win, n, whole, alone)

    return go


def least_first(order: np.ndarray, did: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the given order, which sorts by same and then did: where the entries of one phrase begin, which of them each entry
    belongs to, and whether a smaller document than the entry's has it."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in same:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    head, of = np.flatnonzero(new), np.cumsum(new) - 1
    return head, of, did[order] > did[order[head]][of]


def sent(win: Windows, n: int, whole: list, alone: list) -> Iterator[pa.RecordBatch]:
    """The gathered phrases for their blocks, each distinct one with the smallest document that has it; what the others have are spans."""
    press, spans = zstandard.ZstdCompressor(level=1), []
    if whole:
        h, text, size, did, nth, start = (np.concatenate([x[i] for x in whole]) for i in range(6))
        raw, many = np.concatenate([x[6] for x in whole]), size + win.W - 1
        whole.clear()
        off = np.cumsum(many) - many
        order = np.lexsort((did, text, size, h))
        later = least_first(order, did, h, size, text)[2]
        x = order[later]  # a smaller document of these has the whole phrase
        spans.append((did[x], nth[x], start[x], start[x] + many[x]))
        x = order[~later]
        key = bucket_of(h[x], n)
        order = np.lexsort((start[x], nth[x], did[x], key))
        x, key = x[order], key[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        blobs = []
        for i, j in zip(edge, np.r_[edge[1:], len(key)], strict=True):
            e = x[i:j]
            blobs.append(pack(tight(h[e], size[e], did[e], nth[e], start[e]), press.compress(raw[ranges(off[e], many[e])].tobytes())))
        yield rows(key[edge], [PHRASE] * len(edge), [0] * len(edge), blobs)
    if alone:
        h, text, did, nth, start = (np.concatenate([x[i] for x in alone]) for i in range(5))
        alone.clear()
        order = np.lexsort((did, text, h))
        later = least_first(order, did, h, text)[2]
        x = order[later]
        spans.append((did[x], nth[x], start[x], start[x] + win.W))
        x = np.sort(order[~later])  # as they stand in the texts
        yield routed(WINDOW, 0, bucket_of(h[x], n), h[x], text[x], did[x], nth[x], start[x])
    if spans and (back := routed_spans(spans, n)) is not None:
        yield back


def merged(did, nth, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of document and place, those that touch or overlap as one."""
    order = np.lexsort((b, a, nth, did))
    did, nth, a, b = did[order], nth[order], a[order], b[order]
    if not len(a):
        return did, nth, a, b
    new = np.r_[True, (did[1:] != did[:-1]) | (nth[1:] != nth[:-1])]
    doc, big = np.cumsum(new) - 1, int(b.max()) + 1
    reach = np.maximum.accumulate(b + doc * big) - doc * big  # ends never pass from one document into the next
    first = np.flatnonzero(new | np.r_[True, a[1:] > reach[:-1]])
    return did[first], nth[first], a[first], reach[np.r_[first[1:] - 1, len(reach) - 1]]


def routed_spans(spans: list[tuple], n: int) -> pa.RecordBatch | None:
    did, nth, a, b = merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
    return routed(SPAN, 0, bucket_of(did, span_blocks(n)), did, nth, a, b - a)


def mark(win: Windows, n: int, match: Callable) -> Callable:
    """In a block: the windows of each phrase that a smaller document also has."""
    kind_of = np.uint8 if win.unit == "bytes" else U

    def go(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = [table.filter(pa.array((kind == SPAN) | (kind == DOCS)))]
        blobs = [unpack(b, 2) for b in table.filter(pa.array(kind == PHRASE)).column("blob").to_pylist()]
        h, size, did, nth, start = loosed([b for b, _ in blobs], 5)
        spans = []
        if len(h):
            press = zstandard.ZstdDecompressor()
            raw = np.frombuffer(b"".join(press.decompress(z) for _, z in blobs), kind_of)
            h, many = h.view(U), size + win.W - 1
            off = np.cumsum(many) - many
            text = mix(span(prefix(win.second(raw)), off, off + many))
            order = np.lexsort((did, text, size, h))
            head, of, later = least_first(order, did, h, size, text)
            h, size, did, nth, start, off = (x[order] for x in (h, size, did, nth, start, off))
            hit = earlier(win, match, raw, h[head], did[head], off[head], size[head])
            spans.append((did[later], nth[later], start[later], start[later] + size[later] + win.W - 1))
            at = np.cumsum(size[head]) - size[head]
            own = np.flatnonzero(~later)
            window, entry = ranges(at[of[own]], size[head][of[own]]), np.repeat(own, size[own])
            some = hit[window]
            place = start[entry[some]] + (window - at[of[entry]])[some]
            spans.append((did[entry[some]], nth[entry[some]], place, place + win.W))
        h, text, did, nth, start = loosed(table.filter(pa.array(kind == WINDOW)).column("blob").to_pylist(), 5)
        if len(h):
            order = np.lexsort((did, text, h))
            x = order[least_first(order, did, h, text)[2]]
            spans.append((did[x], nth[x], start[x], start[x] + win.W))
        if spans and (back := routed_spans(spans, n)) is not None:
            out.append(pa.Table.from_batches([back]))
        return pa.concat_tables([t.select(["key", "kind", "flush", "blob"]) for t in out])

    return go


def earlier(win: Windows, match: Callable, raw, h, did, off, size) -> np.ndarray:
    """For each window of the distinct phrases: does a phrase of a smaller document hold it?

    Phrases that ``related`` finds alone are passed over. The others are worked in parts of about PART symbols, an anchor whole.
    """
    hit = np.zeros(size.sum(), bool)
    order = np.lexsort((did, h))
    place = (np.cumsum(size) - size)[order]
    h, did, off, size = h[order], did[order], off[order], size[order]
    several = related(win, raw, h, did, off, size)
    place, h, did, off, size = (x[several] for x in (place, h, did, off, size))
    if not len(h):
        return hit
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    part = (np.cumsum(size + win.W - 1) // PART)[first]
    for i, j in pairwise([*first[np.r_[True, part[1:] != part[:-1]]].tolist(), len(h)]):
        pattern, found = streamed(win, match, raw, h[i:j], did[i:j], off[i:j], size[i:j])
        hit[ranges(place[i:j][pattern], size[i:j][pattern])[found]] = True
    return hit


def related(win: Windows, raw, h, did, off, size) -> np.ndarray:
    """The phrases that may share a window with a phrase of another document.

    A window holds its anchor's k-gram, with l symbols before it and W - k - l behind. For one of four c it so holds the gram
    with c quarters of W - k before it and 3 - c behind. A phrase none of whose four extended grams stands in another
    document's phrase of that anchor, at any place of the gram, shares no window.
    """
    q, many = (win.W - win.k) // 4, size + win.W - 1
    begin = np.cumsum(many) - many
    sym = win.hashed(raw[ranges(off, many)])
    pre = prefix(sym)
    phrase = np.repeat(np.arange(len(size)), many)[: max(0, len(sym) - win.k + 1)]
    at = np.arange(len(phrase))
    at = at[(mix(span(pre, at, at + win.k)) & ~U(1)) == h[phrase] & ~U(1)]
    at = at[at + win.k <= (begin + many)[phrase[at]]]
    phrase = phrase[at]
    out = np.zeros(len(size), bool)
    for c in range(4):
        a, b = at - c * q, at + win.k + (3 - c) * q
        real = (a >= begin[phrase]) & (b <= (begin + many)[phrase])
        of, a, b = phrase[real], a[real], b[real]
        key = mix(span(pre, a, b) ^ mix(h[of]))
        order = np.lexsort((did[of], key))
        key, of = key[order], of[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        many_of = np.diff(np.r_[new, len(key)])
        out[of[np.repeat(did[of[new]] < did[of[new + many_of - 1]], many_of)]] = True
    return out


def streamed(win: Windows, match: Callable, raw, h, did, off, size) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, for each of their windows: is it found?). A phrase may come several times.

    The phrases of an anchor are ranked by document. In round j those with bit j of the rank set are streamed over an index
    of their siblings with bit j clear and the same higher bits: every smaller rank is met in exactly one round. All rounds
    share one index; a block of it belongs to one round and one value of the higher bits. Phrases of different anchors share
    blocks: a window has one anchor wherever it stands, so they hold no window in common.
    """
    group_new = np.r_[True, h[1:] != h[:-1]]
    doc_new = group_new | np.r_[True, did[1:] != did[:-1]]
    group = np.cumsum(group_new) - 1
    nth = np.cumsum(doc_new) - 1
    rank = nth - nth[np.flatnonzero(group_new)][group]
    top = np.maximum.reduceat(rank, np.flatnonzero(group_new))[group]
    many = size + win.W - 1
    none = np.zeros(0, np.int64)
    index, pattern, index_block, pattern_block = [none], [none], [none], [none]
    j = blocks = 0
    while (top >> j).any():
        part = (top >> j) > 0
        sibling = ((rank >> j) | 1) << j <= top
        block = blocks + (rank >> (j + 1))
        blocks = int(block.max()) + 1
        low = np.flatnonzero(part & ((rank >> j) & 1 == 0) & sibling)
        high = np.flatnonzero(part & ((rank >> j) & 1 == 1))
        for out, x in ((index, low), (index_block, block[low]), (pattern, high), (pattern_block, block[high])):
            out.append(x)
        j += 1
    index, index_block, pattern, pattern_block = map(np.concatenate, (index, index_block, pattern, pattern_block))
    if not len(pattern):
        return pattern, np.zeros(0, bool)
    return pattern, match(win.W, raw, off[index], many[index], index_block, off[pattern], many[pattern], pattern_block)


def gather(table: pa.Table) -> pa.Table:
    """For each document its merged spans, as pairs of int64."""
    kind, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
    did, nth, a, many = loosed([b for b, k in zip(blobs, kind, strict=True) if k == SPAN], 4)
    did, nth, a, b = merged(did, nth, a, a + many)
    head = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (nth[1:] != nth[:-1])][: len(did)])
    pairs = np.stack([a, b], 1)
    found = [pairs[i:j].tobytes() for i, j in zip(head, np.r_[head[1:], len(did)], strict=True)] if len(head) else []
    did, nth = did[head], nth[head]
    id_, no, fp = loosed([b for b, k in zip(blobs, kind, strict=True) if k == DOCS], 3)
    order = np.lexsort((np.repeat([0, 1], [len(id_), len(did)]), np.r_[no, nth], np.r_[id_, did]))  # a row before its spans
    row = np.maximum.accumulate(np.where(order < len(id_), np.arange(len(order)), 0))
    mine = order >= len(id_)
    return pa.table({"did": pa.array(did, pa.int64()), "fp": pa.array(fp[order[row[mine]]], pa.int64()), "found": pa.array(found, pa.binary())})


def repeated_spans(docs: DataFrame, win: Windows, match: Callable, finish: Callable, result: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Applies finish(text bytes, spans, copy) to every row of docs; spans: its merged [begin, end) that repeat smaller documents.

    copy: a smaller document has the very same text (by 128 bits of hash), so all of its windows repeat; it has no spans here.

    result: the DDL of what finish returns, as a tuple. The rows keep all columns of docs, in a struct named row.
    """
    ship(docs.sparkSession)
    n = buckets(docs, 2 << 20, 256)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), *doc_key(doc_id, text))
    z = keyed.mapInArrow(packed, StructType([*keyed.schema.fields[:3], StructField("z", BinaryType())]))
    same = keyed.select("did", "fp", F.xxhash64(F.lit(1), "body").alias("fq")).distinct()
    least = same.groupBy("fp", "fq").agg(F.min("did").alias("least"))
    copies = same.join(least, ["fp", "fq"]).groupBy("did", "fp").agg(F.min(F.col("did") > F.col("least")).alias("copy"))
    # a small number tells rows of one id apart on their way; it is nearly always the same, so it costs nothing
    copies = copies.withColumn("nth", F.row_number().over(Window.partitionBy("did").orderBy("fp")).cast("long"))
    z = z.join(copies, ["did", "fp"])
    ordered = z.where("NOT copy").sortWithinPartitions("did", "fp")  # places in a flush are the same if a lost task runs again
    sent = ordered.mapInArrow(scan(win, n), ROUTED)
    back = sent.groupBy("key").applyInArrow(recur(win), ROUTED)
    anchors = back.groupBy("flush").applyInArrow(told, "did long, fp long, anchors binary").groupBy("did", "fp").agg(F.first("anchors").alias("anchors"))
    held = z.where("NOT copy").join(anchors, ["did", "fp"])  # all columns of z, so that one exchange of the texts serves all
    phrases = held.mapInArrow(cut(win, n), ROUTED)
    marks = phrases.groupBy("key").applyInArrow(mark(win, n, match), ROUTED)
    spans = marks.groupBy("key").applyInArrow(gather, "did long, fp long, found binary")

    def end(batches):
        for batch in slices(batches):
            found = [np.frombuffer(x or b"", np.int64).reshape(-1, 2) for x in batch.column("found").to_pylist()]
            rest = [finish(t, s, c) for t, s, c in zip(opened(batch), found, batch.column("copy").to_pylist(), strict=True)]
            cols = [pa.array([r[i] for r in rest]) for i in range(len(rest[0]))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(c.cast(k) for c, k in zip(cols, kinds, strict=True))], ["row", *names])

    made = StructType.fromDDL(result)
    names, kinds = made.names, to_arrow_schema(made).types
    out = StructType([keyed.schema["row"], *made.fields])
    return z.join(spans, ["did", "fp"], "left").mapInArrow(end, out)
