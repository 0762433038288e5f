"""Token counts by prefix dynamic programming: the exact number of tokens of every prefix of a text.

In byte-pair encoding a sequence of tokens is the encoding of its text exactly if each two neighbours are the encoding of
their own text. So the encoding of a prefix ends in the one token t that ends there and stands well beside the last token of
the prefix before t; last token and count of every prefix follow from shorter prefixes. An Aho-Corasick automaton over the
vocabulary names the longest token that ends at a place, and from each token the next shorter one.

No piece of the vocabulary has a space mark behind another character, so the encoding never crosses from a word into the
space before the next. Each distinct chunk (spaces and the word behind them) is worked once for a batch, all chunks side by
side; counts add up along the text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from placelore.llm.anchors import slices, texts_of
from placelore.llm.arrays import BASE, BYTE, U, groups, mix, prefix, span
from placelore.llm.common import read
from placelore.shipping import ship

MODEL = "piece_bpe_32k.model"
#: The tokenizer's limit that over_limit asks about.
LIMIT = 4096
SPACE, MARK, BREAK = b" ", "▁".encode(), b"\xff"
NONE, ROOT, BARRIER = -1, -2, -3
#: Chunks longer than this are worked one by one.
LONG = 512
#: Pairs of tokens that a worker remembers, at nine bytes each.
KNOWN = 1 << 22
#: Prefixes in a row of prefix_counts.
BLOCK = 1 << 16


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Counter:
    """Counts the tokens of every prefix under a sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback, and must normalise only by marking spaces")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        spec.add_dummy_prefix = False  # pairs of tokens are encoded as they stand
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = {i: p.piece.encode().replace(MARK, SPACE) for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in pieces.values()):
            raise ValueError("a piece has a space inside")
        self.pieces = pieces
        self.size = np.zeros(len(proto.pieces), np.int64)
        for i, p in pieces.items():
            self.size[i] = len(p)
        self._automaton()
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        #: ASCII characters that are no piece of their own never join others; a chunk ends before and behind them.
        single = {p for p in pieces.values() if len(p) == 1}
        self.lone = np.array([bytes([b]) not in single and b < 128 for b in range(256)])

    def _automaton(self) -> None:
        """goto[state, byte class]; longest[state]: the longest token that ends here; shorter[token]: the next one."""
        used = sorted({b for p in self.pieces.values() for b in p})
        self.byte_class = np.zeros(256, np.int64)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        child: dict[tuple[int, int], int] = {}
        token, depth = [NONE], [0]
        parents, classes = [0], [0]
        for i, p in self.pieces.items():
            at = 0
            for b in p:
                key = (at, int(self.byte_class[b]))
                if key not in child:
                    child[key] = len(token)
                    token.append(NONE)
                    depth.append(depth[at] + 1)
                    parents.append(at)
                    classes.append(key[1])
                at = child[key]
            token[at] = i
        n = len(token)
        token, depth, parents, classes = map(np.array, (token, depth, parents, classes))
        goto = np.zeros((n, width), np.int32)
        fail = np.zeros(n, np.int64)
        longest = token.copy()
        shorter = np.full(len(self.size), NONE)
        for level in range(depth.max() + 1):
            rows = np.flatnonzero(depth == level)
            if level:
                up, c = parents[rows], classes[rows]
                fail[rows] = np.where(up == 0, 0, goto[fail[up], c])
                goto[rows] = goto[fail[rows]]
                own = token[rows] >= 0
                shorter[token[rows[own]]] = longest[fail[rows[own]]]
                longest[rows[~own]] = longest[fail[rows[~own]]]
            kids = np.flatnonzero(depth == level + 1)
            goto[parents[kids], classes[kids]] = kids
        self.goto, self.longest, self.shorter = goto, longest, shorter

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is the encoding of a's and b's joint text just (a, b)? Asked of the library once for a pair."""
        key = a * len(self.size) + b
        at = np.minimum(np.searchsorted(self.known, key), max(0, len(self.known) - 1))
        new = np.unique(key[self.known[at] != key]) if len(self.known) else np.unique(key)
        if len(new):
            texts = [(self.pieces[k // len(self.size)] + self.pieces[k % len(self.size)]).decode() for k in new.tolist()]
            fits = np.array([x == [k // len(self.size), k % len(self.size)] for x, k in zip(self.plain.encode(texts, num_threads=1), new.tolist(), strict=True)])
            if len(self.known) > KNOWN:  # a cache only: it starts anew
                self.known, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.beside(a, b)
            place = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, place, new), np.insert(self.fits, place, fits)
            at = np.searchsorted(self.known, key)
        return self.fits[at]

    def table(self, data: np.ndarray, off: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Counts after 0, 1, ... bytes of each chunk; -1 inside a character. Chunks run along the rows."""
        most, n = int(lens.max()), len(off)
        last = np.full((most + 1, n), NONE, np.int32)
        count = np.full((most + 1, n), -1, np.int32)
        last[0], count[0] = ROOT, 0
        state = np.zeros(n, np.int64)
        every = np.arange(n)
        for i in range(1, most + 1):
            live = every if lens.min() >= i else np.flatnonzero(lens >= i)
            byte = data[off[live] + i - 1]
            state[live] = s = self.goto[state[live], self.byte_class[byte]]
            token = self.longest[s]
            unknown = token == NONE
            open_, token = live[~unknown], token[~unknown]
            while len(open_):
                start = i - self.size[token]
                before = last[start, open_]
                good = (before == ROOT) | (before == BARRIER)
                ask = np.flatnonzero(before >= 0)
                if len(ask):
                    good[ask] = self.beside(before[ask].astype(np.int64), token[ask])
                last[i, open_[good]] = token[good]
                count[i, open_[good]] = count[start[good], open_[good]] + 1
                open_, token = open_[~good], self.shorter[token[~good]]
                more = token != NONE
                open_, token = open_[more], token[more]
            # a character without a piece is spelled in bytes and joins nothing
            odd = live[unknown]
            odd = odd[(lens[odd] == i) | ((data[np.minimum(off[odd] + i, len(data) - 1)] & 0xC0) != 0x80)]
            if len(odd):
                start = np.full(len(odd), i - 1)
                while (inner := (data[off[odd] + start] & 0xC0) == 0x80).any():
                    start[inner] -= 1
                last[i, odd] = BARRIER
                count[i, odd] = count[start, odd] + (i - start)
        return count

    def long(self, chunk: bytes) -> list[int]:
        """The same for one long chunk."""
        last, count, state = [ROOT], [0], 0
        goto, classes, longest, shorter, size = self.goto, self.byte_class, self.longest, self.shorter, self.size
        pair: dict = {}
        for i, b in enumerate(chunk, 1):
            state = goto[state, classes[b]]
            token = int(longest[state])
            here = (NONE, -1)
            if token == NONE and (i == len(chunk) or chunk[i] & 0xC0 != 0x80):
                start = i - 1
                while chunk[start] & 0xC0 == 0x80:
                    start -= 1
                here = (BARRIER, count[start] + i - start)
            while token != NONE:
                start = i - int(size[token])
                before = last[start]
                if before != NONE:
                    fit = before < 0 or pair.get((before, token))
                    if fit is None:
                        fit = pair[before, token] = bool(self.beside(np.array([before]), np.array([token]))[0])
                    if fit:
                        here = (token, count[start] + 1)
                        break
                token = int(shorter[token])
            last.append(here[0])
            count.append(here[1])
        return count

    def chunks(self, texts: list[bytes]):
        """data with a break before each text; begin, end and text of each chunk."""
        data = np.frombuffer(b"".join(BREAK + (SPACE + t.replace(MARK, SPACE) if t else b"") for t in texts), np.uint8)
        gap, stop, lone = data == 32, data == 255, self.lone[data]
        before = np.r_[True, stop[:-1]]
        new = before | (gap & ~np.r_[False, gap[:-1]]) | lone | np.r_[True, lone[:-1]]
        begin = np.flatnonzero(new & ~stop)
        edges = np.flatnonzero(new | stop)
        end = np.r_[edges, len(data)][np.searchsorted(edges, begin, side="right")]
        return data, begin, end, np.cumsum(stop)[begin] - 1

    def tables(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat, at): the prefix counts of chunk c, after 0, 1, ... bytes, are flat[at[c] : at[c + 1]]."""
        lens = end - begin
        at = np.r_[0, np.cumsum(lens + 1)]
        flat = np.empty(at[-1], np.int32)
        big = np.flatnonzero(lens > LONG)
        for c in big:
            flat[at[c] : at[c + 1]] = self.long(data[begin[c] : end[c]].tobytes())
        order = np.argsort(lens, kind="stable")[: len(lens) - len(big)]
        done = 0
        while done < len(order):
            few = max(1, min(1 << 16, (1 << 21) // max(1, int(lens[order[min(len(order) - 1, done + (1 << 14))]]))))
            some = order[done : done + few]
            done += few
            count = self.table(data, begin[some], lens[some])
            for i in range(len(count)):
                live = some[lens[some] >= i]
                flat[at[live] + i] = count[i, len(some) - len(live) :]
        return flat, at

    def prefixes(self, texts: list[bytes]) -> Prefixes:
        """The exact count at every prefix of each text: the counts of a distinct chunk are worked and kept once."""
        data, begin, end, of = self.chunks(texts)
        if not len(begin):
            none = np.zeros(0, np.int64)
            return Prefixes(texts, none, none, none, none, none, np.zeros(len(texts) + 1, np.int64))
        key = mix(span(prefix(BYTE[data]), begin, end) + (end - begin).astype(U) * U(BASE))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        flat, at = self.tables(data, begin[first], end[first])
        own = np.searchsorted(of, np.arange(len(texts) + 1))
        return Prefixes(texts, flat, at[same], (end - begin).astype(np.int64), flat[at[1:] - 1].astype(np.int64)[same], begin, own)

    def count(self, texts: list[bytes], limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and the bytes of its longest prefix of at most limit tokens."""
        p = self.prefixes(texts)
        total, fit = p.totals(), np.array([len(t) for t in texts], np.int64)
        for t in np.flatnonzero(total > limit) if limit is not None else ():
            fit[t] = p.fit(t, limit)
        return total, fit


class Prefixes:
    """Prefix counts of some texts. Chunk c has lens[c] bytes from begin[c], total[c] tokens and its counts at flat[at[c]:]; text t has the chunks own[t] to own[t + 1]."""

    def __init__(self, texts, flat, at, lens, total, begin, own):
        self.texts, self.flat, self.at, self.lens, self.total, self.begin, self.own = texts, flat, at, lens, total, begin, own

    def totals(self) -> np.ndarray:
        have = np.r_[0, np.cumsum(self.total)].astype(np.int64)
        return have[self.own[1:]] - have[self.own[:-1]]

    def fit(self, t: int, limit: int) -> int:
        """Bytes of text t's longest prefix of at most limit tokens, where the whole text has more."""
        a, b = self.own[t], self.own[t + 1]
        have = np.cumsum(self.total[a:b])
        c = int(np.searchsorted(have, limit, side="right"))
        held, at = int(have[c - 1]) if c else 0, self.at[a + c]
        inner = self.flat[at : at + self.lens[a + c] + 1]
        fits = np.flatnonzero((inner >= 0) & (inner + held <= limit))
        marked = int(self.begin[a + c] - self.begin[a] + (fits[-1] if len(fits) else 0))  # in bytes of the marked text
        return int(np.flatnonzero(self._whole(t))[max(0, marked - 1)])

    def _whole(self, t: int) -> np.ndarray:
        """Which prefixes of text t, by bytes, do not end in a literal mark: it has three bytes there and one in the marked text."""
        text = self.texts[t]
        whole = np.ones(len(text) + 1, bool)
        at = text.find(MARK)
        while at >= 0:
            whole[at + 1 : at + len(MARK)] = False
            at = text.find(MARK, at + len(MARK))
        return whole

    def counts(self, t: int) -> np.ndarray:
        """Tokens of text t's prefixes of 0, 1, ... bytes; -1 inside a character."""
        a, b = self.own[t], self.own[t + 1]
        out = np.full(len(self.texts[t]) + 1, -1, np.int32)
        if a < b:
            lens = self.lens[a:b]
            ends = np.cumsum(lens)
            inner = self.flat[np.arange(ends[-1]) + np.repeat(self.at[a:b] + 1 - (ends - lens), lens)]
            held = np.repeat(np.cumsum(self.total[a:b]) - self.total[a:b], lens)
            out[self._whole(t)] = np.where(inner >= 0, inner + held, -1)
        out[0] = 0  # the added space alone is no prefix
        return out


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None, text: str = "text") -> DataFrame:
    """Counts the tokens of every whole text as the sentencepiece library gives them for the model.

    Returns a row for each row of docs: row (its other columns), n_bytes, n_tokens, over_limit (n_tokens > limit) and
    fit_bytes (length of the longest prefix of at most limit tokens, from the prefix counts).

    A null text is empty; an empty text has no tokens. Repeated rows get equal results. An empty table gives an empty
    result. Other columns pass in row. model: a path that every executor can read; by default the public vocabulary file.
    """
    ship(docs.sparkSession)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    out = StructType([keyed.schema["row"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()), StructField("fit_bytes", LongType())])

    def go(batches):
        c = counter(model or default_model())
        for batch in slices(batches, 4096):
            texts = texts_of(batch, "body")
            got = [c.count(texts[i:j], limit) for i, j in groups(texts, 1 << 23)]
            n, fit = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit), pa.array(fit)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], out.names)

    return keyed.mapInArrow(go, out)


def prefix_counts(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """The exact token count of every prefix of every text, to be stored: budgets and truncations are answered from it.

    Returns rows row (the other columns of docs), start and counts: counts[i] is the number of tokens of the text's first
    start + i bytes, null where that ends inside a character. A row holds at most BLOCK prefixes, so none grows with its text.
    A null or empty text has the one prefix of 0 bytes and 0 tokens. Repeated rows have repeated blocks. An empty table has
    none. Other columns pass in row.
    """
    ship(docs.sparkSession)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    out = StructType([keyed.schema["row"], StructField("start", LongType()), StructField("counts", ArrayType(IntegerType()))])

    def go(batches):
        c = counter(model or default_model())
        for batch in slices(batches, 4096):
            texts = texts_of(batch, "body")
            for i, j in groups(texts, 1 << 20):
                p = c.prefixes(texts[i:j])
                each = [(i + t, at, n[at : at + BLOCK]) for t, n in enumerate(map(p.counts, range(j - i))) for at in range(0, len(n), BLOCK)]
                of, start, some = zip(*each, strict=True)
                flat = np.concatenate(some)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(flat, pa.int32(), mask=flat < 0))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(of)), pa.array(start, pa.int64()), lists], out.names)

    return keyed.mapInArrow(go, out)


def within(counted: DataFrame, key, budgets: list[int]) -> DataFrame:
    """counted: prefix_counts. For each key and budget, the bytes of the longest prefix of at most so many tokens, and its tokens.

    key: a column that tells the texts of counted apart, a null key being one. Nothing is encoded anew. Budgets below 0 have no row.
    """
    prefixes = F.transform("counts", lambda n, i: F.struct((F.col("start") + i).alias("fit_bytes"), n.alias("n_tokens")))

    def longest(budget: int):
        return F.try_element_at(F.filter(prefixes, lambda p: p["n_tokens"] <= budget), F.lit(-1))

    best = [F.struct(F.lit(b).cast("long").alias("budget"), longest(b).alias("p")) for b in budgets]
    some = counted.select(key.alias("key"), F.inline(F.array(*best))).where("p IS NOT NULL")
    return some.groupBy("key", "budget").agg(F.max("p").alias("p")).select("key", "budget", "p.fit_bytes", "p.n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit", "fit_bytes")
