"""Quality rules as a short-circuit cascade: rules that reject the most per second of work run first."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from placelore.llm.anchors import slices, texts_of
from placelore.llm.arrays import BASE, BYTE, SEP, U, groups, mix, prefix, span, split_words
from placelore.llm.common import read
from placelore.shipping import ship

#: Rows, at most, of the sample that orders the rules, the longest of its texts in bytes, and how often each rule is timed on
#: it. The order decides the work done, never the verdict.
SAMPLE, LONGEST, TIMES = 512, 1 << 16, 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
LETTER = UPPER | _flags(bytes(range(97, 123)))
DIGIT = _flags(bytes(range(48, 58)))


def counts(texts: list[bytes], flag: np.ndarray) -> np.ndarray:
    """For each text: how many of its bytes are flagged."""
    if not texts:
        return np.zeros(0, np.int64)
    have = np.concatenate([[0], np.cumsum(flag[np.frombuffer(b"".join(texts), np.uint8)])])
    ends = np.cumsum([len(t) for t in texts])
    return have[ends] - have[np.concatenate([[0], ends[:-1]])]


def repeats(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, not the first of its group) for entries of one text with one key."""
    order = np.lexsort((key, of))
    o, k = of[order], key[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])] if len(o) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    many = np.zeros(len(o), bool)
    many[order] = np.repeat(np.diff(np.r_[first, len(o)]) > 1, np.diff(np.r_[first, len(o)]))
    later = np.zeros(len(o), bool)
    later[order] = ~new
    return many, later


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base measures of each text, over all of it."""
    n = len(texts)
    data, start, end, of, sym = split_words(texts)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    stop = np.cumsum(size)
    count = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    between = lambda have, a, b: have[np.minimum(b, len(have) - 1)] - have[a]
    begin = stop - size
    chars = between(count(((data & 0xC0) != 0x80) & ~SEP[data]), begin, stop)
    symbols = between(count(SYMBOL[data]), begin, stop)
    # 5-word windows
    many = np.zeros(len(sym), bool)
    if len(sym) >= 5:
        at = np.flatnonzero(of[4:] == of[:-4])
        again, _ = repeats(of[at], mix(span(prefix(sym), at, at + 5)))
        for i in range(5):
            many[at[again] + i] = True
    # lines: between newlines or text ends; only those with a word count
    cut = np.flatnonzero(data == 10)
    a = np.unique(np.concatenate([begin, cut + 1]))
    a = a[a < len(data)]
    ends = np.unique(np.concatenate([stop - 1, cut]))
    b = ends[np.searchsorted(ends, a)]
    worded = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[worded], b[worded]
    line_of = np.searchsorted(stop, a, side="right")
    keys = np.zeros(0, U)
    if len(a):
        keys = mix(span(prefix(BYTE[data]), a, b) + (b - a).astype(U) * U(BASE))
    _, later = repeats(line_of, keys)
    return {
        "n_words": np.bincount(of, minlength=n).astype(np.int64),
        "word_chars": chars.astype(np.int64),
        "n_symbols": symbols.astype(np.int64),
        "n_dup_lines": np.bincount(line_of[later], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(of[many], minlength=n).astype(np.int64),
    }


def stutters(texts: list[bytes]) -> np.ndarray:
    """For each text: words equal to the word before them."""
    _, _, _, of, sym = split_words(texts)
    same = (sym[1:] == sym[:-1]) & (of[1:] == of[:-1])
    return np.bincount(of[1:][same], minlength=len(texts))


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


@dataclass(frozen=True)
class Rule:
    """rejects(texts, measures) tells for each text whether the rule rejects it."""

    name: str
    rejects: Callable


RULES = (
    Rule("word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", lambda t, m: 2 * m["n_dup_lines"] > np.array([x.count(b"\n") + 1 for x in t])),
    Rule("capitals", lambda t, m: 10 * counts(t, UPPER) > 3 * counts(t, LETTER)),
    Rule("exclamations", lambda t, m: 10 * np.array([x.count(b"!") for x in t]) > m["n_words"]),
    Rule("digits", lambda t, m: 10 * counts(t, DIGIT) > 3 * m["word_chars"]),
    Rule("stutter", lambda t, m: 5 * stutters(t) > m["n_words"]),
)


def order_rules(texts: list[bytes], rules=RULES) -> list[Rule]:
    """The rule with the most rejections per second on the sample first, then the best on what that one leaves, and so on.

    Rules that reject nothing of what is left come last, the cheapest first. A rule's cost is the least of some timings.
    """
    if not texts:
        return list(rules)
    m = measure(texts)
    alive = ~base_failed(m)
    left = np.flatnonzero(alive)
    some, held = [texts[i] for i in left], {k: v[left] for k, v in m.items()}
    rated = []
    for rule in rules:
        cost = 1e9
        for _ in range(TIMES):
            began = time.perf_counter()
            bad = rule.rejects(some, held)
            cost = min(cost, time.perf_counter() - began + 1e-9)
        rated.append((rule, cost, np.asarray(bad, bool)))
    alive, out = np.ones(len(left), bool), []
    while rated:
        best = min(range(len(rated)), key=lambda i: (-int((rated[i][2] & alive).sum()) / rated[i][1], rated[i][1]))
        rule, _, bad = rated.pop(best)
        out.append(rule)
        alive &= ~bad
    return out


def verdict(texts: list[bytes], m: dict[str, np.ndarray], rules: list[Rule]) -> np.ndarray:
    """Each rule sees only what the rules before it, and the base, have left."""
    alive = np.flatnonzero(~base_failed(m))
    for rule in rules:
        if not len(alive):
            break
        bad = rule.rejects([texts[i] for i in alive], {k: v[alive] for k, v in m.items()})
        alive = alive[~bad]
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept


def quality_cascade(docs: DataFrame, rules=RULES, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """Measures every whole text and applies the rules in the order that the sample suggests.

    Returns a row for each row of docs: row (all its columns), the base measures, base_failed and kept. The verdict does not
    depend on the order of the rules. A null or empty text has no words, fails the base and is not kept. Repeated rows get
    equal results. An empty table gives an empty result. Other columns, whatever their names, pass in row.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")
    some = [r[0].encode() for r in docs.select(body).where(F.octet_length("body") <= LONGEST).limit(sample).collect()]
    ordered = order_rules(some, rules)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), body)
    names = [*MEASURES, "base_failed", "kept"]
    out = StructType([keyed.schema["row"], *(StructField(n, LongType()) for n in MEASURES), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])

    def go(batches):
        for batch in slices(batches, 2048):
            texts = texts_of(batch, "body")
            cols: dict[str, list] = {n: [] for n in names}
            for first, last in groups(texts):
                part = texts[first:last]
                m = measure(part)
                m |= {"base_failed": base_failed(m), "kept": verdict(part, m, ordered)}
                for n in names:
                    cols[n].append(m[n])
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(np.concatenate(cols[n])) for n in names)], ["row", *names])

    return keyed.mapInArrow(go, out)


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_cascade(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *MEASURES, "base_failed", "kept")


#: Counts for the verdict, and the verdict itself; ``docs`` is the table judged.
VERDICT_SQL = r"""
base AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM docs
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM base WHERE len(words) >= 5)
), again AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS l FROM base
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT l)) AS n_dup_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, body, words, len(words)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
         OR 2 * n_dup_lines > len(regexp_extract_all(body, '\n')) + 1
         OR 10 * len(regexp_extract_all(body, '[A-Z]')) > 3 * len(regexp_extract_all(body, '[A-Za-z]'))
         OR 10 * len(regexp_extract_all(body, '!')) > n_words
         OR 10 * len(regexp_extract_all(body, '[0-9]')) > 3 * word_chars
         OR 5 * len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) > n_words AS bad
  FROM m
)"""

SQL = (
    "WITH docs AS (SELECT doc_id, text FROM documents), "
    + VERDICT_SQL
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM judged
"""
)
