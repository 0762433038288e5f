"""Substring dedup: word windows that a smaller document holds, found by relative Lempel-Ziv parsing."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm import lempelziv
from placelore.llm.anchors import HOT, Windows, repeated_spans
from placelore.llm.common import read


_word = re.compile(rb"[^\x20\x09-\x0D]+")


def _finish(window: int):
    def finish(text: bytes, spans, copy: bool) -> tuple:
        words = text.split()  # of bytes: at exactly the six separators
        if copy and len(words) >= window:
            spans = np.array([[0, len(words)]])
        keep, at = [], 0
        for a, b in spans.tolist():
            keep += words[at:a]
            at = b
        keep += words[at:]
        if len(spans):  # cut from the text itself: from a span's first word to the word behind it
            place = [m.start() for m in _word.finditer(text)] + [len(text)]
            rest, at = [], 0
            for a, b in spans.tolist():
                rest.append(text[at : place[a]])
                at = place[b]
            text = b"".join([*rest, text[at:]])
        return len(words), len(words) - len(keep), spans[:, 0].tolist(), spans[:, 1].tolist(), b" ".join(keep), text

    return finish


def remove_repeated_passages(docs: DataFrame, window: int = 50, gram: int = 6, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Marks the words of each text covered by window words in a row that also start in a document with a smaller id.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. Returns a row for each row of docs: row
    (its other columns), n_words, n_removed, begins and ends (maximal spans, in words), kept (words left, joined by a space)
    and left_text (the text itself without the spans, its other white space as it was). Windows are judged on the input.

    A null text has no words. Texts under window words have no spans. Rows with one id never remove each other, be they
    equal or not; rows with a null id come after all others. An empty table gives an empty result. Other columns pass in row.
    """
    return repeated_spans(docs, Windows("words", window, gram, hot), lempelziv.match, _finish(window), "n_words long, n_removed long, begins array<long>, ends array<long>, kept string, left_text string", doc_id, text)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, len(words) AS n, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50)
), least AS (
  SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos
  FROM win JOIN least USING (h) WHERE doc_id > first_doc
), lost AS (
  SELECT doc_id, list(pos) AS gone, count(*) AS n_removed FROM gone GROUP BY doc_id
), word AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM docs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
