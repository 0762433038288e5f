"""Suffix-array dedup: byte windows that a smaller document holds, found with a run-length compressed index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm import runindex
from placelore.llm.anchors import HOT, Windows, repeated_spans
from placelore.llm.common import read


def _finish(window: int):
    def finish(text: bytes, spans, copy: bool) -> tuple:
        if copy and len(text) >= window:
            spans = np.array([[0, len(text)]])
        keep, at = [], 0
        for a, b in spans.tolist():
            keep.append(text[at:a])
            at = b
        keep.append(text[at:])
        return len(text), spans[:, 0].tolist(), spans[:, 1].tolist(), b"".join(keep)

    return finish


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 18, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Marks the bytes of each text covered by a window-byte string that also starts in a document with a smaller id.

    Returns a row for each row of docs: row (its other columns), n_bytes, begins and ends (maximal spans, in bytes), kept
    (the bytes left). Strings are judged on the input; matches never cross documents; overlaps count.

    A null text is empty. Texts under window bytes have no spans. Rows with one id never remove each other, be they equal
    or not; rows with a null id come after all others. An empty table gives an empty result. Other columns pass in row.
    """
    return repeated_spans(docs, Windows("bytes", window, gram, hot), runindex.match, _finish(window), "n_bytes long, begins array<long>, ends array<long>, kept binary", doc_id, text)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
