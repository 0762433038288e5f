"""Shared plumbing of the corpus operators: inputs, scratch tables, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.scratch import scratch_dir, table
from placelore.shipping import ship

__all__ = ["NO_ID", "buckets", "doc_key", "fresh", "input_bytes", "read", "scratch_dir", "table"]

#: Stands for a null doc_id where documents are ordered: it comes after every real id.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes behind df: file sizes for scans. Sizes plans; never changes results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, bytes_each: int, least: int) -> int:
    """How many hash buckets hold about bytes_each of df's input; grows with the input without a cap."""
    size = input_bytes(df)
    return max(least, -(-size // bytes_each))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, made from names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def doc_key(doc_id="doc_id", text="text") -> list:
    """(did, fp, body): the order of a document, a fingerprint that tells rows of one id apart, its text or ''."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(body).alias("fp"),
        body.alias("body"),
    ]
