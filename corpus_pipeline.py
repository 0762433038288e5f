"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of documents. Between stages rows are written as Parquet to the shared scratch folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm.common import fresh, read, table
from placelore.llm.op4_best_fit_packing import pack
from placelore.llm.op5_ngram_jaccard import classes, node_id
from placelore.llm.op8_quality_cascade import quality_cascade
from placelore.llm.op9_substring_dedup import remove_repeated_passages
from placelore.llm.op10_temperature_mixing import mix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null, empty and blank texts among them.

    Rows are judged one by one: repeated rows share a fate, null ids stay null. An empty table stays empty. Other columns,
    whatever their names, stay as they are.
    """
    return quality_cascade(docs).where("kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; of rows with one id and text one does.

    Different texts under one id are documents of their own, in the order of their fingerprints; of rows that differ only in
    other columns the first as JSON stays. Null ids come after all others. Null and empty texts are copies of nothing and
    stay. An empty table stays empty. Other columns, whatever their names, stay as they are.
    """
    node, fp, place = fresh(docs, "node", "fp", "place")
    tagged = docs.withColumn(node, node_id("doc_id", "text"))
    repeated = not tagged.groupBy(node).count().where("count > 1").isEmpty()
    keyed = docs.select("doc_id", "text")
    if repeated:
        tagged = tagged.withColumn(fp, F.xxhash64(F.coalesce("text", F.lit(""))))
        places = tagged.select(node, fp).distinct().orderBy(node, fp).rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
        numbered = spark.createDataFrame(places, f"`{node}` long, `{fp}` long, `{place}` long")
        tagged = table(tagged.join(numbered, [node, fp]).withColumn(node, F.col(place)).drop(fp, place), "numbered")
        keyed = tagged.select(F.col(node).alias("doc_id"), "text")
    first = classes(keyed, links=False).where("node = class_id").select(F.col("node").alias(node))
    kept = tagged.join(first, node, "left_semi")
    if repeated:
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        kept = kept.groupBy(node).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document holds are cut out; a document of which nothing is left goes. Other texts stay as they are.

    Null and empty texts stay, as "". Rows with one id never cut each other; null ids come after all others. An empty table
    stays empty. n_chars, if there, is counted anew; other columns, whatever their names, stay as they are.
    """
    out = remove_repeated_passages(docs).where("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.col("left_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare sources are repeated, up to twice; every document stays at least once.

    Null sources are one source; null texts, null ids and repeated rows are mixed like others. An empty table stays empty.
    Other columns, whatever their names, stay as they are.
    """
    return mix(docs, keep=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences.

    A null or empty text is its end id alone; rows that mixing repeats, or without an id, each have pieces. An empty table
    has none. Other columns are not looked at.
    """
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: Tokenising and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
