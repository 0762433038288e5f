"""The facade on an unbounded input: a stream of texts against a static map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from placelore.plans.locate import Map, locate
from placelore.scratch import scope

TEXTS = "query_id long, text string"


def read_texts(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """New JSON files of (query_id, text) under path."""
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def locate_stream(texts: DataFrame, m: Map, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 20, once: bool = False) -> StreamingQuery:
    """Locates each batch of texts and hands the results to sink(results, batch_id).

    Ranking and dedupe are per text, so a text's results never wait for another batch and no state is kept. A batch that is
    run again after a failure gives the same rows; a sink that overwrites by batch_id is exactly-once. The map is stored once,
    before the first batch.
    """

    def batch(rows: DataFrame, i: int) -> None:
        with scope():  # what a batch writes to the scratch folder goes when its sink is done
            sink(locate(rows, held, k=k), i)

    held = m.stored()
    out = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
