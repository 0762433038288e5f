"""Tables in the folder that the cluster shares: a cut of the lineage that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset (tests, notebooks) a folder of our own is set up, and then also as checkpoint dir.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    own = tempfile.mkdtemp(prefix="placelore-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before us; the folder is scratch space  # noqa: BLE001
        pass


def _drop_all(held: list[tuple[SparkSession, str]]) -> None:
    while held:
        _drop(*held.pop())


#: Tables to remove, by scope; those of the first are removed when the driver exits.
_scopes: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=([],))
atexit.register(_drop_all, _scopes.get()[0])


@contextmanager
def scope():
    """Tables that are written inside are removed at its end: for loops and streams, whose results have been stored by then."""
    held: list[tuple[SparkSession, str]] = []
    token = _scopes.set((*_scopes.get(), held))
    try:
        yield
    finally:
        _scopes.reset(token)
        _drop_all(held)


#: With it shuffle files go as soon as the table that they were made for is written, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table to the shared scratch folder and reads it back.

    The table survives the loss of any executor. It is removed at the end of the scope (outer: of the scope around that), or
    when the driver exits.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _scopes.get()[-2 if outer else -1].append((spark, path))
    return spark.read.schema(schema).parquet(path)
