"""Word lists, area names, test cases, settings and silver tables from files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.schema import TABLES


def word_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A word a line; empty lines and lines from # on are left out. For lists that are written by hand, so they are small."""
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    return tuple(sorted(r["value"] for r in rows.collect()))


def area_names(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) from code;name lines."""
    return spark.read.schema("code string, name string").option("sep", ";").csv(path).select(F.col("code").cast("int").alias("code"), "name")


CASE = "case_id string, name string, text string, expected array<struct<lat:double,lon:double>>, svg_file string"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Texts with the places they should give."""
    return spark.read.schema(CASE).json(path)


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in TABLES.items()}


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Silver tables as Parquet, sorted by their first column within files, so that readers can skip by it."""
    for name, df in tables.items():
        df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(f"{folder}/{name}")


def has_snapshot(spark: SparkSession, folder: str) -> bool:
    """Were all tables written to the end?"""
    jvm = spark._jvm
    for name in TABLES:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return False
    return True


@dataclass
class Settings:
    """Lines of ``key = "value";``. ~ and ${name} are expanded; paths are taken from the file's folder."""

    values: dict[str, str] = field(default_factory=dict)
    folder: str = "."

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            lines = [s for s in f if not s.lstrip().startswith("#")]
        pairs = (re.match(r'\s*(\w+)\s*[=:]\s*"?([^";]*)"?\s*;?\s*$', s) for s in lines)
        return cls({m[1]: m[2] for m in pairs if m}, os.path.dirname(os.path.abspath(path)))

    def get(self, key: str, default: str | None = None) -> str | None:
        value = self.values.get(key, default)
        if value is None:
            return None
        for _ in range(8):
            new = re.sub(r"\$\{(\w+)\}", lambda m: self.values.get(m[1], os.environ.get(m[1], "")), value)
            if new == value:
                break
            value = new
        return os.path.expanduser(value)

    def path(self, key: str) -> str | None:
        value = self.get(key)
        return value if value is None or os.path.isabs(value) or "://" in value else os.path.join(self.folder, value)
