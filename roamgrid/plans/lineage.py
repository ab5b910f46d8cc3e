"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where it names none and all runs here (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="roamgrid-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, by a table in the shared folder: in columns, and with nothing of the plan before but the schema."""
    path = f"{shared_folder(df.sparkSession)}/part-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all in it, on any file system that Spark writes to; False where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one computation, in a database of their own in the shared folder; they go with it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"roamgrid_{uuid.uuid4().hex}"
        self.kept: dict[str, DataFrame] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_folder(spark)}/{self.name}'")

    def keep(self, rows: DataFrame, *keys: str, lies: bool = False) -> DataFrame:
        """The rows as a table; with keys in as many buckets as shuffles have partitions, so that joins on them move nothing.

        Each bucket is written by one task, as one file: rows are moved there, but where they lie by these keys already (``lies``).
        """
        if keys and not lies:
            rows = rows.repartition(self.buckets, *keys)
        table = f"{self.name}.t_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet")
        (writer.bucketBy(self.buckets, *keys).sortBy(*keys) if keys else writer).saveAsTable(table)
        self.kept[table] = self.spark.table(table)
        return self.kept[table]

    def keep_observed(self, rows: DataFrame, *keys: str, values: dict[str, Column], lies: bool = False) -> tuple[DataFrame, dict]:
        """As ``keep``, with aggregates over the rows, taken by the job that writes them."""
        seen, each = Observation(), [c.alias(name) for name, c in values.items()]
        kept = self.keep(rows.observe(seen, *each), *keys, lies=lies)
        try:
            return kept, seen.get
        except Py4JJavaError:  # a job without a single task (its input turned out to be empty) has observed nothing
            return kept, kept.agg(*each).first().asDict()

    def keep_counted(self, rows: DataFrame, *keys: str, lies: bool = False, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """As ``keep``, with counts of rows that hold, taken by the job that writes them."""
        return self.keep_observed(rows, *keys, lies=lies, values={"rows": F.count(F.lit(1))} | {name: F.count_if(c) for name, c in counts.items()})

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that were kept, with their files."""
        for name in [n for n, kept in self.kept.items() if any(kept is t for t in tables)]:
            self.spark.sql(f"DROP TABLE {name}")
            del self.kept[name]

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.close()
