"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the stage before it kept and returns the columns of ``documents``; the last returns the
pieces of the packed sequences. Nulls, repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamgrid.llm import decontam, line_dedup, packing, quality_mil, simhash
from roamgrid.llm.common import bounded_batches, store, table
from roamgrid.llm.queries import vocabulary


NEAR_BITS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the raw documents' labels."""
    model = quality_mil.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_mil.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document holds go; so does a document of which nothing is left. n_chars follows the text."""
    bounded_batches(spark)
    cut = line_dedup.dedup_lines(docs)
    whole = F.col(cut.columns[-1]).isNull()
    cut = cut.where(whole | (F.trim(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id.

    Copies with a few words changed differ in some more bits than the query's three, which exact copies and the closest
    ones keep to; unrelated texts differ in about 32.
    """
    bounded_batches(spark)
    return simhash.keep_first(docs, bits=NEAR_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: No stage can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
