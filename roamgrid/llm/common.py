"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch sent to a Python worker; texts are long, so the default of 10,000 would not be bounded.
BATCH_ROWS = 1000
#: Text bytes handled together inside a worker.
CHUNK_BYTES = 1 << 19
#: Bytes of one long text whose words are held together.
PIECE_BYTES = 1 << 18
#: What ``bytes.split`` separates at.
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches small, by rows and by bytes, and let Python workers find this package where the driver does."""
    environment = spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names; one of our own only where it names none and all runs on this machine (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="roamgrid-"))
    return context.getCheckpointDir()


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table in the shared folder and read it again: as ``checkpoint``, but in columns, for rows with texts."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it where the table has such a column."""
    taken = {c.casefold() for c in df.columns}
    while name.casefold() in taken:
        name = f"_{name}"
    return name


def id_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty string."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def chunks(texts: Iterable[str | bytes | None], limit: int = CHUNK_BYTES, empty: str | bytes = "") -> Iterator[tuple[int, list]]:
    """Consecutive texts of about ``limit`` bytes together, with the place of the first; null counts as ``empty``."""
    start, held, size = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text or empty)
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = at + 1, [], 0
    if held:
        yield start, held


def binary_text(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text) with the text's UTF-8 bytes, and what more is asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def binary_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """The doc_ids and texts of a batch of ``binary_text``, about ``limit`` bytes of text together; null counts as empty."""
    for start, texts in byte_chunks(batch.column(1), limit):
        yield batch.column(0).slice(start, len(texts)).to_pylist(), texts


def pieces(text: bytes, table: bytes | None = None, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text's bytes in pieces of about ``size``, mapped through ``table`` (256 bytes) if there is one; no word is cut, white space separates."""
    start = 0
    while start < len(text):
        end, reach = start + size, size
        piece = text[start:end].translate(table)
        # up to the last space, so that no word is cut; a longer word takes as much again until one comes
        while end < len(text) and (cut := max(map(piece.rfind, _SPACES))) < 1:
            piece, end, reach = piece + text[end : end + reach].translate(table), end + reach, 2 * reach
        if end < len(text):
            piece, end = piece[:cut], start + cut
        yield piece
        start = end


def word_pieces(text: bytes, table: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text's bytes, by ``pieces``."""
    for piece in pieces(text, table, size):
        yield piece.split()


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """As ``chunks``, of a string or binary column as UTF-8 bytes."""
    return chunks((x.as_py() for x in column.cast(pa.binary())), limit, b"")
