"""Operator 1, token counts: batch encoding in Arrow functions that return lengths only.

Rows: null text counts as empty (0 tokens); repeated rows each keep their own row; an empty table gives an empty result;
other columns of the input are not read. Long texts are split at white space, a safe boundary, and pieces of all texts
are encoded in batches balanced by bytes, so a worker's memory does not depend on the longest text's token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_chunks, binary_text
from .tokens import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; no shuffle."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            for ids, texts in binary_chunks(batch):
                n_tokens = [len(x) // 4 for x in words.texts(texts)]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, [len(x) for x in texts], n_tokens)], ["doc_id", "n_bytes", "n_tokens"])
        words.forget()

    return binary_text(docs).mapInArrow(lengths, SCHEMA)


def with_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
