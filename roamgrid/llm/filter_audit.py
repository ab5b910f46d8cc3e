"""Operator 12, filter interaction audit: what five filters take away in every order, by Walsh-Hadamard sums.

Each document fails a set of the filters, a mask of five bits. For every part (source) and label, the 32 signed parity
sums over its documents, the Walsh-Hadamard transform of its masks' counts, are aggregated in the tasks: a part costs 32
numbers a label, whatever its number of documents. The transform is inverted exactly (whole numbers, a sum over the same
32 signs, then five bits to the right) into the counts of the 32 masks, from which all 120 orders, their five steps, and
every filter's Shapley value follow: of the 120 orders, a document that fails k filters is taken away by each of them in
120 / k.

Filters: A, fewer than 200 words; B, fewer than half of the words distinct; C, more than 2 % of the code points are A-Z;
D, one of ``#$%&*|``; E, the text of a document of smaller doc_id, anywhere in the table, whether that one is kept or
not. For E only the least doc_id of each digest (SHA-256) is looked for, in tasks first; documents then meet it by digest
and doc_id, so that a text with many copies is no hot key.

Rows: null text counts as empty and null source as the empty string; repeated rows (same doc_id) are counted each, and none is
the other's copy; a null doc_id is smaller than none and none is smaller than it, so E never holds for it, and it has no
label; of several label rows of a doc_id one that says 1 is enough; an empty table gives an empty result; other columns
are not read, so their names cannot clash. Distinct words of a text of over a megabyte are told apart by 64-bit hashes,
in arrays, to keep long texts bounded.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, binary_text, store, word_pieces

FILTERS = "ABCDE"
# The filters' limits and the marks of filter D
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
SETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
_SAME = bytes(range(256))
_NOT_CAPITAL = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_INSIDE = bytes(range(0x80, 0xC0))
#: Code points from which on distinct words are hashes.
LONG = 1 << 20


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text fails."""
    n = 0
    seen: set[bytes] = set()
    hashes = np.empty(0, np.uint64)
    for words in word_pieces(text, _SAME):
        n += len(words)
        if len(text) <= LONG:
            seen.update(words)
        else:
            hashes = np.union1d(hashes, np.array([xxhash.xxh64_intdigest(x) for x in set(words)], np.uint64))
    capitals = points = 0
    for at in range(0, len(text), PIECE_BYTES):
        piece = text[at : at + PIECE_BYTES]
        capitals += len(piece.translate(None, _NOT_CAPITAL))
        points += len(piece.translate(None, _INSIDE))
    marked = any(x in text for x in MARKS)
    failed = n < LEAST_WORDS, 100 * (len(seen) + len(hashes)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, marked
    return sum(1 << i for i, x in enumerate(failed) if x)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every row, filters A to D."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, digests = [], []
            for text in batch.column(1):
                text = text.as_py() or b""
                own.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(own, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = binary_text(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(find, "doc_id long, part string, mask int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """``masks`` with filter E."""
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, COPY).otherwise(0)).drop("first", "digest")


def parity(a: Column | int, b: Column | int) -> Column:
    """1 where an even number of bits is in both, -1 elsewhere."""
    both = (a if isinstance(a, Column) else F.lit(a)).bitwiseAND(b if isinstance(b, Column) else F.lit(b))
    return F.lit(1).cast("long") - 2 * (F.bit_count(both) % 2)


def walsh_sums(rows: DataFrame) -> DataFrame:
    """(part, every, good, toxic): arrays of the 32 parity sums of rows(part, mask, good, toxic)."""
    sums = lambda where: F.array(*(F.coalesce(F.sum(F.when(where, parity(F.col("mask"), s))), F.lit(0).cast("long")) for s in range(SETS)))
    return rows.groupBy("part").agg(sums(F.lit(True)).alias("every"), sums(F.col("good")).alias("good"), sums(F.col("toxic")).alias("toxic"))


def cells(sums: str) -> Column:
    """The counts of the 32 masks from their parity sums."""
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    return F.transform(sets, lambda m: F.shiftright(F.aggregate(sets, F.lit(0).cast("long"), lambda t, s: t + F.get(sums, s) * parity(m, s)), len(FILTERS)))


def order_steps() -> Column:
    """array<(filter_order, step, own, before)> of all orders: the step's filter and those before it, as bits."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, own in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "own": 1 << own, "before": sum(1 << i for i in order[: step - 1])})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def evaluate(counts: DataFrame) -> DataFrame:
    """The report from counts(part, every, good, toxic), arrays over the masks."""
    rows = counts.select("part", "every", "good", "toxic", F.inline(order_steps()))
    own, before = F.col("own"), F.col("before")
    orders = len(list(itertools.permutations(FILTERS)))
    share = F.array(F.lit(0), *(F.lit(orders // k) for k in range(1, len(FILTERS) + 1))).cast("array<bigint>")

    def total(name: str, holds, weight=lambda m: F.lit(1).cast("long")) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), holds)
        return F.aggregate(places, F.lit(0).cast("long"), lambda t, m: t + F.get(name, m) * weight(m))

    fails = lambda m: m.bitwiseAND(own) != 0
    new = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    return rows.select(
        "part", "filter_order", "step",
        total("every", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("every", new).alias("removed"),
        total("every", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.get("every", own).alias("unique_fails"),
        total("good", new).alias("good_lost"),
        total("toxic", new).alias("toxic_lost"),
        total("every", fails, lambda m: F.get(share, F.bit_count(m))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part."""
    rows = with_copies(store(masks(docs), "masks"))
    is_one = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(f"is_{c}")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    said = lambda c: F.coalesce(F.col(f"is_{c}"), F.lit(False))
    rows = rows.join(marked, "doc_id", "left").select("part", "mask", said("quality").alias("good"), said("toxic").alias("toxic"))
    counts = walsh_sums(rows).select("part", *(cells(x).alias(x) for x in ("every", "good", "toxic")))
    return evaluate(counts)
