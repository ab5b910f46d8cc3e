"""Operator 4, best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents of the same length are interchangeable, and so are gaps of the same size. The pieces are range-sorted by
length across the cluster and the gaps are kept sorted by size. A round takes all pieces of one length (the longest
first) and sweeps the gaps upwards from their successor, the smallest gap that holds them; where several pieces want one
gap, their rank in the sorted order decides (the r-th piece takes the r-th place); then the gaps are updated and the
next round begins. Only (length, count) and (gap, count) pass between rounds, at most ``length`` rows each whatever the
input, so the rounds themselves are arithmetic on a bounded table; every piece finds its own place by a search of its
(length, rank) among the places of its round, inside its range partition. The outcome is that of best-fit decreasing.

Rows: null text counts as empty (just the end id); repeated rows are packed as separate documents; an empty table gives
an empty result; a null doc_id is kept; other input columns are not read. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_chunks, binary_text, checkpoint
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the ids, unsigned 32-bit little-endian."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            for doc_ids, texts in binary_chunks(batch):
                rows: list[list] = [[] for _ in names]
                for doc_id, ids in zip(doc_ids, words.texts(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names)
        words.forget()

    return binary_text(docs).mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


@dataclass(frozen=True)
class Places:
    """Where the pieces of each round go: from ``rank`` on, ``each`` pieces to a sequence from ``first`` on, behind ``offset`` tokens."""

    piece: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    each: np.ndarray

    def find(self, piece: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        at = np.searchsorted(self.piece * (1 << 44) + self.rank, piece * (1 << 44) + rank, side="right") - 1
        within = rank - self.rank[at]
        return self.first[at] + within // self.each[at], self.offset[at] + within % self.each[at] * piece


def best_fit_rounds(counts: dict[int, int], length: int) -> Places:
    """Rounds over the lengths, longest first; gaps are groups of neighbouring sequences by the room they have left."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    places: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for piece in sorted(counts, reverse=True):
        left, rank = counts[piece], 0
        while left:
            at = bisect.bisect_left(sizes, piece)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, count = length, opened, -(-left // (length // piece))
                opened += count
            each = gap // piece
            placed = min(left, each * count)
            full, rest = divmod(placed, each)
            places.append((piece, rank, first, length - gap, each))
            put(gap - each * piece, first, full)
            put(gap - rest * piece, first + full, 1 if rest else 0)
            untouched = count - full - (1 if rest else 0)
            put(gap, first + count - untouched, untouched)
            left, rank = left - placed, rank + placed
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    return Places(*table.T.copy())


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is cut from its lineage here, so tokens are made once."""
    pieces = checkpoint(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``length`` rows
    columns = pieces.columns
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    by_length = checkpoint(pieces.repartitionByRange(F.desc("length"), "doc_id", "piece", "ids_crc32"))
    parted = by_length.withColumn("part", F.spark_partition_id())
    before: dict[tuple[int, int], int] = {}
    met: dict[int, int] = {}
    # a partition holds a range of lengths: partitions plus ``length`` rows at most
    for r in sorted(parted.groupBy("part", "length").count().collect()):
        before[r["part"], r["length"]] = met.get(r["length"], 0)
        met[r["length"]] = met.get(r["length"], 0) + r["count"]
    shared = pieces.sparkSession.sparkContext.broadcast((before, best_fit_rounds(counts, length)))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, places = shared.value
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(len(columns))[0].as_py()
            size = batch.column(columns.index("length")).to_numpy()
            order = np.argsort(size, kind="stable")
            kinds, begin, number = np.unique(size[order], return_index=True, return_counts=True)
            rank = np.empty(len(size), np.int64)
            for kind, b, n in zip(kinds.tolist(), begin.tolist(), number.tolist(), strict=True):
                base = seen.get(kind, starts[part, kind])
                rank[order[b : b + n]] = np.arange(base, base + n)
                seen[kind] = base + n
            sequence, offset = places.find(size, rank)
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in by_length.dtypes)
    return parted.mapInArrow(sweep, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    return pack(cut_into_pieces(docs, vocabulary, length, end_id, with_ids), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) from pieces that have their ids; a group is a sequence, so it is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("parts", lambda x: x["length"]).alias("lengths"))
