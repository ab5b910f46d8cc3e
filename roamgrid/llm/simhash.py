"""Operator 5, SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets a table of its Hamming distances to reference fingerprints (pivots), kept for each of
several blocks of its bits; a block's coordinates add up to the whole distance. Of B blocks, fingerprints that differ in
at most k bits agree in at least B - k, so their coordinates there differ by nothing: fingerprints meet under the
coordinates of every B - k blocks. Among those that meet, pairs whose whole distances to some pivot differ by more than
k are discarded (the triangle inequality), and the survivors' own distance is computed. Nothing is missed whatever B is,
and no pair of the whole table is ever formed unless it meets.

Exact copies share a fingerprint and are one node. Within a meeting only a spanning forest of links is emitted, never
all pairs; a meeting of more than ``TILE`` fingerprints is dealt into tiles, each pair of tiles in a task of its own.

Rows: null text counts as empty (fingerprint zero, linked like any other); repeated rows get equal results; a null
doc_id never becomes a component's id unless it is alone with nulls; an empty table gives an empty result; other input
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, unused, word_pieces
from .components import components

WORDS, SEED, BITS = 3, 42, 3
PIVOTS = 16
_LOWER = bytes(range(256)).lower()
TILE = 8192
#: Reference fingerprints: the XXH64 digests of the first numbers.
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(PIVOTS)], np.uint64)


class Blocks:
    """Neighbouring bits in ``number`` blocks, and the choices of blocks that must agree within ``bits`` differing bits.

    Three blocks agree by default: 32 bits of a key for three differing bits (20 keys a fingerprint), 24 bits for five (56).
    More blocks make longer and more keys, for a corpus of many more fingerprints than such a key has values.
    """

    def __init__(self, number: int, bits: int):
        sizes = [64 // number + (i < 64 % number) for i in range(number)]
        self.masks = np.array([((1 << size) - 1) << sum(sizes[:i]) for i, size in enumerate(sizes)], np.uint64)
        self.choices = list(combinations(range(number), number - bits))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of lower-cased (A-Z) UTF-8. A long text goes by pieces; the last words of a piece begin the shingles of the next."""
    ones, count, held = np.zeros(64, np.int64), 0, []
    for piece in word_pieces(text, _LOWER):
        held += piece
        if len(held) >= words:
            ones += _ones(held, words)
            count += len(held) - words + 1
            held = held[len(held) - words + 1 :]
    if not count:
        if not held:
            return 0
        ones, count = _ones(held, len(held)), 1
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _ones(found: list[bytes], words: int) -> np.ndarray:
    """In how many of the shingles' digests each bit is set."""
    joined = b" ".join(found)
    ends = list(accumulate(len(x) + 1 for x in found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])], "<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) with the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", words) for x in batch.column(2)], np.uint64)
            yield pa.record_batch([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(of, "doc_id long, text_hash long, fp long")


def block_distances(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The pivot distance table by block, (fingerprints, blocks, pivots)."""
    return np.bitwise_count((fps[:, None, None] ^ REFERENCES[None, None, :]) & masks[None, :, None])


def distances(fps: np.ndarray) -> np.ndarray:
    """The whole distances to the pivots, (fingerprints, pivots)."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)


def meeting_keys(fps: np.ndarray, blocks: Blocks) -> np.ndarray:
    """A key for each choice of blocks: their coordinates, written as digits, mixed into 64 bits."""
    digits = np.array([14**i for i in range(PIVOTS)], np.uint64)  # blocks of at most 13 bits
    signs = (block_distances(fps, blocks.masks).astype(np.uint64) * digits).sum(axis=2, dtype=np.uint64)
    keys = []
    for number, choice in enumerate(blocks.choices):
        key = np.full(len(fps), number + 1, np.uint64)
        for block in choice:
            key = (key ^ signs[:, block]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(key * np.uint64(0xBF58476D1CE4E5B9))
    return np.stack(keys, axis=1)


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of at most ``bits`` that join all that they can join: from each fingerprint reached to those not yet reached."""
    table = distances(fps)
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            left = rest
            for pivot in range(PIVOTS):
                left = left[np.abs(table[left, pivot] - table[at, pivot]) <= bits]
                if not len(left):
                    break
            left = left[np.bitwise_count(fps[left] ^ fps[at]) <= bits] if len(left) else left
            if len(left):
                links += [(at, x) for x in left]
                stack += list(left)
                rest = rest[~np.isin(rest, left, assume_unique=True)]
    return links


def links(distinct: DataFrame, bits: int = BITS, tile: int = TILE, number: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``: a spanning forest of each meeting."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            keys = meeting_keys(fps.view(np.uint64), blocks).view(np.int64)
            yield pa.record_batch([pa.array(np.repeat(fps, len(blocks.choices))), pa.array(keys.ravel())], ["fp", "key"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.values.to_numpy().view(np.uint64)
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            pairs = offsets[:-1][sizes == 2]
            near = np.abs(distances(values[pairs]) - distances(values[pairs + 1])).max(axis=1, initial=0) <= bits
            pairs = pairs[near]
            pairs = pairs[np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= bits]
            a, b = [values[pairs]], [values[pairs + 1]]
            for at in np.flatnonzero(sizes > 2):
                own = values[offsets[at] : offsets[at + 1]]
                if found := forest(own, bits):
                    i, j = np.array(found).T
                    a.append(own[i])
                    b.append(own[j])
            yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    blocks = Blocks(number or bits + 3, bits)
    keys = checkpoint(distinct.select("fp").mapInArrow(keyed, "fp long, key long"))
    sizes = keys.groupBy("key").count().where("count > 1")
    met = keys.join(sizes, "key").withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # every two tiles meet once: tile i goes to (min(i, j), max(i, j)) for every j
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = met.groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return lists.select("fps").mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row: component_id is the least doc_id that links reach."""
    prints = checkpoint(fingerprints(docs, words))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, bits))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = checkpoint(joined)
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(best, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_first(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """One row of each group, all columns: the one with the least doc_id. Rows are told apart by doc_id and text."""
    row_id, row_hash = unused(docs, "__row_id"), unused(docs, "__row_hash")
    keys = {row_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))}
    first = near_duplicates(docs, bits, words).where("doc_id <=> component_id")
    # texts of one doc_id in one group: the least hash stands for them
    first = first.groupBy("doc_id", "component_id").agg(F.min("text_hash").alias(row_hash)).withColumns(keys).select(row_id, row_hash).distinct()
    own = docs.withColumns(keys | {row_hash: F.xxhash64("text")})
    return own.join(first, [row_id, row_hash], "left_semi").dropDuplicates([row_id, row_hash]).select(docs.columns)
