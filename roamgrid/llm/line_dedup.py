"""Operator 10, line dedup by pairwise alignment of documents that share lines.

A text is cut into lines at line feeds and, as prose often stands in one long line, behind sentence ends; every line that
is not blank is hashed. Documents of the same lines are one class: the one of least doc_id stands for it, and the others
lose all of it. In how many classes a line is, is counted over all documents. A line that no other class has cannot be
common, so it is a barrier: what is left of a document are its runs of shared lines, and runs of under ``min_words``
words are no passage. Inside the runs, every shortest stretch of lines that reaches ``min_words`` (from its first line on
or from its last line back; every line of a common passage lies in one that is common too) is known by its hash and by
its rarest line. Of the documents that share a rare line in one such stretch, the first (by doc_id) is paired with each
later one: n - 1 pairs for n documents, so frequent lines need no cap.

Each pair's runs with such a line are aligned with patience diff: lines that occur once in both are anchors, their
longest increasing run is kept, blocks grow from the anchors over equal neighbours, and the stretches in between are
aligned alike. A block is a run of aligned lines that stand side by side in both documents (blank lines aside); blocks of
at least ``min_words`` words are deleted from the later document. What is left is aligned again until no block comes, in
the end by stretches in place of lines (``common_blocks``). Only then are the blocks of all of a document's pairs put
together. The passes leave nothing: exactly those lines go that are in a run of at least ``min_words`` words which an
earlier document holds as a run.

One copy of every line stays: nothing earlier holds the run of its first document.

Rows: null and empty texts have no lines and stay as they are; repeated rows (same doc_id and text) count as one document
and are cut alike; texts of one doc_id are ordered by hash; a null doc_id sorts last; rows are told apart by doc_id and
text; columns of the input keep their names whatever these are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, store, unused

MIN_WORDS = 40
#: Passes over lines, at most; those over stretches, which see repeated lines too, go on until nothing is common.
LINE_PASSES = 4
#: Of the hashes of stretches, modulo 2 to the 64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Behind a line feed, or behind a sentence end and a space; Java and Python split alike here.
CUT = r"(?<=\n)|(?<=[.!?] )"
_CUT = re.compile(CUT.encode())
LAST = (1 << 63) - 1


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, class, total, lines, words, places): hashes, words and places of the lines that aren't blank, in order."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(2):
                own = [x.strip() for x in _CUT.split(text.as_py() or b"")]
                places = array("i", [i for i, x in enumerate(own) if x])
                lines = array("q", [(xxhash.xxh64_intdigest(own[i]) or 2) - (1 << 63) for i in places])
                words = array("i", [len(own[i].split()) for i in places])
                known = xxhash.xxh64_intdigest(lines.tobytes() + places.tobytes()) - (1 << 63)
                for column, value in zip(columns, (known, sum(words), lines, words, places), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.record_batch([*batch.columns[:2], *map(pa.array, columns, kinds)], ["doc", "text_hash", "class", "total", "lines", "words", "places"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(split, "doc long, text_hash long, class long, total long, lines array<long>, words array<int>, places array<int>")


def _rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run (patience sorting)."""
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for at, value in enumerate(values):
        pile = bisect_left(tops, value)
        back.append(heads[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            heads.append(at)
        else:
            tops[pile], heads[pile] = value, at
    run, at = [], heads[-1] if heads else -1
    while at >= 0:
        run.append(at)
        at = back[at]
    return run[::-1]


def patience(ours: list[int], theirs: list[int]) -> list[tuple[int, int]]:
    """The aligned places, (ours, theirs), in order."""
    aligned: list[tuple[int, int]] = []
    todo = [(0, len(ours), 0, len(theirs))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and ours[a] == theirs[c]:
            aligned.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and ours[b - 1] == theirs[d - 1]:
            b, d = b - 1, d - 1
            aligned.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(ours[a:b]), Counter(theirs[c:d])
        place = {x: i for i, x in enumerate(theirs[c:d], c) if right[x] == 1 and left.get(x) == 1}
        once = [i for i in range(a, b) if ours[i] in place]
        # where no line is alone in both, nothing is aligned here: trying repeated lines one by one would take quadratic time
        anchors = [once[k] for k in _rising([place[ours[i]] for i in once])]
        for i in anchors:
            j = place[ours[i]]
            aligned.append((i, j))
            todo.append((a, i, c, j))
            a, c = i + 1, j + 1
        if anchors:
            todo.append((a, b, c, d))
    return sorted(aligned)


def stretches(lines: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last place of every shortest stretch of a run of lines that reaches ``min_words``."""
    n = len(lines)
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    forward = np.searchsorted(upto, upto[:-1] + min_words)  # ends, behind the last line
    back = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    first, end = np.concatenate([np.arange(n), back]), np.concatenate([forward, np.arange(1, n + 1)])
    some = (first >= 0) & (end <= n)
    first, end = np.divmod(np.unique(first[some] * (n + 1) + end[some]), n + 1)
    power, inverse = (np.cumprod(np.array([1] + n * [x], np.uint64), dtype=np.uint64) for x in (BASE, BASE_INVERSE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.astype(np.uint64) * inverse[:n], dtype=np.uint64)])
    return ((total[end] - total[first]) * power[first]).astype(np.int64), first, end - 1


def runs(at: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Begins and ends of the runs of neighbouring lines of at least ``min_words`` words."""
    edge = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    return [(a, b) for a, b in zip(edge, edge[1:]) if upto[b] - upto[a] >= min_words]


def shared_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(class, run, at, places, lines, words, rare, stretch) from lists of shared lines: a row for each run, and of every stretch its rarest line and its hash."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, own, columns = batch.column(1), [], [[] for _ in range(7)]
            fields = [lists.values.field(k).to_numpy() for k in range(5)]
            ends = lists.offsets.to_numpy()
            for row, (begin, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                order = begin + np.argsort(fields[0][begin:end])
                at, places, lines, words, number = (x[order] for x in fields)
                rank = np.empty(len(at), np.int64)
                rank[np.lexsort((lines, number))] = np.arange(len(at))
                for a, b in runs(at, words, min_words):
                    h, first, last = stretches(lines[a:b], words[a:b], min_words)
                    rare = [lines[a + i + rank[a + i : a + j + 1].argmin()] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                    own.append(row)
                    for column, value in zip(columns, (int(at[a]), *(x[a:b] for x in (at, places, lines, words)), rare, h), strict=True):
                        column.append(value)
            kinds = [pa.int32(), *(pa.list_(x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.record_batch([batch.column(0).take(pa.array(own, pa.int64())), *map(pa.array, columns, kinds)], ["class", "run", "at", "places", "lines", "words", "rare", "stretch"])

    return rows.mapInArrow(found, "class long, run int, at array<int>, places array<int>, lines array<long>, words array<int>, rare array<long>, stretch array<long>")


def _side_by_side(aligned: list[tuple[int, int]], words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """First and last places, in ours, of the aligned stretches without a gap in either document that reach ``min_words``."""
    found, begin = [], 0
    for k in range(1, len(aligned) + 1):
        if k == len(aligned) or aligned[k] != (aligned[k - 1][0] + 1, aligned[k - 1][1] + 1):
            a, b = aligned[begin][0], aligned[k - 1][0]
            if words[a : b + 1].sum() >= min_words:
                found.append((a, b))
            begin = k
    return found


def common_blocks(ours: np.ndarray, words: np.ndarray, theirs: np.ndarray, their_words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """First and last places, in ours, of the aligned blocks of two runs of lines, by passes of patience diff.

    The first passes align lines. A block that is found leaves ours, and what is left is aligned again: so blocks in
    another order are found as well. Lines that are repeated in a run have no anchors of their own; but stretches of
    ``min_words`` words mostly are single, so all further passes align these, each once, until none comes, and a stretch
    that is repeated in ours goes with its first one. They see ours forwards and backwards in turn, so that an order
    turned round takes no more passes than one that was kept.
    """
    left, other, found = ours.tolist(), theirs.tolist(), []
    gone = np.zeros(len(ours), bool)
    for _ in range(LINE_PASSES):
        if not (blocks := _side_by_side(patience(left, other), words, min_words)):
            break
        for a, b in blocks:
            left[a : b + 1] = [None] * (b + 1 - a)  # no line of theirs equals these
            gone[a : b + 1] = True
        found += blocks
    mine, known = stretches(ours, words, min_words), stretches(theirs, their_words, min_words)
    order = np.argsort(known[1], kind="stable")
    their_order = list(dict.fromkeys(known[0][order].tolist()))
    upto = np.concatenate([[0], np.cumsum(gone)])
    open_ = upto[mine[2] + 1] - upto[mine[1]] < mine[2] + 1 - mine[1]  # some line of theirs is still there
    order = np.flatnonzero(open_)[np.argsort(mine[1][open_], kind="stable")]
    places: dict[int, list[int]] = {}
    for k in order.tolist():
        places.setdefault(int(mine[0][k]), []).append(k)
    turned = False
    while True:
        sequence = list(places)[::-1] if turned else list(places)
        aligned = [sequence[i] for i, _ in patience(sequence, their_order)]
        if not aligned and turned:
            return found
        for h in aligned:
            found += [(int(mine[1][k]), int(mine[2][k])) for k in places.pop(h)]
        turned = not turned


def cuts(classes: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(class, cut, gone): the places of the lines to delete and a flag for each place up to the last, for classes(class, doc, lines, words, places) that lose any."""
    # a class counts a line once; what no other has goes no further
    frequency = classes.select(F.explode(F.array_distinct("lines")).alias("line")).groupBy("line").agg(F.count("*").alias("number")).where("number > 1")
    frequency = store(frequency, "frequency")  # apart from the joins, as below: skewed partitions can be split then
    each = classes.select("class", F.posexplode(F.arrays_zip("places", "lines", "words")).alias("at", "x"))
    each = each.select("class", "at", F.col("x.places").alias("place"), F.col("x.lines").alias("line"), F.col("x.words").alias("words"))
    shared = each.join(frequency, "line").groupBy("class").agg(F.collect_list(F.struct("at", "place", "line", "words", F.col("number").cast("long").alias("number"))).alias("found"))
    passages = store(shared_runs(shared, min_words).join(classes.select("class", "doc"), "class"), "passages")
    rare = passages.select("class", "run", "doc", F.explode(F.arrays_zip("rare", "stretch")).alias("x")).select("class", "run", "doc", "x.rare", "x.stretch")
    owners = rare.groupBy("rare", "stretch").agg(F.min(F.struct("doc", "class", "run")).alias("own"), F.count("*").alias("holders")).where("holders > 1").select("rare", "stretch", F.col("own.class").alias("owner"), F.col("own.run").alias("owner_run"))
    owners = store(owners, "owners")
    pairs = rare.join(owners, ["rare", "stretch"]).where(F.col("class") != F.col("owner")).select("class", "run", "owner", "owner_run").distinct()
    pairs = checkpoint(pairs)
    # of both documents only the runs that share a rare line and its stretch travel
    owned = passages.select(F.col("class").alias("owner"), F.col("run").alias("owner_run"), F.struct("lines", "words").alias("theirs"))
    both = pairs.join(owned, ["owner", "owner_run"]).join(passages.select("class", "run", F.struct("lines", "words").alias("ours"), "places"), ["class", "run"]).select("class", "ours", "theirs", "places")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            ours, theirs = ([[batch.column(side).field(k)[row].values.to_numpy() for k in range(2)] for row in range(batch.num_rows)] for side in (1, 2))
            for own, other, places in zip(ours, theirs, batch.column(3), strict=True):
                places = places.values.to_numpy()
                cut = np.zeros(int(places[-1]) + 2, np.int64)
                for a, b in common_blocks(*own, *other, min_words):
                    cut[places[a]] += 1
                    cut[places[b] + 1] -= 1
                found.append(np.flatnonzero(np.cumsum(cut)).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["class", "cut"])

    aligned = both.mapInArrow(align, "class long, cut array<int>").where("size(cut) > 0")
    joined = aligned.groupBy("class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("cut")))).alias("cut"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cut in batch.column(1):
                cut = cut.values.to_numpy()
                found.append(np.zeros(int(cut[-1]) + 1, bool))
                found[-1][cut] = True
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.bool_()))], ["class", "cut", "gone"])

    return joined.mapInArrow(flags, "class long, cut array<int>, gone array<boolean>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row, with ``text`` less its deleted lines and, as the last column, their places or null: ``__cut``, or that
    with underscores before it where the input has such a column."""
    lines = store(document_lines(docs), "lines")
    first = lambda *names: (F.first(x).alias(x) for x in names)
    classes = store(lines.where(F.col("total") >= min_words).groupBy("class").agg(F.min("doc").alias("doc"), *first("lines", "words", "places")), "classes")
    found = checkpoint(cuts(classes, min_words))
    edges = classes.select("class", F.col("doc").alias("first_doc"), F.element_at("places", 1).alias("low"), F.element_at("places", -1).alias("high"))
    rows = lines.where(F.col("total") >= min_words).select("doc", "text_hash", "class").distinct().join(edges, "class").join(found, "class", "left")
    copy = F.col("doc") > F.col("first_doc")  # a later copy loses all
    whole = F.sequence("low", "high")
    doc, text_hash, cut, gone, low, high = (unused(docs, x) for x in ("__doc", "__hash", "__cut", "__gone", "__low", "__high"))
    rows = rows.where(copy | F.col("cut").isNotNull()).select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.when(copy, whole).otherwise(F.col("cut")).alias(cut), F.when(~copy, F.col("gone")).alias(gone), F.when(copy, F.col("low")).alias(low), F.when(copy, F.col("high")).alias(high))
    own = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), text_hash: F.xxhash64("text")})
    stays = lambda x, i: ~(F.coalesce(F.get(gone, i), F.lit(False)) | F.coalesce(i.between(F.col(low), F.col(high)), F.lit(False)))
    kept = F.array_join(F.filter(F.split("text", CUT, -1), stays), "")
    joined = own.join(rows, [doc, text_hash], "left")
    return joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns, cut)
