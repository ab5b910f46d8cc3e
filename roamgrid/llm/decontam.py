"""Operator 9, benchmark decontamination: a BM25 inverted index of the test items with block-max WAND.

Every passage of every document is a query (two neighbouring segments, each as long as the longest item, so that any
item lies whole inside some passage). An item is retrieved where the passage's BM25 score reaches ``share`` of the
item's own (its score for itself). As in WAND, an item's terms of least weight that could not reach its threshold even
together are not looked up at first: a passage meets items through the postings of the remaining, essential terms only.
Postings lead to blocks of ``BLOCK`` items of similar thresholds. Where a passage meets a block, the sum of the block's
greatest weights over the passage's terms bounds the scores of all of its items; blocks that can't reach the least
threshold are skipped, and only of the others the items are scored. All passages of a chunk go together. Retrieved pairs
are verified by the overlap of word trigrams with the item's question (its first three quarters) and, apart from that,
its answer (the last quarter).

An item of over ``PART_WORDS`` words is retrieved by parts of nearly equal length. It is verified as a whole: against the
text around the passage that reaches an item's length to both sides.

An index holds at most ``SHARD_ITEMS`` items and ``SHARD_WORDS`` words (but for one longer item). A larger benchmark is
dealt into shards by hashed id; documents are read once all the same, and a worker has one shard in memory at a time.
Document frequencies and the average length are those of the whole benchmark in every shard, so scores don't depend on
shards.

Rows: null and empty texts match nothing; null or wordless items are left out, repeated ones count once; repeated
documents each have their own rows, items of one item_id count once for a document; either table may be empty; other
columns are not read and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, checkpoint, pieces

SHARD_ITEMS = 4096
SHARD_WORDS = 1 << 19
SHARE = 0.5
OVERLAP = 0.5
PART_WORDS = 256
BLOCK = 4
K1, B = 1.2, 0.75
#: Bytes of the table of which term is in which segment.
CELLS = 1 << 23
#: Bytes of documents that a task holds until all shards are through, where there are several.
HELD_BYTES = 32 << 20
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (any non-ASCII character counts as a letter)."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _pieces(text: str | bytes | None) -> Iterator[list[bytes]]:
    """``words_of`` a long text, by pieces that end at white space."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    for piece in pieces(raw):
        yield words_of(piece.decode("utf-8", "surrogatepass" if isinstance(text, str) else "replace"))


def _grams(words: list, n: int = 3) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _parts(words: list[bytes]) -> list[list[bytes]]:
    """At most ``PART_WORDS`` words each and, of a longer item, at least half of that."""
    n = -(-len(words) // PART_WORDS)
    cuts = [len(words) * k // n for k in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Match:
    item_id: int | None
    score: float
    own_score: float
    word: int
    question: float
    answer: float


@dataclass
class Statistics:
    """Parts, words and longest part of a benchmark, and in how many parts a term is (at least the terms in use)."""

    parts: int
    words: int
    longest: int
    found: dict[bytes, int]


class Index:
    """Postings, thresholds and block maxima of one shard of items; terms and parts are numbers, tables flat."""

    def __init__(self, items: list[tuple[int | None, str | None]], share: float = SHARE, overlap: float = OVERLAP, whole_table: Statistics | None = None):
        whole = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        parts = [(k, p) for k, (_, w) in enumerate(whole) for p in _parts(w)]
        self.overlap = overlap
        self.terms = {t: n for n, t in enumerate(sorted({t for _, w in parts for t in w}))}
        table = whole_table or Statistics(len(parts), sum(len(p) for _, p in parts), max([0, *(len(p) for _, p in parts)]), Counter(t for _, p in parts for t in set(p)))
        self.segment = max(8, table.longest)
        average = table.words / max(1, table.parts)
        idf = {t: np.log(1 + (table.parts - table.found[t] + 0.5) / (table.found[t] + 0.5)) for t in self.terms}
        weights: list[dict[int, float]] = []
        for _, w in parts:
            norm = K1 * (1 - B + B * len(w) / average)
            weights.append({self.terms[t]: float(idf[t] * f * (K1 + 1) / (f + norm)) for t, f in sorted(Counter(w).items())})
        order = np.argsort([sum(w.values()) for w in weights], kind="stable").tolist()  # blocks of similar thresholds
        parts, weights = [parts[i] for i in order], [weights[i] for i in order]
        self.own = np.array([sum(w.values()) for w in weights])
        self.limit = share * self.own
        self.item = [k for k, _ in parts]
        self.reach = [len(whole[k][1]) if len(w) < len(whole[k][1]) else 0 for k, w in parts]
        self.ids = [i for i, _ in whole]
        self.words = [np.array([self.terms[t] for t in w], np.int32) for _, w in whole]
        self.part_terms = _Lists([list(w) for w in weights], np.int32)
        self.part_weights = np.array([x for w in weights for x in w.values()])
        essential: dict[int, set[int]] = {}
        maxima: list[dict[int, float]] = [{} for _ in range(-(-len(parts) // BLOCK))]
        for n, w in enumerate(weights):
            rest = 0.0
            for term, weight in sorted(w.items(), key=lambda x: (x[1], x[0])):
                if rest + weight < self.limit[n]:
                    rest += weight
                else:
                    essential.setdefault(term, set()).add(n // BLOCK)
                maxima[n // BLOCK][term] = max(weight, maxima[n // BLOCK].get(term, 0.0))
        self.postings = _Lists([sorted(essential.get(t, ())) for t in range(len(self.terms))], np.int32)
        self.block_terms = _Lists([list(x) for x in maxima], np.int32)
        self.block_max = np.array([w for x in maxima for w in x.values()])
        self.block_limit = np.array([self.limit[k * BLOCK : (k + 1) * BLOCK].min() for k in range(len(maxima))])

    def leaks(self, texts: list[str | bytes | None], seen: Counter | None = None) -> list[list[Match]]:
        """Verified matches of each text, the best of each item. ``seen`` counts passages, blocks met and items scored."""
        out: list[list[Match]] = [[] for _ in texts]
        if not self.ids:
            return out
        number = lambda words: np.fromiter(map(self.terms.get, words, repeat(-1)), np.int32, len(words))
        numbers = [[number(w) for w in _pieces(t)] for t in texts]
        lengths = np.array([sum(map(len, x)) for x in numbers], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *chain.from_iterable(numbers)])
        del numbers
        segments = -(-lengths // self.segment) + 1  # an empty one behind each text
        first = np.cumsum(segments) - segments
        last = np.zeros(int(segments.sum()), bool)
        last[first + segments - 1] = True
        own = np.repeat(np.arange(len(texts)), segments)
        # the word at which each segment begins
        edge = np.append((np.cumsum(lengths) - lengths)[own] + np.minimum((np.arange(len(last)) - first[own]) * self.segment, lengths[own]), len(ids))
        for low in range(0, len(last), rows := self._rows()):  # steps that overlap by a segment
            high = min(len(last), low + rows + 1)
            term = ids[edge[low] : edge[high]]
            at = np.repeat(np.arange(high - low), np.diff(edge[low : high + 1]))[term >= 0]
            has = _Has(at, term := term[term >= 0], high - low, len(self.terms))
            passage = np.flatnonzero(~last[low : min(low + rows, len(last))])
            where, items = self._retrieve(has, passage, at, term, seen)
            if len(where):
                self._verify(where, items, low, first, lengths, ids, out)
        return [list({m.item_id: m for m in sorted(o, key=lambda m: m.score)}.values()) for o in out]

    def _rows(self) -> int:
        """Segments of a step: as many as ``CELLS`` allows with all terms of the index or with as many terms as the step has words."""
        return max(1, CELLS // len(self.terms) - 1, math.isqrt(CELLS // self.segment) - 1)

    def _retrieve(self, has: _Has, passage: np.ndarray, at: np.ndarray, term: np.ndarray, seen: Counter | None) -> tuple[np.ndarray, list[tuple[int, float]]]:
        """Passages and (part, score) of all pairs that reach the part's threshold."""
        number = len(self.block_limit)
        hit = self.postings.sizes[term] > 0
        row, block = self.postings.of(term[hit])
        key = at[hit][row] * number + block
        met = np.unique(np.concatenate([key, key - number]))  # a segment is in its own passage and in the one before
        where, block = np.divmod(met[met >= 0], number)
        inside = np.zeros(has.rows + 1, bool)
        inside[passage] = True
        inside = inside[where]
        where, block = where[inside], block[inside]
        # block maxima over the terms of the passage
        bound = self.block_terms.sums(self.block_max, block, has, where)
        keep = bound + 1e-6 >= self.block_limit[block]
        if seen is not None:
            seen.update(passages=len(passage), met=len(block), kept=int(keep.sum()))
        where, block = where[keep], block[keep]
        part = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        where = np.repeat(where, BLOCK)[part < len(self.limit)]
        part = part[part < len(self.limit)]
        score = self.part_terms.sums(self.part_weights, part, has, where)
        good = score + 1e-9 >= self.limit[part]
        return where[good], list(zip(part[good].tolist(), score[good].tolist(), strict=True))

    def _verify(self, where: np.ndarray, found: list[tuple[int, float]], low: int, first: np.ndarray, lengths: np.ndarray, ids: np.ndarray, out: list[list[Match]]) -> None:
        texts = np.searchsorted(first, where + low, side="right") - 1
        begin = np.cumsum(lengths) - lengths
        for s, (part, score), text in zip((where + low).tolist(), found, texts.tolist(), strict=True):
            word, reach = (s - int(first[text])) * self.segment, self.reach[part]
            own = ids[begin[text] + max(0, word - reach) : begin[text] + min(int(lengths[text]), word + 2 * self.segment + reach)].tolist()
            item = self.words[self.item[part]].tolist()
            cut = max(1, len(item) - max(3, len(item) // 4))
            shares = []
            for side in (item[:cut], item[cut:] or item):
                grams = _grams(side)
                shares.append(len(grams & _grams(own, min(3, len(side)))) / len(grams))
            if min(shares) >= self.overlap:
                out[text].append(Match(self.ids[self.item[part]], score, float(self.own[part]), word, *shares))


class _Has:
    """Which term is in which passage of a step: a table with a column for each term that the step has, so its size follows the text and not the benchmark."""

    def __init__(self, at: np.ndarray, term: np.ndarray, rows: int, terms: int):
        self.rows = rows
        mark = np.zeros(terms, bool)
        mark[term] = True
        met = np.flatnonzero(mark)
        self.column = np.full(terms, len(met), np.int32)  # the last column is of no term
        self.column[met] = np.arange(len(met))
        self.table = np.zeros((rows + 1, len(met) + 1), bool)
        self.table[at, self.column[term]] = True
        self.table[:-1] |= self.table[1:]  # row s: the segments s and s + 1

    def of(self, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        return self.table[row, self.column[term]]


class _Lists:
    """Lists of numbers in one array."""

    def __init__(self, lists: list[list[int]], kind: type):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([v for x in lists for v in x], kind)

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all values of the lists asked for: which request, and the value's place."""
        n = self.sizes[which]
        row = np.repeat(np.arange(len(which)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - self.starts[which], n)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, place = self.places(which)
        return row, self.flat[place].astype(np.int64)

    def sums(self, weights: np.ndarray, which: np.ndarray, has: _Has, where: np.ndarray) -> np.ndarray:
        """Of each list asked for, the sum of the weights of its terms in the passage ``where``; in steps of bounded size."""
        total = np.zeros(len(which))
        if not len(which):
            return total
        upto = np.cumsum(self.sizes[which])
        cut = [0, *(np.searchsorted(upto, np.arange(1 << 20, int(upto[-1]), 1 << 20)) + 1).tolist(), len(which)]
        for a, b in zip(cut, cut[1:]):
            row, place = self.places(which[a:b])
            total[a:b] = np.bincount(row, weights[place] * has.of(where[a:b][row], self.flat[place]), b - a)
        return total


def shards(benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> Iterator[Index]:
    """Indexes over the whole benchmark, each of a bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\\s+"))).alias("words")).first()
    n = max(1, -(-size["n"] // (SHARD_ITEMS // 2)), -(-(size["words"] or 0) // (SHARD_WORDS // 2)))
    items = checkpoint(items) if n > 1 else items
    counts = checkpoint(_term_counts(items)) if n > 1 else None
    total = counts.where("term is null").first() if n > 1 else None
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        own = mine.toArrow()
        table = None
        if total:
            found = counts.join(_term_counts(mine).select("term"), "term", "left_semi").toArrow()
            table = Statistics(total["parts"], total["words"], total["longest"], dict(zip(found.column("term").to_pylist(), found.column("parts").to_pylist(), strict=True)))
        yield from (Index(x, share, overlap, table) for x in _bounded(sorted(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist(), strict=True), key=str)))


def _term_counts(items: DataFrame) -> DataFrame:
    """(term, parts, words, longest): in how many parts every term is; a null term for the parts, words and longest part of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [p for x in batch.column(0) for w in [words_of(x.as_py())] if w for p in _parts(w)]
            found = Counter(t for p in parts for t in set(p))
            none = [0] * len(found)
            numbers = [*found.values(), len(parts)], [*none, sum(map(len, parts))], [*none, max([0, *map(len, parts)])]
            yield pa.record_batch([pa.array([*found, None], pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], ["term", "parts", "words", "longest"])

    counts = items.select("text").mapInArrow(count, "term binary, parts long, words long, longest long")
    return counts.groupBy("term").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def _bounded(items: list[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str]]]:
    """Cut where a shard that a hash dealt unevenly would pass the bounds; a longer single item stands alone."""
    held, words = [], 0
    for item in items:
        size = len(words_of(item[1]))
        if held and (len(held) == SHARD_ITEMS or words + size > SHARD_WORDS):
            yield held
            held, words = [], 0
        held.append(item)
        words += size
    yield held


LEAK = "doc_id long, item_id long, score double, own_score double, word long, question_overlap double, answer_overlap double"


def _shared(docs: DataFrame, benchmark: DataFrame, share: float, overlap: float) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(x) for x in shards(benchmark, share, overlap)]


def _held(batches: Iterator[pa.RecordBatch], shared: list) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``HELD_BYTES`` together where there are several shards, so that a shard is not read for each batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if len(shared) == 1 or size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matches(held: list[pa.RecordBatch], at: int, shared: list) -> list[list[list[Match]]]:
    """For each batch and row, the best match of each item in all shards; one shard is in memory at a time."""
    found: list[list[list[Match]]] = [[[] for _ in range(batch.num_rows)] for batch in held]
    for one in shared:
        index = one.value
        for own, batch in zip(found, held, strict=True):
            for start, some in byte_chunks(batch.column(at)):
                for k, matches in enumerate(index.leaks(some), start):
                    own[k] += matches
        if len(shared) > 1:
            del index
            one.__dict__.pop("_value", None)  # read again from the executor's copy for the next documents
    if len(shared) > 1:
        found = [[list({m.item_id: m for m in sorted(o, key=lambda m: m.score)}.values()) for o in own] for own in found]
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, own_score, word, question_overlap, answer_overlap) of every verified pair; one pass over the documents."""
    shared = _shared(docs, benchmark, share, overlap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
        for held in _held(batches, shared):
            ids = [i for batch in held for i in batch.column(0).to_pylist()]
            matches = chain.from_iterable(_matches(held, 1, shared))
            rows = [(i, m.item_id, m.score, m.own_score, m.word, m.question, m.answer) for i, found in zip(ids, matches, strict=True) for m in found]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], [x.split()[0] for x in LEAK.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, LEAK)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """The rows without a verified match, all columns; one pass, no shuffle."""
    at = docs.columns.index("text")
    shared = _shared(docs, benchmark, share, overlap)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, shared):
            for batch, matches in zip(held, _matches(held, at, shared), strict=True):
                yield batch.filter(pa.array([not found for found in matches], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
