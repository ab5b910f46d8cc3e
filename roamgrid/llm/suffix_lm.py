"""Operator 6, language-model scoring with a probabilistic suffix tree that grows with the corpus.

Tokens are words and one end for each text. A context (a node of the tree) is a run of up to ``depth`` preceding words of
the text. It is a candidate if training texts have it at least ``SUPPORT`` times, whatever the size of the corpus, and is
retained if its suffix (the context one word shorter) is and its next-word counts diverge from what the suffix predicts
(likelihood-ratio test: twice the count times the KL divergence against the spread expected by chance). Its next-word
distribution gives every word w that follows at least ``SUPPORT`` times (n(w) + T p(w)) / (N + T), with N the context's
count, T how many different words follow it and p the suffix's distribution; all other words have the suffix's
probability, scaled so that everything sums to one. A place is scored from the longest retained context (suffix state).

The tree is never in one place. All places whose nearest context word is the same meet in one bucket, which holds the
whole subtree of that word: it is learned there, and the bucket's places are scored there. Places travel as packed
columns, one block for each chunk of texts and bucket. A bucket has about ``BUCKET_PLACES`` places; a word more frequent
than that is split by the word before it, and its own node (depth one) is counted over the corpus before and given to its
buckets. Scores go back to the chunks as one block for each bucket.

Symbols are the ranks of the ``HEAD`` most frequent words and a 32-bit digest of every other word. Two words of one digest
share their places in contexts (as one in four thousand does with a million words outside the head); counts, base scores
and unigram probabilities are of the exact words. A word outside the head that its context has seen has its probability from
the counts alone: its unigram share there, less than a millionth of it, is left out.

Exact counts of words outside the head are joined by word, once for each chunk that has it; the head has words of at most
``HEAD_BYTES`` bytes, so a frequent longer word makes a row for each chunk, and the join can be split where it is skewed.

Rows: null text counts as empty (just the end); repeated rows count and score as rows of their own; a null doc_id counts
as the empty string for the split; with no training rows all counts are 0; an empty table gives an empty result; other
input columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_chunks, binary_text, id_bucket, store

FOLDS = 10
#: Ids below IDS are ranks of head words.
IDS = 1 << 18
HEAD = 262_000
HEAD_BYTES = 64
#: No word: in front of a text.
NONE = 0xFFFFFFFF
DEPTH = 2
SUPPORT = 2
ADD = 0.1
BUCKET_PLACES = 2_000_000
#: No word holds a line feed.
END = b"\n"
HELD_COUNTS = 500_000
CHUNK_TEXT = 2 << 20
#: The highest bit of a document's number in its chunk marks a training document.
TRAIN = 1 << 15


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for ids, texts in binary_chunks(batch):
                for text in texts:
                    held.update(text.lower().split())
                held[END] += len(ids)
                if len(held) >= HELD_COUNTS:
                    yield from _counted(held)
                    held = Counter()
        yield from _counted(held)

    return binary_text(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    words, numbers = list(held), list(held.values())
    for at in range(0, len(words), 1 << 16):
        yield pa.record_batch([pa.array(words[at : at + (1 << 16)], pa.binary()), pa.array(numbers[at : at + (1 << 16)], pa.int64())], ["word", "n"])


class Words:
    """The head words by falling count: ids, counts and base log probabilities; and what is known of all other words together."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, kinds: int):
        self.tokens, self.kinds = tokens, kinds
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        self.end = self.ids[END]
        self.total = tokens + ADD * (kinds + 1)
        self.count = np.zeros(IDS, np.int64)
        self.count[: len(head)] = [n for _, n in head]
        self.base = (self.count + ADD) / self.total
        left = kinds - int((self.count > 0).sum())
        #: Average probability of a word outside the head.
        self.other = ((tokens - int(self.count.sum())) / left + ADD if left > 0 else ADD) / self.total

    def probability(self, ids: np.ndarray) -> np.ndarray:
        """Unigram; the average for words outside the head."""
        return np.where(ids < IDS, self.base[np.minimum(ids, IDS - 1)], self.other)


def symbol(word: bytes) -> int:
    """Of a word outside the head."""
    return IDS + zlib.crc32(word) % (NONE - IDS)


class Buckets:
    """Where places go, by the two nearest words before them."""

    def __init__(self, words: Words, places: int):
        self.number = max(1, -(-words.tokens // places))
        self.parts = np.maximum(1, -(-words.count // places))
        self.hot = np.flatnonzero(self.parts > 1)
        self.first = np.zeros(IDS, np.int64)
        self.first[self.hot] = self.number + np.cumsum(self.parts[self.hot]) - self.parts[self.hot]
        self.last = self.number + int(self.parts[self.hot].sum())

    def of(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        mix = lambda x, n: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.asarray(n, np.uint64)).astype(np.int64)
        low = np.minimum(c1, IDS - 1)
        split = (c1 < IDS) & (self.parts[low] > 1)
        return np.where(split, self.first[low] + mix(c2, self.parts[low]), mix(c1, self.number))


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones: high bytes are mostly equal and shrink well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def grouped(high: np.ndarray, low: np.ndarray, highs: int, lows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number the pairs of (high, low) in their order: the number at each place, the distinct pairs' high, and a place of each pair.

    Pair and place are packed into one number where they fit, which sorts many times faster than places alone.
    """
    n = len(high)
    place, below = max(1, n - 1).bit_length(), max(1, lows - 1).bit_length()
    keys = high.astype(np.uint64) << np.uint64(below) | low.astype(np.uint64)
    if place + below + max(1, highs - 1).bit_length() <= 64:
        keys = np.sort(keys << np.uint64(place) | np.arange(n, dtype=np.uint64))
        order = (keys & np.uint64((1 << place) - 1)).astype(np.int64)
        keys >>= np.uint64(place)
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    number = np.empty(n, np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return number, (keys[new] >> np.uint64(below)).astype(np.int64), order[new]


def _near(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols with those outside the head numbered behind it, and how many numbers there are."""
    outside = symbols >= IDS
    kinds, number = np.unique(symbols[outside], return_inverse=True)
    found = symbols.astype(np.int32)
    found[outside] = IDS + number
    return found, IDS + len(kinds)


def unplaned(data: memoryview | bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


ENCODED = "docs binary, train binary, sizes binary, known binary, base binary, first binary, ids binary, tail_docs binary, tail_places binary, symbols binary, words array<binary>"


def encode(docs: DataFrame, shared, folds: int) -> DataFrame:
    """Texts by chunks: of every document its id, part, size, known words and base score in the head; symbols of all tokens; and the words outside the head, each once, with the documents they are in."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            start = 0
            for doc_ids, texts in binary_chunks(batch, CHUNK_TEXT):
                split = [t.lower().split() for t in texts]
                sizes = np.array([len(w) + 1 for w in split], np.int32)
                ends = np.cumsum(sizes, dtype=np.int64) - 1
                ids, inside = np.empty(int(sizes.sum()), "<u4"), np.ones(int(sizes.sum()), bool)
                ids[ends], inside[ends] = words.end, False
                ids[inside] = np.fromiter(map(words.ids.get, chain.from_iterable(split), repeat(NONE)), "<u4", len(ids) - len(sizes))
                head = ids != NONE
                doc = np.repeat(np.arange(len(sizes)), sizes)
                count = lambda x: np.bincount(doc, x, len(sizes))  # noqa: E731,B023
                low = np.where(head, ids, 0)
                known = count(head & (words.count[low] > 0)).astype("<i4")
                log_p = np.where(head, np.log10(words.base[low]), 0.0)
                base, first = count(log_p), log_p[ends - sizes + 1]
                flat = list(chain.from_iterable(w + [END] for w in split))
                tail = np.flatnonzero(~head)
                kinds: dict[bytes, int] = {}
                place = np.array([kinds.setdefault(flat[i], len(kinds)) for i in tail.tolist()], "<u4")
                if len(tail):
                    ids[tail] = np.array([symbol(w) for w in kinds], "<u4")[place]
                numbers = np.array([(i is not None, i or 0) for i in doc_ids], "<i8")
                train = np.asarray(batch.column(2).slice(start, len(texts)).to_numpy(zero_copy_only=False), bool)
                blobs = [numbers.tobytes(), train.tobytes(), sizes.tobytes(), known.tobytes(), base.tobytes(), first.tobytes(), planes(ids), planes(doc[tail].astype("<u2")), planes(place), np.array([symbol(w) for w in kinds], "<u4").tobytes()]
                yield pa.record_batch([*(pa.array([x], pa.binary()) for x in blobs), pa.array([list(kinds)], pa.list_(pa.binary()))], [x.split()[0] for x in ENCODED.split(", ")])
                start += len(texts)

    rows = binary_text(docs).withColumn("train", id_bucket("doc_id", folds) != 0)
    return rows.mapInArrow(encoded, ENCODED)


def _places(ids: np.ndarray, sizes: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """For each token the words one, two and more before it, NONE in front of its text."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = []
    for back in range(1, depth + 1):
        before = np.full(len(ids), NONE, "<u4")
        before[back:] = ids[:-back]
        before[at < back] = NONE
        found.append(before)
    return found


BLOCK = "bucket long, chunk long, n long, places binary, given binary"


def deal(chunks: DataFrame, shared, depth: int) -> DataFrame:
    """The places of every chunk by bucket, packed: contexts, next word, document."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, buckets = shared.value
        packer = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for chunk, ids, sizes, train in zip(*batch.columns, strict=True):
                ids, sizes = unplaned(ids.as_py(), "<u4"), np.frombuffer(sizes.as_py(), "<i4")
                doc = np.repeat((np.arange(len(sizes)) | TRAIN * np.frombuffer(train.as_py(), bool)).astype("<u2"), sizes)
                before = _places(ids, sizes, max(2, depth))
                use = np.flatnonzero(before[0] != NONE)
                bucket = buckets.of(before[0][use], before[1][use])
                # by bucket and nearest word: equal ones side by side shrink well
                place = max(1, len(use) - 1).bit_length()
                if buckets.last.bit_length() + 32 + place <= 64:
                    keys = np.sort((bucket.astype(np.uint64) << np.uint64(32) | before[0][use]) << np.uint64(place) | np.arange(len(use), dtype=np.uint64))
                    order = (keys & np.uint64((1 << place) - 1)).astype(np.int64)
                else:
                    order = np.lexsort((before[0][use], bucket))
                use, bucket = use[order], bucket[order]
                columns = [x[use] for x in (*before[:depth], ids, doc)]
                edge = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
                blocks = [packer.compress(b"".join(planes(x[a:b]) for x in columns), asbytes=True) for a, b in zip(edge, edge[1:])]
                keys = bucket[edge[:-1]]
                yield pa.record_batch([pa.array(keys), pa.array(np.full(len(keys), chunk.as_py())), pa.array(np.diff(edge)), pa.array(blocks, pa.binary()), pa.nulls(len(keys), pa.binary())], [x.split()[0] for x in BLOCK.split(", ")])

    return chunks.select("chunk", "ids", "sizes", "train").mapInArrow(dealt, BLOCK)


def hot_nodes(chunks: DataFrame, shared) -> DataFrame:
    """Rows as of ``deal`` that give every bucket of a split word that word's node: its next words and their probabilities."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buckets = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for ids, sizes, train in zip(*batch.columns, strict=True):
                ids, sizes = unplaned(ids.as_py(), "<u4"), np.frombuffer(sizes.as_py(), "<i4")
                before = _places(ids, sizes, 1)[0]
                use = np.repeat(np.frombuffer(train.as_py(), bool), sizes) & (before < IDS)
                use[use] = buckets.parts[before[use]] > 1
                held.append(np.unique(before[use].astype(np.uint64) << np.uint64(32) | ids[use], return_counts=True))
                if sum(len(k) for k, _ in held) >= HELD_COUNTS:
                    yield from _keyed(held)
                    held = []
        if held:
            yield from _keyed(held)

    def node(key: tuple, table: pa.Table) -> pa.Table:
        words, buckets = shared.value
        word = key[0].as_py()
        next_, n = table.column("next").to_numpy().astype(np.uint32), table.column("n").to_numpy()
        order = np.argsort(next_)
        level = _distributions(np.zeros(len(n), np.int64), n[order], np.array([words.count[word]]), words.probability(next_[order]))
        some = level.stored & level.retained[0]
        rest = level.rest[0] if level.retained[0] else 1.0
        data = planes(next_[order][some].astype("<u4")), np.concatenate([[rest, level.retained[0]], level.p[some]]).tobytes()
        keys = buckets.first[word] + np.arange(buckets.parts[word])
        same = lambda x, kind: pa.array([x] * len(keys), kind)
        return pa.table([pa.array(keys), same(-1, pa.int64()), same(int(some.sum()), pa.int64()), same(data[0], pa.binary()), same(data[1], pa.binary())], [x.split()[0] for x in BLOCK.split(", ")])

    counts = chunks.select("ids", "sizes", "train").mapInArrow(count, "word long, next long, n long").groupBy("word", "next").agg(F.sum("n").alias("n"))
    return counts.groupBy("word").applyInArrow(node, BLOCK)


def _keyed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)
    columns = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(NONE)).astype(np.int64), n
    for start in range(0, len(keys), 1 << 16):
        yield pa.record_batch([pa.array(x[start : start + (1 << 16)]) for x in columns], ["word", "next", "n"])


class _distributions:
    """Of contexts: which next words are stored and their probabilities, what is left to the suffix, and which are retained.

    Given are, for each pair of a context and a next word, the context, the count and the suffix's probability; and the
    contexts' counts.
    """

    def __init__(self, context: np.ndarray, n: np.ndarray, total: np.ndarray, below: np.ndarray):
        size = len(total)
        of = lambda x: np.bincount(context, x, size)
        kinds = of(n > 0)
        self.stored = n >= SUPPORT
        self.p = np.where(self.stored, (n + kinds[context] * below) / (total[context] + kinds[context]), 0.0)
        given, taken, known = of(self.p), of(np.where(self.stored, below, 0.0)), of(np.where(self.stored, n, 0))
        self.rest = np.maximum(1 - given, 1e-12) / np.maximum(1 - taken, 1e-12)
        # the test looks at the stored words and at all others as one
        gain = of(np.where(self.stored, n * np.log(np.maximum(n, 1) / (total[context] * below)), 0.0))
        left = total - known
        gain += np.where(left > 0, left * np.log(np.maximum(left, 1) / np.maximum(total * (1 - taken), 1e-9)), 0.0)
        number = of(self.stored)
        self.retained = (number > 0) & (2 * gain > number + 3 * np.sqrt(2 * np.maximum(number, 1)))


def learn_and_score(contexts: list[np.ndarray], next_: np.ndarray, train: np.ndarray, words: Words, given: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each place of a bucket, and whether its next word was stored in a retained context.

    ``given``: the node of depth one where it is known already, as (next words, [rest, retained, probabilities]).
    """
    p = words.probability(next_)
    seen = np.zeros(len(next_), bool)
    near, nexts = _near(next_)
    active, state, states = np.arange(len(next_)), np.zeros(len(next_), np.int32), 1
    for depth, symbols in enumerate(contexts, 1):
        inside = symbols[active] != NONE
        active, state = active[inside], state[inside]
        if not len(active):
            break
        if depth == 1 and given is not None:
            known, numbers = given
            if not numbers[1]:
                break
            at = np.minimum(np.searchsorted(known, next_), max(0, len(known) - 1))
            hit = known[at] == next_ if len(known) else np.zeros(len(next_), bool)
            p = np.where(hit, numbers[2:][at] if len(known) else 0.0, numbers[0] * p)
            seen |= hit
            continue
        own, owns = _near(symbols[active])
        context, size = own, owns
        if states > 1:
            context, _, pairs = grouped(state, own, states, owns)
            size = len(pairs)
        total = np.bincount(context[train[active]], minlength=size)
        enough = total[context] >= SUPPORT
        active, context = active[enough], context[enough]
        if not len(active):
            break
        pair, of, first = grouped(context, near[active], size, nexts)
        n = np.bincount(pair[train[active]], minlength=len(of))
        level = _distributions(of, n, total, p[active[first]])
        kept = level.retained[context]
        active, state, pair, states = active[kept], context[kept], pair[kept], size
        stored = level.stored[pair]
        p[active] = np.where(stored, level.p[pair], level.rest[state] * p[active])
        seen[active] |= stored
    return np.log10(p), seen


def score_buckets(blocks: DataFrame, shared, depth: int) -> DataFrame:
    """(chunk, docs, sums, tail_docs, tail_symbols): of each bucket and chunk the documents' log probabilities, and the seen words outside the head."""

    def scored(table: pa.Table) -> pa.Table:
        words, _ = shared.value
        given, chunks, columns = None, [], [[] for _ in range(depth + 2)]
        packer = pa.Codec("zstd")
        for chunk, n, data, numbers in zip(*(table.column(c) for c in ("chunk", "n", "places", "given")), strict=True):
            n = n.as_py()
            if numbers.is_valid:
                given = unplaned(data.as_py(), "<u4"), np.frombuffer(numbers.as_py(), np.float64)
                continue
            data = memoryview(packer.decompress(data.as_buffer(), (4 * depth + 6) * n))
            chunks.append((chunk.as_py(), n))
            for k, column in enumerate(columns):
                column.append(unplaned(data[4 * k * n : min(len(data), 4 * (k + 1) * n)], "<u4" if k <= depth else "<u2"))
        *contexts, next_, doc = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in columns)
        columns.clear()
        log_p, seen = learn_and_score(contexts, next_, (doc & TRAIN) > 0, words, given)
        outside = next_ >= IDS
        # the exact unigram probability of an unseen word outside the head comes later
        log_p -= np.where(outside & ~seen, np.log10(words.other), 0.0)
        doc = doc & (TRAIN - 1)
        out: list[list] = [[] for _ in range(5)]
        start = 0
        for chunk, n in chunks:
            own = slice(start, start + n)
            sums = np.bincount(doc[own], log_p[own])
            docs = np.unique(doc[own])
            tail = np.flatnonzero(outside[own] & seen[own]) + start
            for column, value in zip(out, (chunk, docs.astype("<u2").tobytes(), sums[docs].astype("<f4").tobytes(), doc[tail].astype("<u2").tobytes(), next_[tail].tobytes()), strict=True):
                column.append(value)
            start += n
        return pa.table([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["chunk", "docs", "sums", "tail_docs", "tail_symbols"])

    return blocks.groupBy("bucket").applyInArrow(scored, "chunk long, docs binary, sums binary, tail_docs binary, tail_symbols binary")


def head_words(counts: DataFrame, size: int = HEAD) -> Words:
    """The most frequent words (a fixed number of bounded length) and the totals."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kinds")).first()
    top = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(size).toArrow()
    head = list(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    if END not in dict(head):
        found = counts.where(F.col("word") == F.lit(END)).first()
        head.append((END, found["n"] if found else 0))
    return Words(head, totals["n"], totals["kinds"])


def score(docs: DataFrame, folds: int = FOLDS, bucket_places: int = BUCKET_PLACES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    counts = store(word_counts(docs.where(id_bucket("doc_id", folds) != 0)), "words", "zstd")
    words = head_words(counts)
    buckets = Buckets(words, bucket_places)
    shared = docs.sparkSession.sparkContext.broadcast((words, buckets))
    encoded = encode(docs, docs.sparkSession.sparkContext.broadcast(words), folds)
    chunks = store(encoded.withColumn("chunk", F.monotonically_increasing_id()), "encoded", "zstd")
    blocks = deal(chunks, shared, depth)
    if len(buckets.hot):
        blocks = blocks.unionByName(hot_nodes(chunks, shared))
    scored = score_buckets(blocks, shared, depth).groupBy("chunk").agg(F.collect_list(F.struct("docs", "sums", "tail_docs", "tail_symbols")).alias("scored"))
    tail = chunks.select("chunk", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
    tail = tail.groupBy("chunk").agg(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"))).alias("tail"))
    whole = chunks.select("chunk", "docs", "train", "sizes", "known", "base", "first", "tail_docs", "tail_places", "symbols").join(scored, "chunk", "left").join(tail, "chunk", "left")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                yield _result(words, {n: c[row] for n, c in zip(batch.schema.names, batch.columns, strict=True)})

    return whole.drop("chunk").mapInArrow(result, schema)


def _result(words: Words, chunk: dict[str, pa.Scalar]) -> pa.RecordBatch:
    raw = lambda name, kind: np.frombuffer(chunk[name].as_py(), kind)
    numbers, train, sizes = raw("docs", "<i8").reshape(-1, 2), raw("train", bool), raw("sizes", "<i4")
    known, base = raw("known", "<i4").astype(np.int64), raw("base", np.float64)
    log_p = raw("first", np.float64).copy()  # without a context
    seen: list[np.ndarray] = []
    for bucket in chunk["scored"].as_py() or ():
        log_p[np.frombuffer(bucket["docs"], "<u2")] += np.frombuffer(bucket["sums"], "<f4")
        seen.append(np.frombuffer(bucket["tail_docs"], "<u2").astype(np.int64) << 32 | np.frombuffer(bucket["tail_symbols"], "<u4"))
    symbols = raw("symbols", "<u4").astype(np.int64)
    n = np.zeros(len(symbols), np.int64)
    if chunk["tail"].is_valid:
        lists = chunk["tail"].values
        n[lists.field("place").to_numpy()] = lists.field("n").to_numpy()
    docs, place = unplaned(chunk["tail_docs"].as_py(), "<u2").astype(np.int64), unplaned(chunk["tail_places"].as_py(), "<u4")
    log_tail = np.log10((n + ADD) / words.total)[place] if len(place) else np.zeros(0)
    known = known + np.bincount(docs, n[place] > 0, len(sizes)).astype(np.int64) if len(place) else known
    whole = base + np.bincount(docs, log_tail, len(sizes))
    # seen words outside the head have their probability from their contexts
    left = np.ones(len(place), bool)
    if seen and len(place):
        own = docs << 32 | symbols[place]
        keys, times = np.unique(np.concatenate(seen), return_counts=True)
        order = np.argsort(own, kind="stable")
        begin = np.searchsorted(own[order], keys)
        taken = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        left[order[taken]] = False
    log_p += np.bincount(docs[left], log_tail[left], len(sizes))
    ids = pa.array(numbers[:, 1], pa.int64(), mask=numbers[:, 0] == 0)
    columns = [ids, pa.array(~train), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(sizes), words.tokens)), pa.array(whole), pa.array(log_p)]
    return pa.record_batch(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
