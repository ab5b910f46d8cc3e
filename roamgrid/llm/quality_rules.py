"""Operator 8, quality rules: document statistics, base rules and gradient-boosted trees over the statistics.

The trees are grown here (histograms, second-order logistic loss) with monotonic constraints: more symbols, more
duplicate lines, more repeated windows or more capitals never raise a score. They are flattened into numpy node arrays
and all rows of a batch walk all trees at once. They are fitted on at most ``TRAIN_DOCS`` labelled rows of at most 32 KB of
text (``quality_mil.TRAIN_BYTES``; least hashed doc_id, and crc32(doc_id) mod 5 not 0, so that a fifth stays for measuring); statistics cover every row and whole texts.

Rows: null text has no words, so base_failed is true and kept false; repeated rows get equal results; without usable
labels the base rules alone decide; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, binary_text, id_bucket, word_pieces
from .quality_mil import labelled_sample

TRAIN_DOCS = 6000
FOLDS = 5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\f\v"
_SAME = bytes(range(256))
#: Windows handled together.
STEP = 1 << 16
NAMES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "wide", "distinct", "line_words", "shouts")
#: -1: the score may not rise with the feature.
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 0, 0, 0, 0, -1])
_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(WINDOW)], np.uint64)


def windows(hashes: np.ndarray) -> np.ndarray:
    """A hash of every 8 words, of the hashes of all words."""
    rolled = np.zeros(max(0, len(hashes) - WINDOW + 1), np.uint64)
    for low in range(0, len(rolled), STEP):
        own = hashes[low : low + STEP + WINDOW - 1]
        own = own ^ (own >> np.uint64(29))
        for i in range(WINDOW):
            rolled[low : low + STEP] += own[i : len(own) - WINDOW + 1 + i] * _MIX[i]
    return rolled


def repeated_words(text: bytes, rolled: np.ndarray) -> int:
    """Words inside 8-word windows that occur at least twice in the text; ``rolled`` are the windows' hashes."""
    order = np.argsort(rolled)
    next_same = np.zeros(len(rolled), bool)  # of places in the order
    for low in range(0, len(rolled), STEP):
        own = rolled[order[low : low + STEP + 1]]
        next_same[low : low + len(own) - 1] = own[1:] == own[:-1]
    if not next_same.any():
        return 0
    starts = word_starts(text)
    window = lambda at: text[starts[at] : starts[at + WINDOW]]
    twice = np.zeros(len(rolled), bool)
    bad: set[int] = set()
    for low in range(0, len(rolled), STEP):  # equal hashes are compared as words
        some = np.flatnonzero(next_same[low : low + STEP]) + low
        for a, b in zip(order[some].tolist(), order[some + 1].tolist(), strict=True):
            if (x := window(a)) == (y := window(b)) or x.split() == y.split():
                twice[a] = twice[b] = True
            else:
                bad.add(int(rolled[a]))
    for value in bad:  # different windows of one hash
        groups: dict[tuple, list[int]] = {}
        for at in np.flatnonzero(rolled == np.uint64(value)).tolist():
            groups.setdefault(tuple(window(at).split()), []).append(at)
        for group in groups.values():
            twice[group] = len(group) > 1
    covered = np.zeros(len(rolled) + WINDOW - 1, bool)
    for i in range(WINDOW):
        covered[i : i + len(rolled)] |= twice
    return int(covered.sum())


def word_starts(text: bytes) -> np.ndarray:
    """Where each word begins, and the text's end."""
    space = np.zeros(256, bool)
    space[list(WHITE)] = True
    found, before = [], True
    for low in range(0, len(text), PIECE_BYTES):
        own = space[np.frombuffer(text, np.uint8, min(PIECE_BYTES, len(text) - low), low)]
        found.append((np.flatnonzero(~own & np.concatenate([[before], own[:-1]])) + low).astype(np.uint32))
        before = bool(own[-1])
    return np.concatenate([*found, np.array([len(text)], np.uint32)])


def distinct(values: np.ndarray) -> int:
    values = np.sort(values)
    return int((values[1:] != values[:-1]).sum()) + min(1, len(values))


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one. Lines are held as 128-bit digests."""
    digests, start = bytearray(), 0
    while start < len(text):
        end = text.find(b"\n", min(len(text), start + PIECE_BYTES))
        end = len(text) if end < 0 else end
        for line in text[start:end].split(b"\n"):
            if line and not line.isspace():
                digests += xxhash.xxh3_128_digest(line)
        start = end + 1
    pairs = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    if distinct(pairs[:, 0]) == len(pairs):
        return len(pairs), 0
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return len(pairs), int((pairs[1:] == pairs[:-1]).all(axis=1).sum())


def statistics(text: str | bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features. Words are held as 64-bit hashes."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    seen = np.zeros(256, np.int64)
    for low in range(0, len(raw), PIECE_BYTES):
        seen += np.bincount(np.frombuffer(raw, np.uint8, min(PIECE_BYTES, len(raw) - low), low), minlength=256)
    n_lines, dup = repeated_lines(raw)
    hashes = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(hash, x), np.int64, len(x)) for x in word_pieces(raw, _SAME))]).view(np.uint64)
    n, kinds, rolled = len(hashes), distinct(hashes), windows(hashes)
    del hashes
    repeat = repeated_words(raw, rolled)
    del rolled
    symbols = int(seen[list(SYMBOLS)].sum())
    # code points begin with any byte but 80 to BF
    chars = len(raw) - int(seen[128:192].sum()) - int(seen[list(WHITE)].sum())
    of = lambda a, b: float(seen[a:b].sum())
    each, letters = max(1, n), max(1, chars)
    marks = of(33, 48) + of(58, 65) + of(91, 97) + of(123, 127)
    features = [float(np.log1p(n)), chars / each, symbols / each, dup / max(1, n_lines), repeat / each, of(65, 91) / letters, of(48, 58) / letters, marks / letters, of(128, 256) / letters, kinds / each, n / max(1, n_lines), float(seen[33]) / each]
    return n, chars, symbols, dup, repeat, features


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(np.take_along_axis(x, self.feature[at], axis=1) <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 2.0, decay: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    nodes: list[list] = []  # feature, limit, left, right, value
    roots = []
    mean = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), base)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + decay), low, high))
        nodes.append([0, 0.0, at, at, rate * value])
        best = (1e-6, None)
        if level < depth:
            for j, e in enumerate(edges):
                gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))
                hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                wl, wr = np.clip(-gl / (hl + decay), low, high), np.clip(-gr / (hr + decay), low, high)
                loss = lambda w, a, b: -(a * w + 0.5 * (b + decay) * w * w)
                gain = loss(wl, gl, hl) + loss(wr, gr, hr) - loss(value, gs[-1], hs[-1])
                gain[(hl < least) | (hr < least) | (MONOTONE[j] * (wr - wl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (j, k, wl[k], wr[k]))
        if best[1] is None:
            margin[rows] += rate * value
            return at
        j, k, wl, wr = best[1]
        middle = (wl + wr) / 2
        inside = binned[rows, j] <= k
        bounds = {0: (low, high, low, high), -1: (middle, high, low, middle), 1: (low, middle, middle, high)}[int(MONOTONE[j])]
        left = node(rows[inside], g, h, level + 1, *bounds[:2])
        right = node(rows[~inside], g, h, level + 1, *bounds[2:])
        nodes[at][:4] = [j, float(edges[j][k]), left, right]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node(np.arange(len(x)), p - label, np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
    feature, limit, left, right, value = zip(*nodes, strict=True)
    return Trees(np.array(roots), np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(value), base, depth)


def _rows(texts: Iterator[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(x or b"") for x in texts]
    return np.array([r[:5] for r in found], np.int64).reshape(-1, 5), np.array([r[5] for r in found], np.float64).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Trees | None:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(v.as_py() for v in batch.column(0))[1]
            yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1)], ["x", "label"])

    sample = labelled_sample(docs, labels, id_bucket("doc_id", FOLDS) != 0, most)
    rows = sample.mapInArrow(features, "x binary, label double").toArrow()
    label = rows.column("label").to_numpy()
    if len(np.unique(label >= 0.5)) < 2:
        return None
    return grow(np.stack([np.frombuffer(v) for v in rows.column("x").to_pylist()]), label)


def apply_rules(docs: DataFrame, trees: Trees | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = _rows(v.as_py() for v in batch.column(1))
            failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
            score = trees.score(x) if trees else np.ones(len(x))
            columns = [pa.array(c, pa.int64()) for c in counts.T] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.record_batch([batch.column(0), *columns], names)

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names[1:6]) + ", base_failed boolean, score double, kept boolean"
    return binary_text(docs).mapInArrow(ruled, schema)
