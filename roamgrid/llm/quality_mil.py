"""Operator 3, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage (512 bytes of it; the last may be shorter) is encoded by its byte-class
and class-transition frequencies, repeated words and a learned layer; learned gated attention (tanh times sigmoid) weighs the passages,
and a logistic unit scores the weighted passage representation. Only document labels are learned from. Text alone is
looked at: labels, language, source and doc_id are no inputs of a score.

The model is fitted on the driver on at most ``TRAIN_DOCS`` labelled rows (those of least hashed doc_id) of at most
``TRAIN_BYTES`` bytes of text, with every passage of them; scoring covers every passage of every row, without a shuffle.
A text is encoded in pieces of ``PIECE`` bytes, so that a worker's memory depends little on the longest text.

Rows: null or empty text is one empty passage and gets a score; repeated rows get equal scores; with no usable label
the score is the smoothed mean label (0.5 without labels); an empty table gives an empty result; other input columns are
not read. A null doc_id counts as the empty string for the held-out split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, id_bucket

PASSAGE = 512
#: Whole passages together.
PIECE = 512 * PASSAGE
TRAIN_DOCS = 6000
TRAIN_BYTES = 1 << 15
HIDDEN, GATE = 24, 12
FOLDS = 5


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """A fine class of each byte (single lower-case letters and ASCII marks) and a coarse one."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for byte in range(256):
        char = chr(byte)
        if byte >= 128:
            fine[byte], coarse[byte] = 60 + (byte >> 5 & 3), 4
        elif char.islower():
            fine[byte], coarse[byte] = byte - 97, 0
        elif char.isupper():
            fine[byte], coarse[byte] = 26, 1
        elif char.isdigit():
            fine[byte], coarse[byte] = 27, 2
        elif char in " \t\r\f\v":
            fine[byte], coarse[byte] = 28, 3
        elif char == "\n":
            fine[byte], coarse[byte] = 29, 5
        elif char in ".,;:'-":
            fine[byte], coarse[byte] = 30 + byte % 30, 6
        else:
            fine[byte], coarse[byte] = 30 + byte % 30, 7
    return fine, coarse


FINE, COARSE = _classes()
WIDTH = 64 + 64 + 4


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, cut between passages, about ``PIECE`` bytes together."""
    held, size = [], 0
    for text in texts:
        for at in range(0, max(1, len(text)), PIECE):
            held.append(text[at : at + PIECE])
            size += len(held[-1])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def passages(texts: list[bytes]) -> np.ndarray:
    """How many passages each text has."""
    return np.array([max(1, -(-len(x) // PASSAGE)) for x in texts], np.int64)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, WIDTH) features and the number of passages of each text."""
    count = passages(texts)
    bytes_ = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(count) - count
    place = np.arange(len(bytes_)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.repeat(first, lengths) + place // PASSAGE
    total = int(count.sum())
    size = np.maximum(1, np.bincount(passage, minlength=total))[:, None]
    fine = np.bincount(passage * 64 + FINE[bytes_], minlength=total * 64).reshape(total, 64) / size
    coarse = COARSE[bytes_]
    same = passage[1:] == passage[:-1]
    steps = (passage[1:] * 64 + coarse[:-1] * 8 + coarse[1:])[same]
    step = np.bincount(steps, minlength=total * 64).reshape(total, 64) / size
    kinds = (fine > 0).sum(axis=1, keepdims=True) / 64
    echoes = np.array([_echoes(x[at : at + PASSAGE].lower().split()) for x in texts for at in range(0, max(1, len(x)), PASSAGE)])
    return np.concatenate([fine, step, kinds, np.log1p(np.bincount(passage, minlength=total))[:, None] / 8, echoes], axis=1).astype(np.float32), count


def _echoes(words: list[bytes]) -> tuple[float, float]:
    """Shares of words equal to the one before, and of distinct words."""
    return sum(map(eq, words, words[1:])) / max(1, len(words)), len(set(words)) / max(1, len(words))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each passage: its energy, representation, and the two sides of its gate."""
        w = self.weights
        hidden = np.tanh(((x - self.mean) / self.scale) @ w["encode"] + w["encode_0"])
        tanh, gate = np.tanh(hidden @ w["tanh"]), 1 / (1 + np.exp(-(hidden @ w["gate"])))
        return (tanh * gate) @ w["attend"], hidden, tanh, gate

    def pool(self, energy: np.ndarray, hidden: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: its probability and weighted representation; and the passages' weights."""
        w = self.weights
        starts = np.cumsum(count) - count
        energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), count))
        share = energy / np.repeat(np.add.reduceat(energy, starts), count)
        bag = np.add.reduceat(share[:, None] * hidden, starts, axis=0)
        return 1 / (1 + np.exp(-np.clip(bag @ w["out"] + w["out_0"], -30, 30))), bag, share

    def bags(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        energy, hidden, tanh, gate = self.attend(x)
        return *self.pool(energy, hidden, count), hidden, tanh, gate

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found = [self.attend(encode(x)[0])[:2] for x in pieces(texts)]
        return self.pool(*map(np.concatenate, zip(*found, strict=True)), passages(texts))[0].astype(np.float64)


def gradient(model: Model, x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss by every weight."""
    w = model.weights
    p, bag, share, hidden, tanh, gate = model.bags(x, count)
    wrong = ((p - label) / len(count)).astype(x.dtype)
    d_bag = np.repeat(wrong[:, None] * w["out"], count, axis=0)
    d_share = (d_bag * hidden).sum(axis=1)
    d_energy = share * (d_share - np.repeat(np.add.reduceat(share * d_share, np.cumsum(count) - count), count))
    d_tanh = d_energy[:, None] * w["attend"] * gate * (1 - tanh**2)
    d_gate = d_energy[:, None] * w["attend"] * tanh * gate * (1 - gate)
    d_hidden = (share[:, None] * d_bag + d_tanh @ w["tanh"].T + d_gate @ w["gate"].T) * (1 - hidden**2)
    return {"out": bag.T @ wrong, "out_0": wrong.sum(keepdims=True), "attend": (tanh * gate).T @ d_energy, "tanh": hidden.T @ d_tanh, "gate": hidden.T @ d_gate, "encode": ((x - model.mean) / model.scale).T @ d_hidden, "encode_0": d_hidden.sum(axis=0)}


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 40, batch: int = 128, rate: float = 0.01) -> Model:
    """Gradient descent (Adam) on the mean log loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    draw = np.random.default_rng(7)
    w = {name: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32) for name, shape in {"encode": (x.shape[1], HIDDEN), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,)}.items()}
    w |= {"encode_0": np.zeros(HIDDEN, np.float32), "out_0": np.zeros(1, np.float32)}
    model = Model(mean, scale, w)
    first, second, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    starts = np.cumsum(count) - count
    for _ in range(rounds):
        order = draw.permutation(len(count))
        for at in range(0, len(order), batch):
            bags = order[at : at + batch]
            n = count[bags]
            rows = np.repeat(starts[bags], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slope = gradient(model, x[rows], n, label[bags])
            t += 1
            for k, g in slope.items():
                g = g + 1e-4 * w[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, where: Column, most: int, bytes_: int = TRAIN_BYTES) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents of those with ``where``, by hashed doc_id, but for texts of over ``bytes_``; one label for each id."""
    one = labels.where(where & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.avg("quality").alias("label"))
    chosen = one.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    # ``most`` rows of two numbers: a proven bound
    rows = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= bytes_)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = TRAIN_DOCS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod ``folds`` is not 0."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((encode([text or b""])[0].tobytes(), label))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.float64())], ["x", "label"])

    sample = labelled_sample(docs, labels, id_bucket("doc_id", folds) != 0, most)
    rows = sample.mapInArrow(encoded, "x binary, label double").toArrow()
    label = rows.column("label").to_numpy()
    if len(np.unique(label >= 0.5)) < 2:
        return Model(np.zeros(1), np.ones(1), {}, float((label.sum() + 1) / (len(label) + 2)))
    x = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in rows.column("x").to_pylist()]
    return fit(np.concatenate(x), np.array([len(v) for v in x]), label.astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in byte_chunks(batch.column(1)):
                found = model.score(texts)
                yield pa.record_batch([batch.column(0).slice(start, len(texts)), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (id_bucket("doc_id", FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier accepts, all columns; no shuffle."""
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in byte_chunks(batch.column(at)):
                found = model.score(texts)
                yield batch.slice(start, len(texts)).filter(pa.array(found >= threshold))

    return docs.mapInArrow(good, docs.schema)
