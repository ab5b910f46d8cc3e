"""Operator 7, personal data: base patterns and a skip-chain conditional random field.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern and check. The field's nodes are the
base's finds, every run of grouped digits, and every other word of the document with a digit, an @ or a written-out mark
such as [at]. Its labels are the base's kinds, secrets (access tokens, keys) and none. Neighbouring nodes share a chain
potential; nodes that repeat the same or a similar token anywhere in the document (the same last seven digits, whatever
stands between them; the same mailbox, with or without its host, whatever the case and the mark between them; the same
long token) share a skip potential. Loopy sum-product message passing over all nodes gives each node's label, so that entity labels become
consistent over the document. A node that the base left out is added where its label's probability reaches
``THRESHOLD``. Base finds keep their label.

Weights are learned here by pseudo-likelihood on at most ``TRAIN_DOCS`` documents (least hashed doc_id). Labels are the
base's finds, tokens that a text assigns to a name such as token or password, and, since the base knows only well-formed
ones, the finds once more in disguise (other separators, written-out marks, no country sign), each in a graph of its own.
Everything else is none. Evidence and shape are hidden at random, so that shape, chain and repetition get their weights.
A third graph of a text repeats its finds far behind it as echoes that have nothing of their own to be known by (a local
number, the end of a card number, a mailbox), among twice as many tokens of the same shape that repeat nothing, or one
another, and are none: what tells them apart is the skip potential alone.

Rows: null text counts as empty and has no spans; repeated rows get equal results; without training examples nothing is
added; an empty table gives an empty result; other input columns are not read. Places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
SECRET = 4
#: Texts of over TRAIN_BYTES are not learned from; spans are found in whole texts whatever their length.
TRAIN_DOCS = 8000
TRAIN_BYTES = 1 << 15
THRESHOLD = 0.6
#: Times that a text's finds are heard again in the graph of its echoes.
ECHOES = 4
ROUNDS = 12
REACH = 40
_ANY = re.compile(r"[0-9@]")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]|[\[(](?:at|dot|\.)[\])]")
_GROUPED = re.compile(r"(?<![0-9A-Za-z.+])\+?\(?[0-9][0-9().\x20-]{5,24}[0-9](?![0-9A-Za-z])")
_NAME = re.compile(r"[a-z0-9._%+-]*[0-9][a-z0-9._%+-]*")
_ASSIGNED = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_/+.=-]{16,})")
_BEFORE = re.compile(r"(\w{1,24})[\"']?[\x20\t]*([:=])[\x20\t]*[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = []
    if not _ANY.search(text):
        return found
    last = at = 0
    while (at := text.find("@", max(at, last))) >= 0:
        start = at
        while start > last and _MAILBOX.match(text, start - 1):
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            found.append((start, 0, m.end()))
            last = m.end()
        at += 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


WIDTH = 64
EVIDENCE = WIDTH - len(KINDS)


def _plain(token: str) -> str:
    """Written-out marks as the marks that they stand for."""
    return re.sub(r"[\[(](at|dot|\.)[\])]", lambda m: "@" if m[1] == "at" else ".", token)


def _features(text: str, start: int, end: int, kind: int) -> np.ndarray:
    """Shape of a token and what stands before it, and in the last places what the base says."""
    token = text[start:end]
    plain = _plain(token)
    x = np.zeros(WIDTH, np.float32)
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    only = _DIGIT.sub("", token)
    x[0] = 1
    x[1] = "@" in plain
    x[2 + int(np.searchsorted([1, 4, 7, 8, 10, 14, 17, 20], digits, side="right"))] = 1
    x[12 + min(4, plain.count("."))] = 1
    x[17], x[18], x[19] = "+" in token, "(" in token, "-" in token
    x[20], x[21] = letters > 0, letters > digits
    x[22 + min(3, len(token) // 8)] = 1
    x[26] = 14 <= len(only) <= 19 and not letters and luhn(only)
    x[27] = bool(re.fullmatch(r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}", plain))
    x[28] = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", plain))
    x[29] = len(token) >= 16 and letters > 0 and digits > 0 and token.isalnum()
    x[30] = bool(re.fullmatch(r"[0-9a-fA-F]{16,}", token)) and letters > 0 and digits > 0
    x[31] = plain != token
    x[32], x[33] = start > 0 and text[start - 1] in "\"'", bool(re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", token))
    x[34] = bool(re.fullmatch(r"\+?[0-9]{1,4}[\x20.-]\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", token))
    x[35], x[36] = not letters and digits in (10, 11), " " in token
    if m := _BEFORE.search(text, max(0, start - 32), start):
        x[37] = 1
        x[38 + hashlib.sha256(m[1].casefold().encode()).digest()[0] % 16] = 1
    if kind >= 0:
        x[EVIDENCE + kind] = 1
    return x


def _keys(token: str) -> list[str]:
    """What repeated or similar tokens share."""
    token = _plain(token).strip(".,;:!?\"'<>()[]#*$%&").casefold()
    mailbox, at, host = token.partition("@")
    if at:
        return [f"{mailbox}@{host.split('.')[0]}", f"@{mailbox}"] if mailbox and host else []
    if any(c.isalpha() for c in token):
        # a mailbox alone, or one before a mark that is none of those known
        alone = _NAME.match(token)
        return [token] * (len(token) >= 16) + ([f"@{alone[0]}"] if alone and len(alone[0]) >= 5 else [])
    digits = _DIGIT.sub("", token)
    return [digits[-7:]] if len(digits) >= 7 else []


def nodes(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Nodes (start, end, kind or -1) in order, and edges (node, node, 0 for chain or 1 for skip)."""
    found = [(s, e, k) for s, k, e in base]

    def free(spans: list[tuple[int, int, int]], candidates: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The candidates that meet no span."""
        starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))
        return [(a, b, -1) for a, b in candidates if a < b and not ((i := bisect_left(starts, b)) and ends[i - 1] > a)]

    grouped = [(m.start(), m.end()) for m in _GROUPED.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 15 and re.search(r"[\x20(]", m.group())]
    found = sorted(found + free(found, grouped))
    words, at = [], 0
    for m in _MARK.finditer(text):  # each word with a digit, an @ or a written-out mark, once
        if m.start() < at:
            continue
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\r\f\v":
            start -= 1
        word = _WORD.match(text, start)
        at = word.end()
        token = word.group()
        left = len(token) - len(token.lstrip("\"'<[#*$%&,;:!?"))
        words.append((start + left, start + len(token.rstrip(".,;:!?\"'<>)]#*$%&"))))
    found = sorted(found + free(found, words))
    edges = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= REACH]
    seen: dict[str, int] = {}
    for i, (s, e, _) in enumerate(found):
        for key in _keys(text[s:e]):
            if key in seen and (not edges or edges[-1] != (seen[key], i, 1)):
                edges.append((seen[key], i, 1))
            seen[key] = i
    return found, edges


def disguised(kind: int, token: str, draw: random.Random) -> str:
    """A find as the base doesn't know it."""
    digits = _DIGIT.sub("", token)
    if kind == 0:
        mailbox, _, host = token.partition("@")
        return draw.choice([f"{mailbox}[at]{host}", f"{mailbox}(at){host}", f"{mailbox}[at]{host.replace('.', '[dot]')}", f"{mailbox}@{host.split('.')[0]}"])
    if kind == 1:
        return token.replace(".", draw.choice(["[.]", "(.)", "[dot]"]))
    if kind == 2:
        return draw.choice([".", "/", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return draw.choice([token.lstrip("+"), "({}) {}-{}".format(*last), "{}-{}-{}".format(*last), "{}.{}.{}".format(*last)])


def echo(kind: int, token: str) -> str | None:
    """What is left of a find when it is mentioned again: nothing that a pattern could know."""
    digits = _DIGIT.sub("", token)
    if kind == 0:
        mailbox = token.partition("@")[0]
        return mailbox if len(mailbox) >= 5 and re.search("[0-9]", mailbox) else None
    return {1: token.replace(".", "-") if len(digits) >= 7 else None, 2: digits[-8:], 3: digits[-7:]}[kind]


def lookalike(token: str, draw: random.Random) -> str:
    """Another token of the same shape."""
    return "".join(draw.choice("123456789") if c.isdigit() else draw.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in token)


class Field:
    """Label 0 is none, the others the kinds. Weights: (label, feature); chain and skip: (label, label)."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.pair = weights, np.stack([chain, skip])

    def marginals(self, x: np.ndarray, edges: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Loopy belief propagation; known labels (0: unknown) are held."""
        local = x @ self.weights.T
        held = known > 0
        local[held] = -30
        local[held, known[held]] = 0
        if not len(edges):
            return _softmax(local)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        half = len(edges)
        potential = self.pair[edges[:, 2]]
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        messages = np.zeros((2 * half, local.shape[1]))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, messages)
            cavity = belief[source] - messages[back]
            new = cavity[:, :, None] + potential
            top = new.max(axis=1)
            new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if moved < 1e-4:
                break
        belief = local.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, edges: np.ndarray, label: np.ndarray, rounds: int = 2000, rate: float = 2.0, decay: float = 2e-4) -> Field:
    """Pseudo-likelihood: each node's label given its neighbours' labels.

    A third of the nodes are seen whole, a third without the base's evidence and a third without their shape as well, so
    that each sort of potential has to explain labels alone.
    """
    n, k = len(x), len(KINDS) + 1
    view = np.random.default_rng(7).integers(0, 3, n)
    x = x.copy()
    x[view > 0, EVIDENCE:] = 0
    x[view > 1, 1:] = 0
    one = np.eye(k)[label]
    near = np.zeros((2, n, k))
    for kind in (0, 1):
        own = edges[edges[:, 2] == kind]
        np.add.at(near[kind], own[:, 0], one[own[:, 1]])
        np.add.at(near[kind], own[:, 1], one[own[:, 0]])
    weights, pair = np.zeros((k, WIDTH)), np.zeros((2, k, k))
    for _ in range(rounds):
        wrong = (_softmax(x @ weights.T + near[0] @ pair[0].T + near[1] @ pair[1].T) - one) / n
        weights -= rate * (wrong.T @ x + decay * weights)
        for kind in (0, 1):
            slope = wrong.T @ near[kind]
            pair[kind] -= rate * ((slope + slope.T) / 2 + decay * pair[kind])
    weights[:, EVIDENCE:] = 0  # at work the finds are held, and what the base left out has no evidence
    return Field(weights, *pair)


def _graph(texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' base spans; features, edges, base labels and spans of all nodes, with each node's text."""
    bases, x, edges, label, places = [], [], [], [], []
    for at, text in enumerate(texts):
        base = base_spans(text)
        bases.append(base)
        if not _MARK.search(text):
            continue
        found, own = nodes(text, base)
        edges += [(a + len(x), b + len(x), t) for a, b, t in own]
        for s, e, kind in found:
            x.append(_features(text, s, e, kind))
            label.append(kind + 1)
            places.append((at, s, e))
    return bases, np.array(x, np.float32).reshape(-1, WIDTH), np.array(edges, np.int64).reshape(-1, 3), np.array(label, np.int64), np.array(places, np.int64).reshape(-1, 3)


def _examples(text: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Graphs (features, edges, labels) to learn from: the text's own, and one with each find in disguise."""
    bases, x, edges, label, places = _graph([text])
    if not len(x):
        return []

    def assigned(text: str, places: np.ndarray, label: np.ndarray) -> None:
        secrets = {m.start(1): m.end(1) for m in _ASSIGNED.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])}
        for i, (_, s, e) in enumerate(places.tolist()):
            if label[i] == 0 and secrets.get(s) == e:
                label[i] = SECRET + 1

    assigned(text, places, label)
    found = [(x, edges, label)]
    draw = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    if bases[0]:
        other, spans, end = "", [], 0
        for s, k, e in bases[0]:
            if s >= end:
                other += text[end:s]
                spans.append((len(other), k))
                other += disguised(k, text[s:e], draw)
                spans[-1] += (len(other),)
                end = e
        other += text[end:]
        _, x, edges, label, places = _graph([other])
        assigned(other, places, label)
        for i, (_, s, e) in enumerate(places.tolist()):
            for a, k, b in spans:
                if s < b and e > a:
                    label[i] = k + 1
        found.append((x, edges, label))
    if heard := [(k, e) for s, k, e in ((s, k, echo(k, text[s:e])) for s, k, e in bases[0]) if e] * ECHOES:
        other, spans = text, []
        for kind, token in draw.sample(heard, len(heard)):
            no = lookalike(token, draw)
            mentions = [(kind + 1, token), (0, no), (0, draw.choice([no, lookalike(token, draw)]))]
            for label_, said in draw.sample(mentions, 3):
                other += draw.choice([" Then there was ", " and so on, ", "\n"]) + "more of the same " * 4
                spans.append((len(other), len(other) + len(said), label_))
                other += said
        _, x, edges, label, places = _graph([other])
        assigned(other, places, label)
        for i, (_, s, e) in enumerate(places.tolist()):
            for a, b, k in spans:
                if s < b and e > a:
                    label[i] = k
        found.append((x, edges, label))
    return found


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Field | None:
    rows = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).select(F.col("doc_id").cast("long").alias("own"), "text")
    chosen = rows.select(F.col("own").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(most)
    # ``most`` ids: a proven bound
    sample = rows.join(F.broadcast(chosen), F.col("own") == F.col("chosen")).select("text")

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [g for v in batch.column(0) for g in _examples(v.as_py() or "")]
            yield pa.record_batch([pa.array([g[k].astype(t).tobytes() for g in rows], pa.binary()) for k, t in enumerate(("u1", "<i8", "<i8"))], ["x", "edges", "label"])

    rows = sample.mapInArrow(graph, "x binary, edges binary, label binary").toArrow().to_pylist()
    x, edges, label, n = [], [], [], 0
    for r in sorted(rows, key=lambda r: hashlib.sha256(r["x"] + r["label"]).digest()):  # the same order in every run
        x.append(np.frombuffer(r["x"], "u1").reshape(-1, WIDTH).astype(np.float32))
        own = np.frombuffer(r["edges"], "<i8").reshape(-1, 3).copy()
        own[:, :2] += n
        edges.append(own)
        label.append(np.frombuffer(r["label"], "<i8"))
        n += len(x[-1])
    if not n or not np.concatenate(label).any():
        return None
    return fit(np.concatenate(x), np.concatenate(edges), np.concatenate(label))


def added_spans(texts: list[str], field: Field | None, threshold: float = THRESHOLD) -> tuple[list, list]:
    """The base's spans of each text and those that the field adds."""
    bases, x, edges, label, places = _graph(texts)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if field is None or not len(x):
        return bases, added
    x[:, EVIDENCE:] = 0
    p = field.marginals(x, edges, label)
    best = p[:, 1:].argmax(axis=1) + 1
    for i in np.flatnonzero((label == 0) & (p[np.arange(len(p)), best] >= threshold)):
        at, s, e = places[i].tolist()
        added[at].append((s, int(best[i]) - 1, e))
    return bases, added


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, base, n_email, n_ip, n_card, n_phone, spans, n_added, n_secret, n_spans) of every row; base and spans as kind:start:end; n_email to n_phone count the base's. No shuffle."""
    names = ["doc_id", "base", *(f"n_{k}" for k in BASE_KINDS), "spans", "n_added", "n_secret", "n_spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(x.as_py() for x in batch.column(1)):
                bases, added = added_spans(texts, field)
                counts = [[sum(k == kind for _, k, _ in b) for b in bases] for kind in range(len(BASE_KINDS))]
                spans = [sorted(b + a) for b, a in zip(bases, added, strict=True)]
                more = [len(a) for a in added], [sum(k == SECRET for _, k, _ in a) for a in added], [len(x) for x in spans]
                numbers = [pa.array(x, pa.int64()) for x in (*counts, *more)]
                yield pa.record_batch([batch.column(0).slice(start, len(texts)), pa.array(map(_join, bases), pa.string()), *numbers[:4], pa.array(map(_join, spans), pa.string()), *numbers[4:]], names)

    schema = ", ".join(f"{n} {'string' if n in ('base', 'spans') else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)
