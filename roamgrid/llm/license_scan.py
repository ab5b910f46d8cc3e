"""Operator 13, licence scans by a positional index of rare tokens.

A template is a notice or the opening of a licence. Its words weigh by their inverse document frequency over the whole
corpus (counted for the templates' words only, a bounded vocabulary), and its highest-IDF words are its anchors, which are
all that the index holds: word -> (template, place). A file looks its licence words up; each posting votes for the place
where the template would begin, file place minus template place. Where at least ``VOTES`` of a template's anchors agree on
a beginning, up to ``SLACK`` words in between (a name or a year put in), the alignment is verified: every mandatory key
phrase must stand in the aligned stretch word by word, and words of at least ``COVER`` of the template's weight must stand
at their relative places. So the index decides where to look and the phrases what is a licence.

Base labels are found by their phrases alone, wherever they stand, and stay. ``score`` is the greatest verified share of a
template's weight; ``BASE_SCORE`` at least where a base phrase stands; 0 without labels.

Long texts are scanned in pieces that overlap by more than the longest template, so that every alignment is whole in one.
The index is of fixed size (some dozen templates); document frequencies are one row for each of its words.

Rows: null text counts as empty (no words, no labels, null places, score 0); repeated rows get equal results; ties of the
rarest words are broken by place; an empty table gives an empty result; other input columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, word_pieces

# The phrases of the base labels
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Label, notice or opening of the licence, and the phrases that must stand in it
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "associated documentation files", "sublicense and or sell copies"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0", "except in compliance with the license"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 2"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 3"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "with or without modification"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software", "with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ["dedicated the work to the public domain"]),
]
#: Anchors of a template, the share of them that must agree, words that may be put in, and the weight that must be in place.
ANCHORS, VOTES, SLACK, COVER = 6, 0.5, 6, 0.7
BASE_SCORE = 0.5
#: ASCII letters and digits stay, A-Z as a-z; other ASCII characters separate.
TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Index:
    """Templates, the weights of their words, and the postings of their anchors."""

    def __init__(self, frequency: dict[str, int], documents: int, templates: list[tuple[str, str, list[str]]] = TEMPLATES):
        self.labels = [label for label, _, _ in templates]
        self.words = [text.encode().split() for _, text, _ in templates]
        self.keys = [[f" {key} ".encode() for key in keys] for _, _, keys in templates]
        weight = lambda w: math.log((documents + 2) / (frequency.get(w.decode(), 0) + 1))
        self.weights = [[weight(w) for w in words] for words in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, (words, weights) in enumerate(zip(self.words, self.weights, strict=True)):
            anchors = sorted(range(len(words)), key=lambda p: (-weights[p], p))[:ANCHORS]
            self.needed.append(max(2, math.ceil(VOTES * len(anchors))))
            for p in anchors:
                self.postings[words[p]].append((t, p))
        self.idf = {w: weight(w) for w in self.postings}
        self.overlap = max(map(len, self.words)) + 3 * SLACK
        self.base = [(label, phrase.encode().split()) for label, phrase in BASE.items()]

    def beginnings(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, place): where enough anchors agree that it begins, at the least of their votes."""
        met = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                met[w].append(i)
        votes = defaultdict(list)
        for w in sorted(met, key=self.idf.__getitem__, reverse=True):  # rarest first
            for t, p in self.postings[w]:
                votes[t] += [(i - p, p) for i in met[w]]
        for t, own in votes.items():
            if len(own) < self.needed[t]:
                continue
            own.sort()
            inside: Counter = Counter()
            end, before = 0, None
            for start, (at, p) in enumerate(own):
                while end < len(own) and own[end][0] <= at + SLACK:
                    inside[own[end][1]] += 1
                    end += 1
                if at != before and len(inside) >= self.needed[t]:
                    yield t, at
                before = at
                inside[p] -= 1
                if not inside[p]:
                    del inside[p]

    def verified(self, words: list[bytes], t: int, at: int) -> float:
        """The share of a template's weight that is in place, or 0 if that or a key phrase falls short."""
        own = self.words[t]
        stretch = b" " + b" ".join(words[max(0, at) : at + len(own) + SLACK]) + b" "
        if not all(key in stretch for key in self.keys[t]):
            return 0.0
        place = lambda p: words[max(0, at + p) : max(0, at + p + SLACK + 1)]
        share = sum(x for p, (w, x) in enumerate(zip(own, self.weights[t], strict=True)) if w in place(p)) / sum(self.weights[t])
        return share if share >= COVER else 0.0

    def base_places(self, words: list[bytes], seen: int) -> Iterator[tuple[int, str]]:
        """Where a base phrase begins that does not end within the first ``seen`` words."""
        for label, phrase in self.base:
            for end, w in enumerate(words[seen:], seen + 1):
                if w == phrase[-1] and words[max(0, end - len(phrase)) : end] == phrase:
                    yield end - len(phrase), label

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        n = n_base = 0
        first = last = None
        base, labels, score = set(), set(), 0.0
        kept: list[bytes] = []
        for piece in word_pieces(text, TABLE):
            words, seen = kept + piece, len(kept)
            start = n - seen
            n += len(piece)
            for begin, label in self.base_places(words, seen):
                base.add(label)
                n_base += 1
                first = min(start + begin, first if first is not None else start + begin)
                last = max(start + begin, last if last is not None else start + begin)
            for t, begin in self.beginnings(words):
                if share := self.verified(words, t, begin):
                    labels.add(self.labels[t])
                    score = max(score, share)
            kept = words[-self.overlap :]
        if base:
            score = max(score, BASE_SCORE)
        return n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), min(1.0, score)


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many rows each word of the templates stands, and the number of rows: a row for each such word comes back."""
    wanted = {w for _, text, _ in TEMPLATES for w in text.encode().split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen: set[bytes] = set()
                for words in word_pieces(text.as_py() or b"", TABLE):
                    seen |= wanted.intersection(words)
                found.update(seen)
                found[b""] += 1
        yield pa.record_batch([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def scan_licenses(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row. No shuffle but the frequencies'."""
    index = index or Index(*document_frequencies(docs))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index.scan(text.as_py() or b"") for text in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return binary_text(docs).mapInArrow(scan, schema)
