"""Token ids of whole texts, word by word.

The vocabulary's pre-tokenizer drops white space and never joins what stands on both sides of it, so every run of ASCII
white space is a safe boundary: a text's ids are its words' ids in order. Words repeat (a corpus has far fewer distinct
words than words), so each worker keeps the ids of words it has met in a bounded cache and encodes only new ones, in
batches balanced by bytes. Only a part of the cache outlives a task; long texts are cut at white space and go piece by piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

#: Of each of two generations: when the young one is full it becomes the old one, and words met again return to the young.
#: Words of at most CACHED_BYTES stay, so a generation holds some 140 MB at most.
CACHE_WORDS = 600_000
KEPT_WORDS = 300_000
CACHED_BYTES = 48
BATCH_BYTES = 1 << 18
PIECE_BYTES = 1 << 19
MARK, BETWEEN, GROUP_WORDS = b"|", b" | ", 500
#: Special strings keep their case, and a mark (U+0300 to U+037F) behind a capital may combine otherwise than behind a small letter.
CASE_MATTERS = (b"<|", b"\xcc", b"\xcd")
ENDS = b".,"
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> list[bytes]:
    """Split at ASCII white space (the tokenizer sees to other white space inside a word); A-Z lower-cased as it does itself."""
    return (text if any(x in text for x in CASE_MATTERS) else text.lower()).split()


def pieces_of(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end before white space, where there is any."""
    at = 0
    while len(text) - at > size:
        space = _WHITE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def core(word: bytes) -> tuple[bytes, bytes]:
    """A word's part to encode and the full stops or commas behind it, encoded apart: an ASCII letter always ends a pre-token there."""
    stem = word.rstrip(ENDS)
    return (stem, word[len(stem) :]) if stem[-1:].isalpha() else (word, b"")


class WordEncoder:
    """Ids of words as little-endian unsigned 32-bit bytes, for tokenizers that drop white space and lower-case."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: Iterable[bytes]) -> Iterable[tuple[bytes, bytes]]:
        """In batches balanced by bytes, so that one call never holds more than a bounded number of ids, but for a long word."""
        held, size = [], 0
        for word in words:
            held.append(word)
            size += len(word) + 8
            if size >= BATCH_BYTES:
                yield from self._batch(held)
                held, size = [], 0
        if held:
            yield from self._batch(held)

    def _batch(self, words: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        """Words side by side with a mark between them, whose id tells where each ends; words that hold the mark, alone."""
        plain = [x for x in words if MARK not in x]
        groups = [plain[at : at + GROUP_WORDS] for at in range(0, len(plain), GROUP_WORDS)]
        texts = [BETWEEN.join(x).decode("utf-8", "replace") for x in groups]
        for group, code in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(code.ids, "<u4")
            ends = 4 * np.flatnonzero(ids == self.mark)
            packed = ids.tobytes()
            for word, start, end in zip(group, [0, *(ends + 4).tolist()], [*ends.tolist(), len(packed)], strict=True):
                yield word, packed[start:end]
        for word in words:
            if MARK in word:
                yield word, np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, words: set[bytes], found: dict[bytes, bytes]) -> set[bytes]:
        """The words still to encode; those of the old generation come back to ``found``."""
        rest = words.difference(found)
        back = set(filter(self.old.__contains__, rest))  # intersection() would walk through all of the old ones
        found.update(zip(back, map(self.old.__getitem__, back), strict=True))
        return rest - back

    def forget(self) -> None:
        """Drop the cache at a task's end, but for the words met first, which are the frequent ones."""
        self.young, self.old = dict(islice(self.young.items(), KEPT_WORDS)), {}

    def texts(self, texts: list[bytes]) -> Iterable[bytes]:
        """The ids of each text."""
        if len(texts) == 1:
            yield b"".join(x for piece in pieces_of(texts[0], PIECE_BYTES) for x in self._texts([piece]))
        else:
            yield from self._texts(texts)

    def _texts(self, texts: list[bytes]) -> Iterable[bytes]:
        split = [words_of(text) for text in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        found = self.young
        found[b""] = b""
        new = self._known(set().union(*split), found)
        ended = {word: core(word) for word in new if word[-1] in ENDS}
        stems = new.difference(ended).union(*ended.values())
        found.update(self._encode(self._known(stems, found)))
        for word, (stem, rest) in ended.items():
            found[word] = found[stem] + found[rest] if rest else found[stem]
        for words in split:
            yield b"".join(map(found.__getitem__, words))
        for word in [x for x in new | stems if len(x) > CACHED_BYTES]:
            found.pop(word, None)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process; the vocabulary file belongs to the installed package on every machine."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
