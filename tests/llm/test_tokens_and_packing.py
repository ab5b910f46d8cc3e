import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamgrid.llm import packing, token_count
from roamgrid.llm.tokens import WordEncoder

from .conftest import ROWS


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def words(vocabulary):
    return WordEncoder(vocabulary)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = ["", " ", "K. Å. İ., ǅ., ²., ½., Ⅷ., ͅ., a̸., ≮.", "a|b |c d| | || ,| |", "\x1c\x1f \x00 \x85 \xa0x", "‍ ́ ́|", "H̱ É É., ÉE É", "<|startoftext|> hi<|endoftext|> <|ENDOFTEXT|>., A<|endoftext|>.,", "a'll don't ,. a., 12., é., Σς ΑΣ", "'s|'t|'re", "Don'T x'S", "　b　.", "".join(map(chr, range(1, 600)))]


@pytest.mark.parametrize("text", HARD)
def test_word_by_word_equals_whole(tokenizer, words, text):
    for _ in range(2):  # new and from the cache
        assert np.frombuffer(next(iter(words.texts([text.encode()]))), "<u4").tolist() == ids_of(tokenizer, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbE.,|<> \n\t'sé̱́İ1½"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(tokenizer, words, text):
    assert np.frombuffer(list(words.texts([text.encode()]))[0], "<u4").tolist() == ids_of(tokenizer, text)


def test_long_texts_go_piece_by_piece(tokenizer, vocabulary, monkeypatch):
    from roamgrid.llm import tokens

    monkeypatch.setattr(tokens, "PIECE_BYTES", 50)
    text = "Some words, <|endoftext|> É a|b \n\n and so on. " * 40 + "x" * 300 + " end"
    pieces = list(tokens.pieces_of(text.encode(), 50))
    assert b"".join(pieces) == text.encode() and len(pieces) > 20
    (ids,) = tokens.WordEncoder(vocabulary).texts([text.encode()])
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_little_of_the_cache_outlives_a_task(vocabulary, monkeypatch):
    from roamgrid.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 10)
    words = tokens.WordEncoder(vocabulary)
    list(words.texts([b" ".join(b"w%d" % i for i in range(500))] * 2))
    assert len(words.young) > 400
    words.forget()
    assert len(words.young) == 10 and not words.old


def test_cache_generations(tokenizer, vocabulary, monkeypatch):
    import roamgrid.llm.tokens as module

    monkeypatch.setattr(module, "CACHE_WORDS", 5)
    small = WordEncoder(vocabulary)
    rnd = random.Random(3)
    for _ in range(50):
        texts = [" ".join(f"w{rnd.randint(0, 30)}{rnd.choice(['', '.', ','])}" for _ in range(8)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.texts([t.encode() for t in texts])] == [ids_of(tokenizer, t) for t in texts]
        assert len(small.young) < 200


def test_token_counts(odd, none, tokenizer, vocabulary):
    rows = token_count.with_limit(token_count.count_tokens(odd, vocabulary)).collect()
    expected = sorted((repr(i), len((t or "").encode()), len(ids_of(tokenizer, t))) for i, t in ROWS)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert token_count.count_tokens(none, vocabulary).collect() == []


def brute_best_fit(sizes, length):
    """One document after another, longest first, each into the fullest sequence that holds it."""
    room = []
    for size in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= size]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= size
        else:
            room.append(length - size)
    return len(room)


def check_packing(rows, length):
    places = {}
    for sequence, offset, size in rows:
        places.setdefault(sequence, []).append((offset, size))
    for parts in places.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(places)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200), st.sampled_from([50, 64, 100]))
def test_rounds_are_best_fit_decreasing(sizes, length):
    counts = {s: sizes.count(s) for s in set(sizes)}
    places = packing.best_fit_rounds(counts, length)
    piece = np.array(sorted(sizes))
    rank = np.concatenate([np.arange(counts[s]) for s in sorted(counts)])
    sequence, offset = places.find(piece, rank)
    assert check_packing(zip(sequence.tolist(), offset.tolist(), piece.tolist(), strict=True), length) == brute_best_fit(sizes, length)


def test_packing_documents(odd, none, tokenizer, vocabulary):
    packed = packing.pack_documents(odd, vocabulary, length=256, with_ids=True)
    rows = packed.collect()
    whole = {}
    for i, t in ROWS:
        whole.setdefault(i, []).append([*ids_of(tokenizer, t), 0])
    for r in rows:
        assert any(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() == r["ids"] for x in whole[r["doc_id"]]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["start"] == 256 * r["piece"]
    assert sum(r["length"] for r in rows) == sum(len(x) for v in whole.values() for x in v)
    n = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 256)
    assert n == brute_best_fit([r["length"] for r in rows], 256)
    assert sum(len(r["ids"]) // 4 for r in packing.sequences(packed).collect()) == sum(r["length"] for r in rows)
    assert packing.pack_documents(none, vocabulary).collect() == []
