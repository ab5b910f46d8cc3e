"""Very long texts go by pieces: bounded memory, equal results."""

import random
import subprocess
import sys

import numpy as np
import pytest

from roamgrid.llm import decontam, quality_rules, simhash

from .conftest import ROWS

HEAD = """
import random, resource
rng = random.Random(1)
line = lambda: " ".join(f"word{rng.randrange(100000)}" for _ in range(12)) + ".\\n"
some = "".join(line() for _ in range(40_000))
"""
TEXTS = {"repeated": "(some * 12)[: 32 << 20]", "prose": "some + ''.join(line() for _ in range(300_000))", "one word": "'x' * (32 << 20)", "short lines": "'a b\\nc d\\n' * (1 << 21)"}
CALLS = {
    "fingerprint": "from roamgrid.llm.simhash import fingerprint as f",
    "statistics": "from roamgrid.llm.quality_rules import statistics as f",
    "leaks": "from roamgrid.llm.decontam import Index\nindex = Index([(i, line() * 8) for i in range(2000)])\nf = lambda text: index.leaks([text])",
}


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("call", CALLS)
def test_memory(call, text):
    """32 MB of text in a process of its own."""
    code = f"{HEAD}\n{CALLS[call]}\ntext = ({TEXTS[text]}).encode()\nf(text[:1000])\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nf(text)\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 200


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "b", "Éé", "CD", "#", "x" * 40, "\x1c", "中文"]
    yield from (t or "" for _, t in ROWS if len(t or "") < 3000)
    for n in (1, 2, 3, 8, 9, 40, 200):
        for _ in range(6):
            yield "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t\n", "\r"]) for _ in range(n))


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_change_nothing(monkeypatch, size):
    some = list(texts(size))
    items = [(i, " ".join(t.split()[:30])) for i, t in enumerate(some)]
    of = lambda: ([simhash.fingerprint(t.encode()) for t in some], [quality_rules.statistics(t) for t in some], decontam.Index(items).leaks(some))
    whole = of()
    for module in ("common.pieces", "common.word_pieces"):
        name = module.split(".")[1]
        for user in (simhash, quality_rules, decontam):
            if hasattr(user, name):
                own = getattr(user, name)
                monkeypatch.setattr(user, name, (lambda own: lambda text, table=None: own(text, table, size))(own))
    monkeypatch.setattr(quality_rules, "PIECE_BYTES", size)
    pieced = of()
    assert pieced[0] == whole[0] and pieced[2] == whole[2]
    assert all(a[:5] == b[:5] and np.allclose(a[5], b[5]) for a, b in zip(pieced[1], whole[1]))


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """All windows get one hash: only those of equal words count."""
    monkeypatch.setattr(quality_rules, "_MIX", np.zeros(8, np.uint64))
    same = "a b c d e f g h"
    for text, expected in ((f"{same} i j k {same}", 16), (f"{same} i j k l m n", 0), (f"{same}\n{same}  {same}", 24), (f"{same} x {same} y z {same}", 24)):
        assert quality_rules.statistics(text)[4] == expected


@pytest.mark.parametrize("cells", [40, 1 << 12, 1 << 23])
def test_size_of_the_table_of_terms_changes_nothing(monkeypatch, cells):
    rng = random.Random(cells)
    some = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    items = [(i, " ".join(t.split()[5:60])) for i, t in enumerate(some[::3])]
    index = decontam.Index([x for x in items if x[1]])
    whole = index.leaks(some)
    monkeypatch.setattr(decontam, "CELLS", cells)
    assert index.leaks(some) == whole and sum(map(bool, whole)) >= len([x for x in items if x[1]])


def test_shards_are_read_once_for_many_batches(monkeypatch):
    import pyarrow as pa

    index = decontam.Index([(1, "one item of some words that is found"), (2, "another item with other words in it")])
    reads = []

    class Shared:
        def __init__(self, value):
            self._value = None
            self.own = value

        @property
        def value(self):
            reads.append(1)
            return self.own

    batches = [pa.record_batch([pa.array([k]), pa.array(["see: one item of some words that is found" if k % 2 else "nothing"])], ["doc_id", "text"]) for k in range(20)]
    shared = [Shared(index), Shared(index)]
    found = [m for held in decontam._held(iter(batches), shared) for own in decontam._matches(held, 1, shared) for m in own]
    assert len(reads) == 2 and [bool(m) for m in found] == [bool(k % 2) for k in range(20)]
    monkeypatch.setattr(decontam, "HELD_BYTES", 1)
    assert [len(held) for held in decontam._held(iter(batches), shared)] == [1] * 20
