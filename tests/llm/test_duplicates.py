import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from roamgrid.llm import line_dedup, simhash
from roamgrid.llm.components import components

from .conftest import PASSAGE, ROWS, documents


def brute_fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [re.sub(rb"[A-Z]", lambda m: m.group().lower(), w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    """Least doc_id that links reach, for (doc_id, fingerprint) rows."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
            root[find(j)] = find(i)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return [(d, f"{f & (1 << 64) - 1:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(prints)]


@pytest.mark.parametrize("text", [t for _, t in ROWS] + ["A b", "A B c", "a\x0bb\x1cc d é", "x " * 70_000])
def test_fingerprint(text):
    if len(text or "") < 200_000:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    expected = brute_components([(i, simhash.fingerprint((t or "").encode())) for i, t in ROWS], 3)
    assert sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in rows), key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(none).collect() == []


def test_keep_first(odd, none):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    # 2, 3, 4 and the null text are one group, and so are 1 and both rows of 6
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [1, 2, 5, 7, 8, 9, None, 10, 11, 12, 13]))
    assert simhash.keep_first(none).collect() == []


def planted(bits, seed, n=40, copies=12):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(copies):
            out.append(base)
            for b in rng.sample(range(64), rng.randint(0, bits + 2)):
                out[-1] ^= 1 << b
    return sorted(set(out))


@pytest.mark.parametrize(("bits", "number"), [(3, 5), (3, 6), (3, 8), (5, 7), (5, 9), (1, 5)])
def test_no_link_is_missed_by_the_keys(bits, number):
    fps = np.array(planted(bits, number), np.uint64)
    keys = simhash.meeting_keys(fps, simhash.Blocks(number, bits))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if int(fps[i] ^ fps[j]).bit_count() <= bits:
            assert (keys[i] == keys[j]).any()


@pytest.mark.parametrize(("bits", "tile"), [(3, 8192), (3, 4), (5, 8192), (5, 16)])
def test_links_reach_all_that_brute_force_reaches(spark, bits, tile):
    """A small tile deals every meeting out, as a very large one would be."""
    fps = planted(bits, tile)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.links(frame, bits, tile).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    assert all(int(unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= bits for r in found)
    roots = {unsigned(r["node"]): r["root"] for r in components(simhash.links(frame, bits, tile)).collect()}
    ours = {}
    for x in fps:
        ours.setdefault(roots.get(x, x - (1 << 64) if x >> 63 else x), set()).add(x)
    theirs = {}
    for i, (_, _, least) in enumerate(brute_components(list(enumerate(fps)), bits)):
        theirs.setdefault(least, set()).add(fps[i])
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(5, 5)], [(i, (i * 7 + 3) % 50) for i in range(0, 50, 2)]])
def test_components(spark, edges):
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert found == {x: find(x) for x in root if find(x) != x}


def units(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    at = [i for i, _ in pairs]
    assert all(a[i] == b[j] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs}) and at == sorted(set(at))
    rest = iter(b)
    assert all(a[i] in rest for i in at)  # a common subsequence
    if any(a.count(x) == b.count(x) == 1 for x in a):
        assert at


def test_patience_keeps_moved_blocks_apart():
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 1, 2, 8, 4, 5]) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert line_dedup.patience([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]


CLEAN = [(100 + i, "\n".join(" ".join(f"w{i}x{k}y{j}" for k in range(12)) + "." for j in range(6))) for i in range(5)]
SHARED = "\n".join(" ".join(f"common{j}n{k}" for k in range(18)) + "." for j in range(3))


def dedup(spark, rows):
    return {(r["doc_id"], i): r for i, r in enumerate(sorted(line_dedup.dedup_lines(documents(spark, rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}


def test_repeated_passage_stays_once(spark):
    rows = CLEAN + [(i, f"Its own beginning number {i} is here with words.\n{SHARED}\nIts own end {i} comes here now.") for i in range(1, 30)]
    found = {k[0]: r for k, r in dedup(spark, rows).items()}
    assert found[1]["text"] == dict(rows)[1]
    for i in range(2, 30):
        assert found[i]["text"] == f"Its own beginning number {i} is here with words.\nIts own end {i} comes here now."
    for i, t in CLEAN:
        assert found[i]["text"] == t and found[i]["__cut"] is None


def test_passage_inside_a_long_line(spark):
    found = {k[0]: r["text"] for k, r in dedup(spark, [(1, f"One begins. {PASSAGE} One ends."), (2, f"Two begins. {PASSAGE} Two ends.")]).items()}
    assert len(PASSAGE.split()) >= line_dedup.MIN_WORDS
    assert found == {1: f"One begins. {PASSAGE} One ends.", 2: "Two begins. Two ends."}


def brute_cuts(rows, min_words=None):
    """All pairs: every run of lines (blank ones aside) that an earlier document holds as a run and that reaches the minimum."""
    min_words = min_words or line_dedup.MIN_WORDS
    texts = {}
    for i, t in rows:
        own = [(k, x.strip()) for k, x in enumerate(units(t or "")) if x.strip()]
        texts[i] = own
    found = {}
    for i, own in texts.items():
        gone = set()
        for j, other in texts.items():
            if j >= i:
                continue
            places = {}
            for k, (_, x) in enumerate(other):
                places.setdefault(x, []).append(k)
            for a, (_, x) in enumerate(own):
                for c in places.get(x, ()):
                    if a and c and own[a - 1][1] == other[c - 1][1]:
                        continue  # not the run's begin
                    n = 0
                    while a + n < len(own) and c + n < len(other) and own[a + n][1] == other[c + n][1]:
                        n += 1
                    if sum(len(own[a + k][1].split()) for k in range(n)) >= min_words:
                        gone |= set(range(own[a][0], own[a + n - 1][0] + 1))
        found[i] = gone
    return found


@pytest.mark.parametrize("seed", range(3))
def test_cuts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}q{k}" for k in range(rng.randint(1, 12))) + "." for i in range(60)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(3, 20))] for _ in range(15)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.randint(0, 5)):
            run = rng.choice(runs)
            a = rng.randrange(len(run))
            text += run[a : a + rng.randint(1, 20)] + rng.choice([[], [""], [f"own {i} {len(text)}"]])
        rows.append((i, "\n".join(text)))
    found = {k[0]: r for k, r in dedup(spark, rows).items()}
    wanted = brute_cuts(rows)
    for i, t in rows:
        cut = set(found[i]["__cut"] or ())
        assert cut == wanted[i]
        assert "".join(x for k, x in enumerate(units(t)) if k not in cut) == found[i]["text"]
    assert sum(map(len, wanted.values())) > 100


def test_copies_of_short_lines_go(spark):
    text = "\n".join(f"a short line number{i}" for i in range(200))
    found = {k[0]: r["text"] for k, r in dedup(spark, [(1, text), (2, text)]).items()}
    assert found == {1: text, 2: ""}


def test_blocks_of_two_that_own_none_of_the_lines_go(spark):
    line = lambda i: " ".join(f"l{i}w{k}" for k in range(10))
    block = "\n".join(line(i) for i in range(5))
    rows = [(1, "\n".join(line(i) for i in reversed(range(5)))), (2, "its own\n" + block), (3, block + "\nanother own")]
    found = {k[0]: r["text"] for k, r in dedup(spark, rows).items()}
    assert found == {1: rows[0][1], 2: rows[1][1], 3: "another own"}


def test_lines_of_different_documents_make_no_block(spark):
    line = lambda i: " ".join(f"l{i}w{k}" for k in range(10))
    rows = [(i, line(i) + f"\nown end {i}") for i in range(5)] + [(9, "\n".join(line(i) for i in range(5)))]
    assert all(r["__cut"] is None for r in dedup(spark, rows).values())


def test_exact_copies_keep_the_first_only(spark):
    found = [r["text"] for r in dedup(spark, [(i, SHARED) for i in range(20)]).values()]
    assert found == [SHARED] + [""] * 19


def test_line_dedup_on_odd_rows(odd, none):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "__cut"] and found.count() == len(ROWS)
    same = {repr((i, t)) for i, t in ROWS if i not in (6, 12)}
    assert same <= {repr((r["doc_id"], r["text"])) for r in found.collect()}
    assert line_dedup.dedup_lines(none).collect() == []


def test_java_and_python_cut_alike(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = ["", "\n", "a\n", ". ", "a. ", "a.  b", "\r\n"] + ["".join(rng.choice("a.!? \n\r") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.split("t", line_dedup.CUT, -1).alias("x")).collect()
    assert all(r["x"] == units(r["t"]) for r in rows)


SHORT = "\n".join(f"item {i} costs {i * 7}" for i in range(30))


def test_passage_of_short_lines_stays_once(spark):
    rows = [(i, f"Its own beginning number {i} is here with words.\n{SHORT}\nIts own end {i} comes here now.") for i in range(1, 8)]
    found = {k[0]: r["text"] for k, r in dedup(spark, rows).items()}
    assert found == {i: t if i == 1 else f"Its own beginning number {i} is here with words.\nIts own end {i} comes here now." for i, t in rows}


def test_owner_of_one_line_hides_no_passage(spark):
    """Document 0 holds a single line of the passage; 1 holds all of it."""
    long = "this line is the only long one of the whole passage"
    found = {k[0]: r["text"] for k, r in dedup(spark, [(0, long + "\n"), (1, SHORT + "\n" + long), (2, SHORT + "\n" + long)]).items()}
    assert found == {0: long + "\n", 1: SHORT + "\n" + long, 2: ""}


def test_moved_passages_go(spark):
    other = SHORT.replace("item", "thing")
    found = {k[0]: r["text"] for k, r in dedup(spark, [(1, f"{SHORT}\n{other}"), (2, f"{other}\n{SHORT}")]).items()}
    assert found[2] == ""


def test_every_repeated_run_goes(spark):
    """Brute force: no run of lines of an earlier document that reaches the minimum is left whole or in part."""
    rng = random.Random(9)
    pool = [" ".join(f"p{i}q{k}" for k in range(rng.randint(1, 7))) for i in range(300)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(4):
            run = rng.choice(runs)
            a = rng.randrange(len(run))
            text += [*run[a : a + rng.randint(4, 30)], f"own {i} {len(text)}"]
        rows.append((i, "\n".join(text)))
    found = {k[0]: set(r["__cut"] or ()) for k, r in dedup(spark, rows).items()}
    seen, gone = set(), 0
    for i, t in rows:
        own = t.split("\n")
        runs_here = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1) if sum(len(x.split()) for x in own[a:b]) >= line_dedup.MIN_WORDS}
        for a, b in runs_here:
            if tuple(own[a:b]) in seen:
                assert found[i] >= set(range(a, b))
                gone += 1
        seen |= {tuple(own[a:b]) for a, b in runs_here}
    assert gone > 100


def test_very_long_texts(spark):
    """Half a million lines; a passage in the middle, and the whole as a copy."""
    lines = [f"line number {i} of the long text" for i in range(500_000)]
    passage = "\n".join(lines[250_000:250_020])
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, f"own begin\n{passage}\nown end")]
    found = {k[0]: r["text"] for k, r in dedup(spark, rows).items()}
    assert found == {1: rows[0][1], 2: "", 3: "own begin\nown end"}


def test_long_texts_of_repeated_lines(spark):
    """No line is alone in them, so that nothing but the stretches is common."""
    rng = random.Random(6)
    pool = [" ".join(f"p{i}q{k}" for k in range(5)) for i in range(12)]
    a, b = ([rng.choice(pool) for _ in range(20_000)] for _ in range(2))
    rows = [(1, "\n".join(a)), (2, "\n".join([*b[:10_000], *a[5_000:5_020], *b[10_000:]]))]
    found = {k[0]: set(r["__cut"] or ()) for k, r in dedup(spark, rows).items()}
    assert not found[1] and found[2] >= set(range(10_000, 10_020)) and len(found[2]) < 100


def test_a_line_and_a_passage_of_all_documents(spark):
    rows = [(i, f"own {i}\nall have this line\nown too {i}\n{SHORT if i % 2 else ''}\nend of {i}") for i in range(300)]
    found = {k[0]: r for k, r in dedup(spark, rows).items()}
    assert all(("item 3 costs" in found[i]["text"]) == (i == 1) and "all have this line" in found[i]["text"] for i in range(1, 300, 2))
    assert all(found[i]["__cut"] is None for i in range(0, 300, 2))


def naive_patience(a, b):
    """Anchors by the longest increasing run of lines that are single in both, found by trying all; then the gaps alike."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in naive_patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*naive_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    single = [(i, b.index(x)) for i, x in enumerate(a) if x is not None and a.count(x) == 1 and b.count(x) == 1]
    if not single:
        return []
    best: list = []
    runs = []
    for i, j in single:
        runs.append(max((r for r in runs if r[-1][1] < j), key=len, default=[]) + [(i, j)])
        best = max(best, runs[-1], key=len)
    i, j = best[0]
    return [*naive_patience(a[:i], b[:j]), (i, j), *((i + 1 + x, j + 1 + y) for x, y in naive_patience(a[i + 1 :], b[j + 1 :]))]


def passages(seed):
    """Rows whose passages are moved, repeated, broken and made of repeated lines."""
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}q{k}" for k in range(rng.randint(3, 12))) + "." for i in range(40)]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(4, 12))] for _ in range(8)] + [[rng.choice(pool)] * 15]
    rows = []
    for i in range(30):
        text = []
        for _ in range(rng.randint(1, 5)):
            block = rng.choice(blocks)
            a = rng.randrange(3)
            text += block[a:] + rng.choice([[], [f"own {i} {len(text)}"]])
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_cuts_equal_naive_patience_over_all_pairs(spark, seed):
    """No hashes of lines, no runs, no owners: every pair of documents aligned whole, again and again until no block comes."""
    rows, least = passages(seed), line_dedup.MIN_WORDS
    lines = {i: t.split("\n") for i, t in rows}
    found = {k[0]: set(r["__cut"] or ()) for k, r in dedup(spark, rows).items()}

    def blocks(aligned, own):
        begin = 0
        for k in range(1, len(aligned) + 1):
            if k == len(aligned) or aligned[k] != (aligned[k - 1][0] + 1, aligned[k - 1][1] + 1):
                block = range(aligned[begin][0], aligned[k - 1][0] + 1)
                if sum(len(own[x].split()) for x in block) >= least:
                    yield block
                begin = k

    def stretch_places(own):
        places = {}
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b].split())
                if n >= least:
                    places.setdefault(tuple(own[a : b + 1]), []).append((a, b))
                    break
        for b in range(len(own)):
            n = 0
            for a in range(b, -1, -1):
                n += len(own[a].split())
                if n >= least:
                    if (a, b) not in places.get(tuple(own[a : b + 1]), []):
                        places.setdefault(tuple(own[a : b + 1]), []).append((a, b))
                    break
        return places

    total = 0
    for i, own in lines.items():
        gone = set()
        for j in range(i):
            left = list(own)
            while more := list(blocks(naive_patience(left, lines[j]), own)):
                for block in more:
                    for x in block:
                        left[x] = None
                        gone.add(x)
            mine, theirs = stretch_places(own), stretch_places(lines[j])
            waiting = [x for x in mine if x in theirs]
            while waiting:  # one after the other is an alignment too, if the poorest
                for a, b in mine[waiting.pop()]:
                    gone |= set(range(a, b + 1))
        first = next(j for j in range(i + 1) if lines[j] == own)
        assert found[i] == (set(range(len(own))) if first < i else gone), i
        total += len(gone)
    assert total > 100


def test_without_patience_nothing_is_cut(spark, monkeypatch):
    rows = passages(5)
    blocks = [line_dedup.common_blocks(*(np.array(x) for x in ([1, 2, 3, 1], [20, 20, 20, 20], [9, 2, 3, 1], [20] * 4)), 40)]
    assert blocks == [[(1, 3)]]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.common_blocks(*(np.array(x) for x in ([1, 2, 3, 1], [20, 20, 20, 20], [9, 2, 3, 1], [20] * 4)), 40) == []
    assert rows


def test_passes_find_moved_turned_and_repeated_blocks():
    words = np.full(60, 50)
    order = list(range(100, 160))
    random.Random(3).shuffle(order)
    for ours in (list(range(100, 160))[::-1], order, [100] * 60, [100, 101] * 30):
        found = line_dedup.common_blocks(np.array(ours), words, np.arange(100, 160), words, 40)
        assert set().union(*(range(a, b + 1) for a, b in found)) == set(range(60))


def test_turned_documents_take_few_passes(monkeypatch):
    passes = []
    patience = line_dedup.patience
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: passes.append(1) or patience(a, b))
    n = 3000
    ours = np.arange(10, 10 + n)[::-1].copy()
    assert len(line_dedup.common_blocks(ours, np.full(n, 50), np.arange(10, 10 + n), np.full(n, 50), 1000)) == 0
    line_dedup.common_blocks(ours, np.full(n, 50), np.arange(10, 10 + n), np.full(n, 50), 40)
    assert len(passes) < 20


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, text, "x", 5, "h"), (2, text, "y", 6, "i"), (3, None, "z", 7, "j")], "doc_id long, text string, __cut string, __doc int, __hash string")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "___cut"]
    assert {r["doc_id"]: (r["__cut"], r["__doc"], r["__hash"], r["___cut"]) for r in found.collect()} == {1: ("x", 5, "h", None), 2: ("y", 6, "i", [0]), 3: ("z", 7, "j", None)}
    near = docs.withColumnsRenamed({"__doc": "__row_id", "__hash": "__row_hash"})
    assert {(r["doc_id"], r["__row_id"], r["__row_hash"]) for r in simhash.keep_first(near).collect()} == {(1, 5, "h"), (3, 7, "j")}
