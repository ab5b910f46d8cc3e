"""Operators 11 to 13 against SQL and brute force."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

from roamgrid.llm import divergence, filter_audit, license_scan, queries
from roamgrid.llm.common import word_pieces
from tests.conftest import same_rows

from .conftest import ROWS, documents

CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_filter_audit"])
def test_equal_to_sql(spark, name):
    same_rows(queries.queries()[name](spark, "/root/testdata/sf0.01"), queries.oracle_sql()[name], "/root/testdata/sf0.01")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_words_are_never_cut(size):
    for text in (b"", b" ", b"one", b" one  two\n\nthree four\tfive ", b"x" * 50 + b" y", b" " + b"z" * 30):
        assert [w for p in word_pieces(text, bytes(range(256)), size) for w in p] == text.split()


# ---- operator 11


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def brute_divergence(rows, min_docs, top):
    """rows: (lang, source, text)."""
    rows = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    found = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        frequency = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in frequency.items() if n >= min_docs]
        count = {s: Counter(t for _, source, terms in own if source == s for t in terms) for s in {r[1] for r in own}}
        everywhere = sum(count.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(everywhere)
        for s in count:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)]
    return sorted(found)


ODD = [
    ("en", "a", "The cat, the CAT and 7 cats"), ("en", "a", None), ("en", "b", "the dog ÀÉ dog"), ("en", "b", ""), ("en", None, "The dog the cat"), (None, "a", "été ÉTÉ the"),
    (None, None, "the the été"), ("xx", "only", "123 --- 456"), ("xx", "none", None), ("yy", "one", "alone alone"), ("en", "a", "The cat, the CAT and 7 cats"), ("en", "", "cat"), ("en", "c", "𝒳 cat 𝒳"),
]


def frame(spark, rows):
    from pyspark.sql import functions as F

    clash = ["term", "n", "docs", "held", "groups", "terms", "total", "floor", "rank", "value", "item", "part", "a", "b", "x", "p", "places"]
    return spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("x") for c in clash})


@pytest.mark.parametrize(("min_docs", "top"), [(1, 50), (2, 2), (3, 1), (99, 50)])
def test_divergence_is_brute_force(spark, min_docs, top):
    found = divergence.audit(frame(spark, ODD), min_docs, top)
    assert sorted(map(tuple, found.collect())) == brute_divergence(ODD, min_docs, top)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "string", "string", "bigint", "int"]


def test_divergence_of_many_sources(spark):
    rows = [("en", f"s{i % 23}", " ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 11)}" for j in range(1 + i % 40))) for i in range(400)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), 5, 7).collect())) == brute_divergence(rows, 5, 7)


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    """Flushing after every text changes nothing."""
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    assert sorted(map(tuple, divergence.audit(frame(spark, ODD), 2, 9).collect())) == brute_divergence(ODD, 2, 9)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**13 + 7, 3 * 10**14 + 1, 10**8), (0, 0, 1), (5, 5, 1)]
    found = spark.createDataFrame(rows, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in found] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]


def test_pairs_are_summed_before_the_shuffle(spark):
    """The contributions meet a partial aggregation, and a group's terms are cut to the report's length before they are dealt."""
    plan = divergence.audit(frame(spark, ODD), 1)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(value" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- operator 12


def brute_audit(rows, labels):
    """rows: (doc_id, source, text); labels: (doc_id, quality, toxic)."""
    docs = []
    for i, source, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows),
        ]
        said = [any(j == i and i is not None and (j, q, t)[k] == 1 for j, q, t in labels) for k in (1, 2)]
        docs.append((source or "", {"ABCDE"[k] for k in range(5) if fails[k]}, *said))
    found = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for _, fails, _, _ in own:
                if hit := next((x for x in order if x in fails), None):
                    shapley[hit] += 1
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d in own if x in d[1] and not d[1] & before]
                found.append((
                    part, "".join(order), step, sum(not d[1] & (before | {x}) for d in own), len(here), sum(x in d[1] and bool(d[1] & before) for d in own),
                    sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here), shapley[x],
                ))
    return sorted(found)


LONG_A, LONG_B = " ".join(f"w{i}" for i in range(300)), " ".join(["so", "it", "goes"] * 100)
AUDIT = [
    (1, "a", LONG_A), (2, "a", LONG_A), (3, "b", LONG_A), (3, "b", LONG_A), (2, None, LONG_A), (4, "b", LONG_B), (5, "b", LONG_B.upper()), (6, None, None), (7, "a", ""), (8, "a", "short # one"),
    (9, "b", LONG_A + " 100%"), (10, "b", LONG_A + " 100%"), (None, "a", LONG_A), (None, None, None), (None, "a", LONG_B), (11, "c", "ÉÀ" * 40 + "AB"), (0, "c", " \t\n\x0b\f\r "), (12, "c", "x" * 900),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, None, None), (3, 1, 1), (4, 0, 1), (5, 1, None), (8, 1, 0), (8, 0, 1), (None, 1, 1), (10, 1, 0), (12, 1, 1)]


@pytest.fixture(scope="module")
def audit_labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audit_frame(spark, rows):
    from pyspark.sql import functions as F

    clash = ["mask", "digest", "part", "first", "good", "toxic", "quality", "every", "step", "filter_order", "own", "before", "kept"]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in clash})


def test_audit_is_brute_force(spark, audit_labels):
    found = filter_audit.audit(audit_frame(spark, AUDIT), audit_labels)
    assert sorted(map(tuple, found.collect())) == brute_audit(AUDIT, LABELS)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "int", *["bigint"] * 7]


def test_audit_without_rows_or_labels(spark, audit_labels):
    assert filter_audit.audit(audit_frame(spark, []), audit_labels).collect() == []
    found = filter_audit.audit(audit_frame(spark, AUDIT), audit_labels.where("false")).collect()
    assert sorted(map(tuple, found)) == brute_audit(AUDIT, [])


def test_parity_sums_are_inverted_exactly(spark):
    rows = spark.createDataFrame([(m, m % 3 == 0, m % 5 == 0) for m in range(32) for _ in range(m * m % 11)], "mask int, good boolean, toxic boolean")
    sums = filter_audit.walsh_sums(rows.selectExpr("'p' AS part", "*"))
    assert len(sums.first()["every"]) == 32 and sums.first()["every"][0] == rows.count()
    back = sums.select(*(filter_audit.cells(x).alias(x) for x in ("every", "good", "toxic"))).first()
    assert back["every"] == [m * m % 11 for m in range(32)]
    assert back["good"] == [m * m % 11 * (m % 3 == 0) for m in range(32)] and back["toxic"] == [m * m % 11 * (m % 5 == 0) for m in range(32)]


def test_long_texts_are_bounded(monkeypatch):
    text = (" ".join(f"word{i}" for i in range(200_000)) + " ") * 2
    short = filter_audit.failures(text.encode())
    monkeypatch.setattr(filter_audit, "LONG", 1)
    assert short == filter_audit.failures(text.encode()) == 0
    assert filter_audit.failures((text + "word1 ").encode()) == 1 << 1
    peak = peak_mb(filter_audit.failures, " ".join(f"word{i % 50_000}" for i in range(3_200_000)).encode())
    assert peak < 200


def peak_mb(f, *args):
    import tracemalloc

    tracemalloc.start()
    f(*args)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


# ---- operator 13

NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "mit license mit license", "the Mit-License and the APACHE   license", "general\npublic\nlicense", "a license of the general public", "permission is granted", None, "", " \n ", "É license 中文 mit license",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission is hereby granted, free of charge, by Jo Doe, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def brute_scan(index, text):
    """Every template at every beginning that shares any word with the text; no index of anchors, no pieces."""
    words = words_of(text)
    places, base = [], set()
    for label, phrase in license_scan.BASE.items():
        phrase = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += own
        base |= {label} if own else set()
    labels, score = set(base), license_scan.BASE_SCORE if base else 0.0
    for t, (label, text_, keys) in enumerate(license_scan.TEMPLATES):
        own, weights = text_.split(), index.weights[t]
        anchors = sorted(range(len(own)), key=lambda p: (-weights[p], p))[: license_scan.ANCHORS]
        at = {o: {p for p in anchors for d in range(license_scan.SLACK + 1) if 0 <= o + p + d < len(words) and words[o + p + d] == own[p]} for o in range(-len(own), len(words))}
        for o in at:
            exact = any(0 <= o + p < len(words) and words[o + p] == own[p] for p in anchors)
            if not exact or len(at[o]) < max(2, -(-len(anchors) // 2)):
                continue
            stretch = " " + " ".join(words[max(0, o) : max(0, o + len(own) + license_scan.SLACK)]) + " "
            near = [own[p] in words[max(0, o + p) : max(0, o + p + license_scan.SLACK + 1)] for p in range(len(own))]
            share = sum(w for w, x in zip(weights, near, strict=True) if x) / sum(weights)
            if share >= license_scan.COVER and all(f" {k} " in stretch for k in keys):
                labels.add(label)
                score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)


@pytest.fixture(scope="module")
def index(spark):
    return license_scan.Index(*license_scan.document_frequencies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_scan_is_brute_force(index):
    texts = [*NOTICES, "\n\n".join(x or "" for x in NOTICES), "prose " * 30 + (NOTICES[2] or "") + " prose" * 30, *(t for _, t in ROWS if t is None or len(t) < 2000)]
    for a in (0, 3, 13, 15):
        words = words_of(NOTICES[a])
        texts += [" ".join(words[:i] + ["inserted"] * n + words[i:]) for n in (1, 5, 8) for i in range(0, len(words), 3)] + [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))]
    for text in texts:
        found = index.scan((text or "").encode())
        assert found[:6] == brute_scan(index, text)[:6] and abs(found[6] - brute_scan(index, text)[6]) < 1e-9, text


def test_labels_beyond_the_base(index):
    said = {t: index.scan((t or "").encode())[5] for t in NOTICES}
    assert said[NOTICES[3]] == "cc-by-nc" and said[NOTICES[2]] == "gpl,gpl-3.0" and said[NOTICES[1]] == "apache,apache-2.0" and said[NOTICES[0]] == "mit"
    assert said[NOTICES[13]] == "bsd" and said[NOTICES[14]] == "isc" and said[NOTICES[15]] == "mit" and "lgpl" in said[NOTICES[16]] and said[NOTICES[17]] == "gpl,gpl-3.0"
    assert said[NOTICES[7]] == said[NOTICES[8]] == ""


def test_pieces_change_nothing(index, monkeypatch):
    text = ("words of prose and more " * 40).join(x or "" for x in NOTICES).encode()
    whole = index.scan(text)
    for size in (50, 333, 2048):
        monkeypatch.setattr(license_scan, "word_pieces", lambda text, table, size=size: word_pieces(text, table, size))
        assert index.scan(text) == whole


def test_scan_of_odd_rows(spark, odd, none):
    rows = license_scan.scan_licenses(odd).collect()
    assert len(rows) == len(ROWS)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(tuple(r)[1:7])
    for i, t in ROWS:
        assert (len(words_of(t)), 0, None, None, "", "") in got[i]
    assert license_scan.scan_licenses(none).collect() == []


def test_scan_of_documents(spark, index, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own = license_scan.Index(*license_scan.document_frequencies(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    rows = queries.op13_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        expected = brute_scan(own, texts[r["doc_id"]])
        assert tuple(r)[1:7] == expected[:6] and abs(r["score"] - expected[6]) < 1e-9


def test_frequencies_count_rows(spark):
    docs = documents(spark, [(1, "mit MIT license"), (2, "mit"), (3, None)])
    counts, n = license_scan.document_frequencies(docs)
    assert n == 3 and counts["mit"] == 2 and counts["license"] == 1


def test_a_long_text_is_scanned_in_bounded_memory(index):
    text = ("mit license. " + "some words of prose here " * 6 * 1000) * 220
    assert peak_mb(index.scan, text.encode()) < 200 and index.scan(text.encode())[1] == 220
