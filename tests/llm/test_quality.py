import re
import subprocess
import sys
import zlib

import numpy as np
import pytest

from roamgrid.llm import quality_mil, quality_rules, queries

from tests.conftest import ROOT

from .conftest import ROWS


@pytest.fixture(scope="module")
def truth(spark):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}


def accuracy(rows, truth, said):
    held = [(said(r), truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40
    return sum(a == b for a, b in held) / len(held)


def test_classifier_on_held_out_rows(spark, truth):
    rows = queries.op3_quality_mil(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, truth, lambda r: r["predicted"]) > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark):
    from pyspark.sql import functions as F

    from roamgrid.llm.common import id_bucket, table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    turned = labels.withColumn("quality", F.when(id_bucket("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_mil.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_encoding_sees_every_passage():
    x, count = quality_mil.encode([b"", b"a" * 512, b"b" * 513, b"c"])
    assert count.tolist() == [1, 1, 2, 1] and x.shape == (5, quality_mil.WIDTH)
    assert x[1, 0] == 1 and x[2, 1] == 1 and x[3, 1] == 1 and x[4, 2] == 1 and not x[0, :128].any()


def small_model(seed, width):
    draw = np.random.default_rng(seed)
    shapes = {"encode": (width, 5), "encode_0": (5,), "tanh": (5, 3), "gate": (5, 3), "attend": (3,), "out": (5,), "out_0": (1,)}
    return quality_mil.Model(draw.standard_normal(width), 1 + draw.random(width), {k: draw.standard_normal(v) for k, v in shapes.items()})


def test_scores_equal_a_naive_forward_pass():
    model, draw = small_model(1, quality_mil.WIDTH), np.random.default_rng(2)
    texts = [b"", b"One short text.", bytes(draw.integers(32, 127, 5000, np.uint8)), b"word " * 300, bytes(draw.integers(32, 127, 3 * quality_mil.PIECE // 2, np.uint8))]
    w = model.weights
    for text, found in zip(texts, model.score(texts), strict=True):
        energies, vectors = [], []
        for at in range(0, max(1, len(text)), quality_mil.PASSAGE):
            x, _ = quality_mil.encode([text[at : at + quality_mil.PASSAGE]])
            h = np.tanh(((x[0] - model.mean) / model.scale) @ w["encode"] + w["encode_0"])
            energies.append(sum(np.tanh(h @ w["tanh"][:, k]) / (1 + np.exp(-(h @ w["gate"][:, k]))) * w["attend"][k] for k in range(3)))
            vectors.append(h)
        share = np.exp(np.array(energies)) / np.exp(np.array(energies)).sum()
        z = sum(a * v for a, v in zip(share, vectors, strict=True)) @ w["out"] + w["out_0"][0]
        assert found == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_gradient_equals_differences():
    model, draw = small_model(3, 6), np.random.default_rng(4)
    count = np.array([1, 4, 2, 7])
    x, label = draw.standard_normal((count.sum(), 6)), np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = model.bags(x, count)[0]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    slope = quality_mil.gradient(model, x, count, label)
    for name, values in model.weights.items():
        assert slope[name].shape == values.shape
        for place in np.ndindex(values.shape):
            kept = values[place]
            values[place] = kept + 1e-5
            up = loss()
            values[place] = kept - 1e-5
            assert slope[name][place] == pytest.approx((up - loss()) / 2e-5, abs=1e-7)
            values[place] = kept


def test_memory_for_a_very_long_text():
    """64 MB of text in a process of its own."""
    code = """
import resource
import numpy as np
from roamgrid.llm import quality_mil
model = quality_mil.fit(*quality_mil.encode([b"some text " * 200, b"12 34!"]), np.array([1, 0], np.float32), rounds=1)
text = b"Some words here and there 12. " * ((64 << 20) // 30)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.score([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(done.stdout) < 200


def test_fit_learns_a_toy():
    """The loss falls along the learned direction on a toy where one passage decides."""
    rng = np.random.default_rng(0)
    count = rng.integers(1, 6, 300)
    x = rng.standard_normal((count.sum(), 6)).astype(np.float32)
    starts = np.cumsum(count) - count
    label = np.array([x[s : s + n, 0].max() > 0.8 for s, n in zip(starts, count, strict=True)], np.float32)
    model = quality_mil.fit(x, count, label, rounds=60)
    assert ((model.bags(x, count)[0] > 0.5) == (label > 0.5)).mean() > 0.93


def test_odd_rows(odd, none, labels, no_labels):
    rows = quality_mil.classify(odd, labels).collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(i) for i, _ in ROWS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality_mil.classify(odd, no_labels).collect()} == {0.5}
    assert quality_mil.classify(none, labels).collect() == []
    kept = quality_mil.keep_good(odd, quality_mil.train(odd, labels), 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


SMALL = [t or "" for _, t in ROWS if len(t or "") < 5000] + ["a b c d e f g h " * 3, "a b c d e f g h a b c d e f g", "x " * 9, " ".join("abcabdabe" * 6), "#*$%&|<> é\x1c𝒳\n \n#\n#", "\n\n"]


@pytest.mark.parametrize("text", SMALL)
def test_statistics(text):
    assert quality_rules.statistics(text)[:5] == brute_statistics(text)


def walk(trees, row):
    total = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.limit[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_trees_are_flat_and_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality_rules.NAMES)))
    label = ((x[:, 2] + 0.3 * rng.standard_normal(800) < 0.6) & (x[:, 0] > 0.2)).astype(float)
    trees = quality_rules.grow(x, label)
    score = trees.score(x)
    assert np.allclose(score, [walk(trees, r) for r in x]) and ((score > 0.5) == (label > 0.5)).mean() > 0.85
    for j in np.flatnonzero(quality_rules.MONOTONE):
        steps = []
        for v in np.linspace(-0.1, 1.1, 40):
            moved = x[:100].copy()
            moved[:, j] = v
            steps.append(trees.score(moved))
        assert (np.diff(np.array(steps), axis=0) <= 1e-12).all()


def test_rules_query(spark, truth):
    rows = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    good = [r for r in rows if not r["base_failed"]]
    assert accuracy(good, truth, lambda r: int(r["kept"])) > 0.95
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_rules_on_odd_rows(odd, none, labels, no_labels):
    rows = quality_rules.apply_rules(odd, quality_rules.train(odd, labels)).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"]) for r in rows) == sorted((repr(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in ROWS)
    assert all(r["base_failed"] for r in rows if r["n_words"] < 20)
    plain = quality_rules.apply_rules(odd, quality_rules.train(odd, no_labels)).collect()
    assert all(r["kept"] != r["base_failed"] for r in plain)
    assert quality_rules.apply_rules(none, None).collect() == []
