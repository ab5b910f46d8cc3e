import re

import pytest

import corpus_pipeline
from roamgrid.llm import decontam, queries, quality_mil, simhash
from roamgrid.llm.common import bounded_batches, table

from .conftest import CLASHING, ROWS
from .test_duplicates import brute_components, units
from .test_models import brute_leaks
from .test_tokens_and_packing import brute_best_fit, check_packing


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The result of every stage, as rows."""
    docs = table(spark, sf_dir, "documents")
    frames = [docs]
    from roamgrid.llm.common import store

    for name, stage in corpus_pipeline.STAGES:
        frames.append(store(stage(spark, frames[-1], sf_dir), name))
    return [f.collect() for f in frames], docs.columns


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_columns(steps):
    rows, columns = steps
    assert all(list(r[0].asDict()) == columns for r in rows[:5])


def test_quality_goes_by_the_score(spark, sf_dir, steps):
    rows, _ = steps
    model = quality_mil.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if model.score([r["text"].encode()])[0] >= 0.3}
    assert len(rows[1]) < len(rows[0])


def test_lines_that_went_are_in_earlier_documents(steps):
    rows, _ = steps
    before, after = {r["doc_id"]: r["text"] for r in rows[1]}, {r["doc_id"]: r for r in rows[2]}
    gone = 0
    for i, t in before.items():
        left = units(after[i]["text"]) if i in after else []
        lost = [x.strip() for x in units(t)]
        for x in left:
            if x.strip():
                lost.remove(x.strip())
        earlier = {y.strip() for j, s in before.items() if j < i for y in units(s)}
        assert all(x in earlier for x in lost if x)
        gone += len(lost)
        if i in after:
            assert after[i]["n_chars"] == len(after[i]["text"])
    assert gone


def test_no_long_passage_repeats_line_by_line(steps):
    """Runs of whole lines of at least 51 words are in one document only."""
    rows, _ = steps
    seen = {}
    for r in sorted(rows[2], key=lambda r: r["doc_id"]):
        own = [x.strip() for x in units(r["text"]) if x.strip()]
        for k in range(len(own)):
            run, words = [], 0
            for x in own[k:]:
                run.append(x)
                words += len(x.split())
                if words >= 51:
                    break
            if words >= 51:
                assert seen.setdefault(tuple(run), r["doc_id"]) == r["doc_id"]


def test_near_copies_leave_one(steps):
    rows, _ = steps
    prints = [(r["doc_id"], simhash.fingerprint(r["text"].encode())) for r in rows[2]]
    assert {r["doc_id"] for r in rows[3]} == {d for d, _, least in brute_components(prints, corpus_pipeline.NEAR_BITS) if d == least}


def test_leaking_documents_go(spark, sf_dir, steps):
    rows, _ = steps
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {r["doc_id"] for r in rows[4]} == {r["doc_id"] for r in rows[3] if not brute_leaks(items, r["text"])}


def test_everything_left_is_packed(steps, vocabulary):
    from tokenizers import Tokenizer

    rows, _ = steps
    tokenizer = Tokenizer.from_file(vocabulary)
    sizes = {}
    for r in rows[5]:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows[4]}
    assert check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows[5]], 2048) == brute_best_fit([r["length"] for r in rows[5]], 2048)


def test_run_equals_the_stages(spark, sf_dir, steps):
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in steps[0][5])


def test_odd_rows_pass_every_stage(spark, sf_dir, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage is corpus_pipeline.decontaminate
        packed = corpus_pipeline.pack(spark, docs, sf_dir)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_registered_queries():
    names = set(queries.queries())
    assert {m[1] for n in names if (m := re.match(r"op(\d+)_", n))} == {str(i) for i in range(1, 14)} and "pipeline" in names
    assert set(queries.oracle_sql()) <= names and len(CLASHING) > 10 and len(ROWS) > 10 and bounded_batches and decontam


def check_no_passage_repeats(rows):
    """Runs of lines of any length, of at least 51 words, are in one document only."""
    seen, short = {}, 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own = [x.strip() for x in units(r["text"]) if x.strip()]
        for k in range(len(own)):
            run, words = [], 0
            for x in own[k:]:
                run.append(x)
                words += len(x.split())
                if words >= 51:
                    break
            if words >= 51:
                short += any(len(x.split()) < 8 for x in run)
                assert seen.setdefault(tuple(run), r["doc_id"]) == r["doc_id"]
    assert short


def test_no_passage_of_short_lines_repeats(spark, steps):
    """In the pipeline's own documents, and in those that its first stage would drop."""
    check_no_passage_repeats(steps[0][2])
    sf_dir = "/root/testdata/sf0.01"
    check_no_passage_repeats(corpus_pipeline.dedup_lines(spark, table(spark, sf_dir, "documents"), sf_dir).collect())
