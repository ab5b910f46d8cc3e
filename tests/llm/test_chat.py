import hashlib

from pyspark.sql import functions as F

from roamgrid.llm import chat_format, queries
from tests.conftest import same_rows

TURN = "conv_id long, turn long, role string, text string, formatted string, example string, parts string"
HARD = ["<|end|>", "<\\|end|>x", "[INST]a[/INST]", "<\\\\|turn|><|text|>", "<<SYS>>\\<</SYS>>", "<s></s>", "<", "[", "", "a<|", "\\", "<\\", "| <|", "</s>[INST] ok [/INST]", "\n<|im_start|>", "<<|<|", "<｜x", "é𝒳<|", None, "x" * 100_000]


def rows_of(digest):
    return {r["conv_id"]: r.asDict() for r in digest.collect()}


def expected(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {"n_turns": len(turns), "turns_sha256": sha(text), "loss_chars": len(loss), "loss_sha256": sha(loss)}


def test_hard_texts_are_read_back(spark):
    roles = ["user", "assistant", "system", None, "<|end|>", "assistant"]
    one = [(roles[i % 6], t) for i, t in enumerate(HARD)]
    talks = {1: one, 2: [("user", "a")], 3: [("assistant", None)], None: [("user", "q"), ("assistant", "a"), ("user", "r")]}
    rows = [(c, i, r, t, "x", "y", "z") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    examples = chat_format.format_examples(spark.createDataFrame(rows, TURN))
    found = rows_of(chat_format.digest(examples))
    for c, turns in talks.items():
        assert {k: found[c][k] for k in expected(turns)} == expected(turns)
    for r in examples.where("conv_id = 1").collect():
        body = r["formatted"].replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "")
        assert not any(x in body for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert r["loss_start"] <= r["loss_end"] <= len(r["formatted"])


def test_every_reply_is_an_example_with_its_context(spark):
    rows = [(1, i, r, t, "", "", "") for i, (r, t) in enumerate([("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "q3")])]
    found = chat_format.format_examples(spark.createDataFrame(rows, TURN)).orderBy("example").collect()
    assert [r["n_turns"] for r in found] == [2, 4, 5]
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in found] == ["a1", "a2", ""]
    assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(found, found[1:], strict=False))


def test_ties_and_repeated_rows_stay(spark):
    rows = [(1, 0, "user", "b", "", "", ""), (1, 0, "user", "a", "", "", ""), (1, 0, "user", "a", "", "", ""), (1, None, "system", "s", "", "", "")]
    found = rows_of(chat_format.digest(chat_format.format_examples(spark.createDataFrame(rows, TURN))))[1]
    assert {k: found[k] for k in expected([])} == expected([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])


def test_empty_table(spark):
    assert chat_format.digest(chat_format.format_examples(spark.createDataFrame([], TURN))).collect() == []


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op2_chat_format(spark, sf_dir), queries.OP2_SQL, sf_dir)
    assert queries.op2_chat_format(spark, sf_dir).where(F.col("conv_id") == -7).first()["loss_chars"] == 21
