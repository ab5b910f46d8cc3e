import pytest

#: Names that operators use inside, with other types.
CLASHING = ["score", "fp", "chosen", "label", "label_id", "word", "node", "key", "n", "lines", "piece", "length", "offset", "line", "kept", "spans", "quality", "least", "root", "row", "part"]
LONG = " ".join(f"word{i % 977} is number {i}." for i in range(15_000))
PASSAGE = " ".join(f"shared{i % 31} passage{i}" for i in range(40)) + "."

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps. " + PASSAGE),
    (2, None),
    (3, ""),
    (4, " \t\n\r\f\v "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog, and then it sleeps. " + PASSAGE),
    (6, "The quick brown fox jumps over the lazy dog, and then it sleeps. " + PASSAGE),
    (7, "one"),
    (8, "one two"),
    (9, "Éé ß İ. ﬁ 中文 𝒳 é <|endoftext|> </s> a\x00b \x1c c|d"),
    (None, "a text without an id"),
    (None, None),
    (10, "x" * 50_000),
    (11, "Write to Jo.Doe+x@mail.example.com or JO.DOE+X@mail, card 4539578763621486, ip 10.0.0.1, call +1 (017) 555-7713.\nWrite again."),
    (12, "Quite another text. " + PASSAGE + " And it goes on."),
    (13, "same line\nsame line\nother\n\nsame line"),
]


def documents(spark, rows, extra=True):
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        docs = docs.withColumns({c: F.lit("x") for c in CLASHING})
    return docs


@pytest.fixture(scope="session")
def odd(spark):
    from roamgrid.llm.common import bounded_batches

    bounded_batches(spark)
    return documents(spark, ROWS)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.where("false")
