"""Operator 11, source divergence audit: how far the sources of a language lie apart in their terms, by wide term vectors.

Terms are runs of letters (all characters beyond ASCII count as such; only A-Z is lower-cased). A language keeps the terms
that stand in at least ``min_docs`` of its documents. Every group, a (lang, source) that occurs, gives each kept term the
smoothed share p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)); a language has such shares too. All of it is whole
numbers: nothing is rounded twice, and sums do not depend on their order.

Each task counts its documents' terms by group and hands a row on for each (group, term), not for each word. One shuffle,
by term, brings a term's counts together, where they become one row with an array over the sources of its language (the
wide vector). Higher-order functions emit its contributions to the pairs of sources, which are summed before they are
shuffled. A term says nothing new of a pair in which neither source has it: both shares are then the groups' own
constants, which is a sum known for all terms at once. So a term contributes k * (S - 1) values at most, k being the
sources that have it and S all of them, not S * S.

Largest rows: a vector has an entry for each source of a language, as many as the report has rows for one group. The term
report holds 50 rows a group, which each task finds for its own rows first.

Rows: null text, lang and source count as empty; repeated rows count as often as they stand; a text without terms still
makes its group occur; a language without kept terms has pairs of value 0 and no terms; an empty table gives an empty
result; other input columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, word_pieces

MIN_DOCS = 30
TOP_TERMS = 50
# The scale of a share, and what is added to every count
SCALE, ADD = 1_000_000_000, 5
#: (group, term) pairs that a task counts before it hands them on, and the bytes of text that they may come from.
HELD, HELD_BYTES = 200_000, 1 << 26
#: ASCII letters stay, A-Z as a-z; other ASCII characters separate.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted within a task; a term has a row from every task that met it."""
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        read = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 10_000):
                    some = terms[at : at + 10_000]
                    columns = [[lang] * len(some), [source] * len(some)], pa.array(some, pa.binary()), [n[x] for x in some], [docs[x] for x in some]
                    yield pa.record_batch([*(pa.array(x, pa.string()) for x in columns[0]), columns[1], *(pa.array(x, pa.int64()) for x in columns[2:])], names)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                text = text.as_py() or b""
                for words in word_pieces(text, LETTERS):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                read += len(text)
                if read >= HELD_BYTES or sum(len(x) for x, _ in held.values()) >= HELD:
                    yield from hand_on()
                    read = 0
        yield from hand_on()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """Exact, in decimals: the product passes 64 bits from some nine thousand million occurrences on."""
    whole = lambda c: c.cast("decimal(27,0)")
    upper, lower = F.lit(SCALE).cast("decimal(10,0)") * whole(n + ADD), whole(total + ADD * terms)
    return F.lit(1).cast("long") + F.call_function("div", upper, lower).cast("long")


def vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms and languages.

    terms(lang, term, held): held are (source, n) of the sources that have the term. languages(lang, terms, total, groups):
    groups are (source, total, floor) in order of the source, floor being the share of a term that the group lacks.
    """
    # one shuffle serves both aggregations; the tasks have combined already
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    pivot = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    terms = store(pivot.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    totals = terms.select("lang", F.explode("held").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    number = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct().join(totals, ["lang", "source"], "left").join(number, "lang", "left").fillna(0, ["total", "terms"])
    groups = groups.withColumn("floor", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    languages = groups.groupBy("lang").agg(F.first("terms").alias("terms"), F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("source", "total", "floor"))).alias("groups"))
    return terms, store(languages, "languages")


def pair_values(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, a, b, value): the summed differences of all kept terms' shares, for places a < b of two sources in ``groups``."""
    floor = lambda i: F.get(F.col("groups"), i)["floor"]
    apart = lambda x, y: F.abs(x - y)
    count = F.map_from_entries("held")
    wide = terms.join(languages, "lang").withColumn("n", F.transform("groups", lambda g: F.coalesce(F.try_element_at(count, g["source"]), F.lit(0).cast("long"))))
    p = F.transform("groups", lambda g, i: F.when(F.get("n", i) > 0, share(F.get("n", i), g["total"], F.col("terms"))).otherwise(g["floor"]))
    places = F.sequence(F.lit(0), F.size("groups") - 1)
    wide = wide.select("lang", "groups", "n", p.alias("p"), places.alias("places"))

    def against(i: Column) -> Column:
        """What the pairs of a source that has the term get; a pair of two such sources is emitted by the first."""
        others = F.filter("places", lambda j: (j != i) & ((F.get("n", j) == 0) | (j > i)))
        return F.transform(others, lambda j: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), (apart(F.get("p", i), F.get("p", j)) - apart(floor(i), floor(j))).alias("value")))

    emitted = F.flatten(F.transform(F.filter("places", lambda i: F.get("n", i) > 0), against))
    found = wide.select("lang", F.explode(emitted).alias("x")).select("lang", "x.a", "x.b", "x.value")
    # all terms at once, as if no source had any
    own = languages.select("lang", "terms", "groups", F.explode(F.sequence(F.lit(0), F.size("groups") - 1)).alias("a")).where(F.col("a") < F.size("groups") - 1)
    own = own.select("lang", "terms", "groups", "a", F.explode(F.sequence(F.col("a") + 1, F.size("groups") - 1)).alias("b"))
    own = own.select("lang", "a", "b", F.coalesce(F.col("terms") * apart(floor(F.col("a")), floor(F.col("b"))), F.lit(0).cast("long")).alias("value"))
    return found.unionByName(own).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def term_values(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a group has and gives a greater share than its language does."""
    whole = F.aggregate("held", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    q = share(whole, F.col("total"), F.col("terms"))
    group = F.element_at(F.filter("groups", lambda g: g["source"] == F.col("x.source")), 1)
    rows = terms.join(languages, "lang").select("lang", "term", "terms", "groups", q.alias("q"), F.explode("held").alias("x"))
    p = share(F.col("x.n"), group["total"], F.col("terms"))
    return rows.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), (p - F.col("q")).alias("value")).where("value > 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, ``term`` the ``top`` terms."""
    terms, languages = vectors(docs, min_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named = pair_values(terms, languages).join(languages.select("lang", "groups"), "lang")
    a, b = (F.get("groups", F.col(x))["source"] for x in ("a", "b"))
    both = F.explode(F.array(F.struct(a.alias("source"), b.alias("item")), F.struct(b.alias("source"), a.alias("item"))))
    pairs = named.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", rank)
    best = term_values(terms, languages).withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
