"""Scalar functions against golden pairs and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.plans.registry import HEADINGS


def col(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_tokens(spark):
    texts = ["", None, "a", " a b\n c ", *(" ".join("w" * n) for n in (5, 15, 25, 45, 270))]
    assert col(spark, T.estimate_tokens, texts) == [max(1, round(len((t or "").split()) * 1.3)) for t in texts]


def test_normalize_preview_slug(spark):
    assert col(spark, T.normalize, [None, "", "  a 　 b\t\n"]) == ["", "", "a b"]
    assert col(spark, T.preview, ["x" * 281, "y" * 280]) == ["x" * 280 + " ...", "y" * 280]
    assert col(spark, T.doc_slug, ["docs/SomeGazette-Sep 2015.pdf", "a/_B__c_.TXT"]) == ["somegazette_sep_2015", "b_c"]


def test_digits_and_sections(spark):
    assert col(spark, T.ascii_digits, ["৩৪৫ক"]) == ["345ক"]
    assert col(spark, T.section_id, ["৬১ক", "১৭", "x", None]) == ["61A", "17", None, None]
    assert col(spark, T.amends_field, [h for h, _ in HEADINGS]) == [v for _, v in HEADINGS]
    assert col(spark, T.section_number, ["23(1)", "x", None]) == ["23", None, None]


def test_cells(spark):
    got = col(spark, T.coerce_cell, ["17568", "19,310", "3.5", "১২", "5/-", "", None])
    assert [(r.i, r.d, r.s) for r in got] == [(17568, None, None), (19310, None, None), (None, 3.5, None), (12, None, None), (None, None, "5/-"), (None, None, ""), (None, None, "")]


def test_topics_and_bangla(spark):
    assert col(spark, T.topic_tags, ["Wages, overtime, maternity and leave with wages", None]) == [["wages", "overtime", "maternity"], []]
    assert col(spark, T.is_bangla, ["শ্রমিক work", "work", "123", None]) == [True, False, False, False]


def test_paths(spark):
    rows = [("d", "CHAPTER II", "leaf", "23(3)(b)", "23", None), ("d", "d", "prose_fallback", "part02", "", 1), ("d", None, "table", "p003_t01", "page 3", 3), ("d", None, "leaf", "", None, None), ("d", None, "front_matter", "front", "", 1)]
    df = spark.createDataFrame(rows, "doc string, chapter string, kind string, node string, m string, page int")
    got = [r[0] for r in df.select(T.section_path(F.col("doc"), F.col("chapter"), F.col("kind"), F.col("node"), F.col("m"), F.col("page"))).collect()]
    assert got == ["CHAPTER II · Section 23 · Sub-section (3) · Clause (b)", "prose part 02", "page 3 table p003_t01", "unnumbered", "front matter"]


@pytest.mark.parametrize("line,kind,mark", [("23. (1) body", "section", "23"), ("৩। শিরোনাম", "section", "3"), ("(2) x", "subsection", "2"), ("(ক) x", "clause", "ক"), ("(b) x", "clause", "b"), ("CHAPTER II", "chapter", ""), ("Provided that", "proviso", ""), ("> q", "quote", ""), ("| a | b |", "table_row", ""), ("plain", "text", "")])
def test_lines(spark, line, kind, mark):
    assert col(spark, T.line_kind, [line]) == [kind] and col(spark, T.line_mark, [line]) == [mark]


def test_masthead_fields(spark):
    t = "Registered No. DA- 1.\nThe Bangladesh Gazette Extraordinary Published by\nSunday, March 2, 2014\nMinistry of Labour\nDated: 5 May"
    r = col(spark, T.masthead_fields, [t])[0]
    assert (r.registration_no, r.issuing_authority, r.dated_reference, r.publication_date) == ("DA-1", "Ministry of Labour", "5 May", "Sunday, March 2, 2014")


def test_cosine(spark):
    rnd = random.Random(1)
    a, b = ([rnd.random() for _ in range(8)] for _ in range(2))
    df = spark.createDataFrame([(a, b), (a, [0.0] * 8)], "a array<float>, b array<float>")
    x, y = [r[0] for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()]
    dot = sum(p * q for p, q in zip(a, b, strict=True))
    assert abs(x - dot / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5) < 1e-6 and y == 0


def test_numbered_and_carried(spark):
    from chunkwell.functions.ordered import carried, numbered

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i, i // 7, rnd.choice([None, None, f"e{i}"])) for i in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, o long, b long, e string")
    got = {r.o: r.n for r in numbered(df, "g", "o", "n", width=16).collect()}
    kept = {r.o: r.x for r in carried(df, "g", "b", "o", {"x": F.col("e")}).collect()}
    for g in ("a", "b", None):
        last = None
        for i, (_, o, _, e) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            last = e or last
            assert got[o] == i and kept[o] == last
