import pytest
from pyspark.sql import functions as F

from conftest import rows
from pagewright.operators import cleaning

CASES = [
    ("Alpha beta\r\nGamma delta", "Alpha beta\nGamma delta"),
    ("Fractions......... 12", "Fractions 12"),
    ("Grade 12\nLesson 3\nunit 4", ""),
    ("Lesson\n12", "Lesson"),
    ("Some text\nLicensed under X\nMore text", "Some text\nMore text"),
    ("Nice illustrations here", ""),
    ("abcd 1", ""),
    ("abcdef 12345678", ""),
    ("Credits\nAda Love\n\nKeep this line", "Keep this line"),
    ("Credits\nAda Love", "Credits\nAda Love"),
    ("Credits\nAda Love\n", ""),
    ("Credits\n" + "line of names\n" * 20_000 + "\nKeep this line", "Keep this line"),
    ("", ""),
    (None, None),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = dict(df.select("i", cleaning.clean_text("t").alias("t")).collect())
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_keyword_rules(spark):
    df = spark.createDataFrame([("student notes",), ("group work",), ("page",), ("coworker",), ("works",), ("a b c d e",), ("Nets  and\tcubes",)], "t string")
    got = dict(df.select("t", cleaning.good_keyword("t").alias("g")).collect())
    assert got == {"student notes": False, "group work": False, "page": False, "coworker": True, "works": True, "a b c d e": False, "Nets  and\tcubes": True}
    one = spark.createDataFrame([("[IMAGE 2: Text in image: abc | Visual: a cat]",), ("[IMAGE 1: [Image: no content detected]]",)], "t string")
    assert {r[0] for r in one.select(cleaning.keyword_input("t")).collect()} == {"abc a cat", "[Image: no content detected"}


@pytest.mark.parametrize("raw,toc", [("Unit Overview", True), ("Section A ...... 7\n" * 3, True), ("Section A ...... 7\n" * 2, False), ("plain", False), ("", False)])
def test_is_toc(spark, raw, toc):
    assert spark.createDataFrame([(raw,)], "t string").select(cleaning.is_toc("t")).first()[0] is toc


@pytest.mark.parametrize("flags,block", [("FTTFT", "FTTFF"), ("TTTT", "TTTF"), ("FFF", "FFF"), ("FFTFT", "FFTFF")])
def test_toc_block(spark, flags, block):
    pages = spark.createDataFrame([("D", i, "Unit Overview" if f == "T" else "text", None) for i, f in enumerate(flags)], "doc_id string, page_number int, raw_text string, loaded_at timestamp")
    got = dict(cleaning.toc_block(pages).select("page_number", "in_toc_block").collect())
    assert "".join("T" if got[i] else "F" for i in range(len(flags))) == block


def test_fences(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('```\n{"a": 1}```',), (' {"a": 1} ',), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.strip_fences("t")).collect()] == ['{"a": 1}'] * 3 + [None]


def test_pages_twice_and_empty(spark):
    schema = "doc_id string, page_number int, raw_text string, loaded_at timestamp"
    pages = spark.createDataFrame([("D", 0, "first words here", None), ("D", 0, None, None), ("D", 0, "later words here", None)], schema).withColumn("loaded_at", F.lit("2025-01-01").cast("timestamp"))
    assert rows(cleaning.clean_pages(pages).select("doc_id", "text")) == [("D", "later words here")]
    assert cleaning.clean_pages(spark.createDataFrame([], schema)).count() == 0
