import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.operators import chunking


def plain(sims, drop=0.45, least=3, most=20):
    starts, size = [0], 1
    for i, s in enumerate(sims, 1):
        if size >= most or (s < 1 - drop and size >= least):
            starts.append(i)
            size = 1
        else:
            size += 1
    return starts


def starts_of(spark, sims, **kw):
    rows = [("D", 0, None)] + [("D", i, float(s)) for i, s in enumerate(sims, 1)]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, sim double")
    return sorted(r.page_number for r in chunking.assigned_chunks(df, **kw).filter("starts").collect())


@pytest.mark.parametrize("sims,want", [([.9, .1, .2, .1, .9, .3, .2], [0, 3, 6]), ([.9] * 24, [0, 20]), ([.1], [0]), ([], [0]), ([.9, .9, .55], [0])])
def test_cases(spark, sims, want):
    assert starts_of(spark, sims) == want


def test_blocks_compose(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(chunking, "BLOCK", 7)
    sims = [rng.choice([.1, .5, .54, .56, .9]) for _ in range(90)]
    assert starts_of(spark, sims) == plain(sims)


def test_long_document(spark):
    # 100,000 pages of one document, every third number missing: no task sorts them all.
    rng = random.Random(6)
    n = 100_000
    sims = [rng.choice([.1, .5, .9]) for _ in range(n - 1)]
    numbers = [i + i // 2 for i in range(n)]
    rows = pd.DataFrame({"doc_id": "D", "page_number": numbers, "sim": [None, *sims]})
    df = spark.createDataFrame(rows, "doc_id string, page_number int, sim double").withColumn("sim", F.nanvl("sim", F.lit(None)))
    got = chunking.assigned_chunks(df)
    assert sorted(r.page_number for r in got.filter("starts").collect()) == [numbers[i] for i in plain(sims)]
    assert got.agg(F.max("chunk_index")).first()[0] == len(plain(sims)) - 1
    order = chunking.page_order(df.select("doc_id", "page_number"), "page_number")
    assert [tuple(r) for r in order.orderBy("page_number").select("page_number", "prev_page").collect()] == list(zip(numbers, [None, *numbers]))
    for plan in (got, order):
        windows = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in x]
        assert windows and all("block" in x for x in windows)


def test_similarity(spark):
    text = ["one two three four five six", "one two three four five seven", "zzz", "totally other words in this page"]
    pages = spark.createDataFrame([("D", i, t, None) for i, t in enumerate(text)], "doc_id string, page_number int, raw_text string, loaded_at timestamp")
    got = {r.page_number: r.sim for r in chunking.page_similarity(pages).collect()}
    assert got[1] == pytest.approx(5 / 6) and got[2] == 0 and 0 < got[3] < .5  # the short page counts as "empty page"


def test_length_boundaries(spark):
    rows = [(n, "a" * n) for n in (19, 20, 21)]
    df = spark.createDataFrame(rows, "n int, t string").select("n", chunking.embed_text(F.col("t")).alias("t"))
    assert [r.t == "empty page" for r in df.orderBy("n").collect()] == [True, True, False]
