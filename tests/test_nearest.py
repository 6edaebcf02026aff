import math
import pickle
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from pagewright.operators import concepts, nearest
from pagewright.plans import queries

NOW = datetime(2025, 1, 1)
C = "concept_id bigint, doc_id string, name string, prerequisites array<string>, deleted_at timestamp"
P = "doc_id string, page int, text string, indexed_at timestamp, index_id bigint"


def shuffled_rows(spark, run):
    """The rows that all stages of a run wrote for a shuffle."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jvm = sc._gateway.jvm
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


@pytest.mark.parametrize("query", ["verify_concepts", "verify_items", "verified_clean", "verified_flagged"])
def test_names_and_pages_of_a_hot_document_are_not_listed(spark, tmp_path, query):
    # All 300 names share a word with all 300 pages: 90,000 pairs.
    tables = {
        "concepts": spark.createDataFrame([(i, "D", f"sums of n{i}", [f"sums of m{i}", f"sums lost in q{i}"], None) for i in range(300)], C),
        "page_index": spark.createDataFrame([("D", i, f"a page on sums with n{i} and m{i}", NOW, i) for i in range(300)], P),
        "stop_words": spark.createDataFrame([("en", "of"), ("en", "with")], "lang string, word string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        assert shuffled_rows(spark, lambda: got.extend(queries.queries()[query](spark, str(tmp_path)).collect())) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) >= 300


def test_page_numbers_far_apart_make_no_blocks(spark, tmp_path):
    # 300 pages fit into one block, whatever numbers they bear: each of the 900 names meets one block, not 300.
    tables = {
        "concepts": spark.createDataFrame([(i, "D", f"sums of n{i}", [f"sums of m{i}", f"page {i}"], None) for i in range(300)], C),
        "page_index": spark.createDataFrame([("D", i * 1_000_000, f"page {i} " * 9, NOW, i) for i in range(300)], P),
        "stop_words": spark.createDataFrame([("en", "of")], "lang string, word string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = []
    assert shuffled_rows(spark, lambda: got.extend(queries.queries()["verified_flagged"](spark, str(tmp_path)).collect())) < 3_000
    assert len(got) == 300


def test_words_that_no_name_has_are_not_shuffled(spark, tmp_path):
    # 300 pages of 300 words each, of which names ask for two: 6 KB in place of 600.
    rng = random.Random(5)
    tables = {
        "concepts": spark.createDataFrame([(i, "D", f"sums of n{i}", [f"sums of m{i}"], None) for i in range(300)], C),
        "page_index": spark.createDataFrame([("D", i, f"sums with n{i} " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(300)), NOW, i) for i in range(300)], P),
        "stop_words": spark.createDataFrame([("en", "of")], "lang string, word string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sc, got = spark.sparkContext, []

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jvm = sc._gateway.jvm
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = written()
    got.extend(queries.queries()["verified_flagged"](spark, str(tmp_path)).collect())
    assert sum(n for stage, n in written().items() if stage not in before) < 150_000
    assert len(got) == 300


def test_a_page_keeps_the_words_asked_for_and_its_length():
    part = bytearray(4096)
    at = zlib.crc32("sums".encode()) % nearest.PLACES
    part[at % 32_768 >> 3] |= 1 << (at & 7)
    asked = nearest.WordFilter({at // 32_768: bytes(part)})
    rows = pa.Table.from_pylist([{"page": 1, "words": " sums a of sums b a a "}, {"page": 2, "words": ""}]).to_batches()
    got = [r for b in nearest.page_bags(rows, frozenset(["of"]), pickle.loads(pickle.dumps(asked))) for r in b.to_pylist()]
    assert got == [{"page": 1, "words": "sums sums", "rest": 10}, {"page": 2, "words": "", "rest": 0}]


def test_supported_are_the_found_of_verification(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(concepts, "PAGE_BLOCK", 4)
    text = lambda n: " ".join(f"w{rng.randrange(9)}" for _ in range(n))
    given = spark.createDataFrame([(rng.choice("DE"), rng.randrange(30) << 20, text(rng.randrange(8, 20)), NOW + timedelta(days=rng.randrange(3)), i) for i in range(90)], P)
    asked = spark.createDataFrame([(rng.choice("DEF"), text(rng.randrange(4))) for _ in range(90)] + [("D", None)], "doc_id string, name string")
    stops = spark.createDataFrame([("en", "w0")], "lang string, word string")
    checks = concepts.verification(asked, concepts.given_versions(given), stops).collect()
    want = sorted((r.doc_id, r.concept) for r in checks if r.found)
    assert sorted(tuple(r) for r in concepts.supported(asked, concepts.given_versions(given), stops).collect()) == want
    assert 10 < len(want) < len(checks) - 10


def test_nearest_page_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(concepts, "PAGE_BLOCK", 4)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "The", "É"]
    text = lambda n: " , ".join(rng.choice(vocabulary) for _ in range(n)) + "." * 25
    pages = [(d, rng.randrange(-5, 20), text(rng.randrange(0, 9)), NOW + timedelta(days=rng.randrange(3)), i) for i in range(150) for d in [rng.choice(["D", "E", None])]]
    pages += [("D", 30, "the " * 10, NOW, 200), ("D", None, "w1 " * 10, NOW, 201), ("D", 2, "short", NOW + timedelta(days=9), 202), ("D", 3, None, NOW, 203)]
    names = [(d, text(rng.randrange(0, 5))) for _ in range(60) for d in [rng.choice(["D", "E", "F"])]] + [("D", ""), ("D", "the"), ("E", "unknown"), ("F", None)]
    stops = spark.createDataFrame([("en", "THE"), ("en", None)], "lang string, word string")

    def bag(text):
        return Counter(w for w in text.lower().replace(",", " ").replace(".", " ").split() if w != "the")

    last = {}
    for d, page, t, at, i in pages:
        if d and page is not None and t and len(t) > 20:
            last[d, page] = max(last.get((d, page), (NOW, -1, "")), (at, i, t))
    want = set()
    for d, name in set(names):
        if name is None:
            continue
        best, n = (0.0, None), bag(name)
        for (e, page), (_, _, t) in sorted(last.items()):
            p = bag(t)
            if e == d and (dot := sum(c * p[w] for w, c in n.items())):
                sim = dot / math.sqrt(sum(c * c for c in n.values()) * sum(c * c for c in p.values()))
                best = (sim, page) if sim > best[0] else best
        want.add((d, name, *best))
    given = spark.createDataFrame(pages, P)
    asked = spark.createDataFrame(names, "doc_id string, name string")
    for index in (concepts.given_versions(given), concepts.given_index(given)):
        got = [tuple(r) for r in concepts.verify(asked, index, stops).collect()]
        assert len(got) == len(want) and set(got) == want


def test_what_a_block_keeps_does_not_change_answers(monkeypatch):
    rng = random.Random(3)
    rows = []
    for doc in ("D", "E"):
        text = lambda n: " ".join(f"w{rng.randrange(9)}" for _ in range(n))
        rows += [{"doc_id": doc, "block": 0, "kind": 0, "page": i // 2, "name": None, "words": text(rng.randrange(6))} for i in range(30)]
        rows += [{"doc_id": doc, "block": 0, "kind": 1, "page": None, "name": str(i), "words": text(rng.randrange(4))} for i in range(90)]

    def answers():
        batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=25)
        return [r for b in nearest.nearest_in_blocks(batches, frozenset(["w0"])) for r in b.to_pylist()]

    want = answers()
    for limit in ("ROWS", "ANSWERS", "VECTORS"):
        monkeypatch.setattr(nearest, limit, 2)
    assert answers() == want and len(want) == 180
