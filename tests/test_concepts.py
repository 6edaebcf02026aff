import json
from datetime import datetime

from conftest import rows
from pagewright.operators import concepts, reports
from pagewright.plans import queries

NOW = datetime(2025, 1, 1)
C = "concept_id bigint, doc_id string, name string, prerequisites array<string>, deleted_at timestamp"


def frames(spark):
    c = spark.createDataFrame([
        (1, "D", "Sums", ["Fakes", "Counting"], None), (2, "D", "Counting", ["Fakes"], None), (3, "D", "Nothing", ["Fakes", "Sums"], None),
        (4, "D", "Empty", None, None), (5, "D", None, ["Sums"], None), (6, "D", "Sums", [None, "Sums"], NOW)], C)
    v = spark.createDataFrame([("D", n, f, NOW) for n, f in (("Sums", True), ("Counting", True), ("Nothing", False), ("Fakes", False), ("Empty", True), (None, True))],
                              "doc_id string, concept string, found boolean, checked_at timestamp")
    return c, concepts.found_names(v)


def test_clean_and_flagged(spark):
    c, found = frames(spark)
    assert rows(concepts.clean_concepts(c, found).select("concept_id", "name", "prerequisites")) == [(1, "Sums", ["Counting"]), (2, "Counting", []), (4, "Empty", [])]
    # Prerequisites of the flagged concept are not looked at; the same bad one under two good concepts comes twice.
    assert rows(concepts.flagged(c, found).select("kind", "item")) == [("concept", "Nothing"), ("prerequisite", "Fakes"), ("prerequisite", "Fakes")]
    report = reports.concept_report(concepts.clean_concepts(c, found), concepts.flagged(c, found)).collect()
    assert sum("Prerequisites: None" in r.line for r in report) == 2 and sum("FLAGGED" in r.line for r in report) == 1


def test_replies(spark):
    raw = spark.createDataFrame([(1, "D", '```json\n{"concepts": [{"name": "a", "prerequisites": []}]}\n```'), (2, "D", 'Here you go: {"concepts": []}'), (3, "D", None), (4, "D", ""), (5, "D", '{"concepts": []}'), (6, "D", '{"concepts": [{"name": "a"}]}'), (7, "D", "[1]")], "reply_id bigint, doc_id string, raw string")
    got = {r.reply_id: (r.status, r.n_concepts) for r in concepts.parse_replies(raw).collect()}
    assert got == {1: ("ok", 1), 2: ("json_error", 0), 3: ("llm_error", 0), 4: ("json_error", 0), 5: ("ok", 0), 6: ("llm_error", 0), 7: ("llm_error", 0)}


def test_canary_is_flagged_alone(spark):
    pages = spark.createDataFrame([("D", 1, "counting cubes and sums with small cubes", NOW, 1)], "doc_id string, page int, text string, indexed_at timestamp, index_id bigint")
    stops = spark.createDataFrame([("en", "and"), ("en", "with")], "lang string, word string")
    probe = concepts.canary(pages.select("doc_id")).select("doc_id", "name").union(spark.createDataFrame([("D", "small cubes")], "doc_id string, name string"))
    got = {r.concept: (r.found, r.best_page) for r in concepts.verification(probe, concepts.given_index(pages), stops).collect()}
    assert got == {"quantum entanglement theory": (False, None), "small cubes": (True, 1)}


def test_prompt_guard(spark):
    # Of F, chunk 0 has no keywords and does not appear; chunk 1 lost its clusters to the filter and stays without any.
    chunks = spark.createDataFrame([("D", 0, "CHUNK 1 (Pages 1–2)"), ("E", 0, None), ("F", 0, "C1"), ("F", 1, "C2"), ("F", 2, "C3")], "doc_id string, chunk_index int, label string")
    names = spark.createDataFrame([("D", 0, 0, "x" * 20_000), ("E", 0, 0, None), ("F", 1, 0, None), ("F", 2, 1, "b"), ("F", 2, 0, "a")], "doc_id string, chunk_index int, name_ord int, name string")
    toc = spark.createDataFrame([("E", "contents\n")], "doc_id string, toc_context string")
    got = {r.doc_id: r for r in concepts.prompts(chunks, names, toc).collect()}
    assert got["D"].status == "prompt_too_large" and got["D"].prompt is None and got["E"].status == "ok" and "contents\n" in got["E"].prompt
    assert "\n  C2\n\n  C3\n    - a\n    - b\n" in got["F"].prompt and "C1" not in got["F"].prompt
    assert all(len(r.prompt) == r.n_chars for r in got.values() if r.prompt)


def test_extra_keys_survive(spark):
    raw = spark.createDataFrame([("D", '{"concepts": [{"grade": 4, "name": "sums", "prerequisites": ["a", "b"]}, {"name": null, "prerequisites": []}]}'), ("E", "no")], "doc_id string, raw string")
    got = concepts.reply_concepts(raw).collect()
    assert [(r.doc_id, r.ord, r.name, r.prerequisites, r.extra) for r in got] == [("D", 0, "sums", ["a", "b"], '{"grade":"4"}'), ("D", 1, None, [], None)]
    graph = reports.concepts_json(concepts.reply_concepts(raw).withColumnRenamed("ord", "concept_id"))
    assert json.loads(graph.first().value) == {"concepts": [{"name": "sums", "prerequisites": ["a", "b"], "grade": "4"}, {"prerequisites": []}]}


def test_prerequisites_are_checked(spark, tmp_path):
    # "small cubes" and "Fakes" are names of no concept; only the pages tell them apart.
    tables = {
        "concepts": spark.createDataFrame([(1, "D", "sums", ["small cubes", "Fakes", None], None), (2, "D", "gone", ["lost"], NOW)], C),
        "page_index": spark.createDataFrame([("D", 1, "sums with small cubes, sums of cubes", NOW, 1)], "doc_id string, page int, text string, indexed_at timestamp, index_id bigint"),
        "stop_words": spark.createDataFrame([("en", "of"), ("en", "with")], "lang string, word string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    every = queries.queries()
    assert rows(every["verify_items"](spark, str(tmp_path)).select("concept", "found")) == [("Fakes", False), ("small cubes", True), ("sums", True)]
    assert rows(every["verified_clean"](spark, str(tmp_path)).select("concept_id", "prerequisites")) == [(1, "small cubes")]
    assert rows(every["verified_flagged"](spark, str(tmp_path)).select("kind", "item")) == [("prerequisite", "Fakes")]
