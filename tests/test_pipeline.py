import json

from pyspark.sql import functions as F

from conftest import rows
from pagewright.operators import chunking, concepts, keywords, reports
from pagewright.plans import pipeline
from pagewright.sources import pages as sources

P = "doc_id string, page_number int, raw_text string, loaded_at timestamp"
TOPICS = ["Equal shares of paper strips make unit fractions, and unit fractions make equal shares again.",
          "Number lines show whole numbers and unit fractions between the whole numbers.",
          "Area models show products of whole numbers, and area models tile the products."]


def pages_of(spark):
    texts = [t for t in TOPICS for _ in range(3)]
    return spark.createDataFrame([("D", i, t, None) for i, t in enumerate(texts)] + [("E", 0, "12", None)], P)


def stops_of(spark):
    return spark.createDataFrame([("en", w) for w in ("of", "and", "the", "again", "between", "make", "show")], "lang string, word string")


def test_run(spark):
    images = spark.createDataFrame([("D", 1, 0, 300, 300, "Strips of paper", "a strip", None, None)],
                                   "doc_id string, page_number int, img_index int, width int, height int, ocr_text string, caption string, error string, extract_error string")
    run = pipeline.run(pages_of(spark), stops_of(spark), images=images, canary=True)
    assert rows(run.chunks.select("doc_id", "first_page", "last_page")) == [("D", 0, 2), ("D", 3, 5), ("D", 6, 8), ("E", 0, 0)]
    assert "[IMAGE 1: Text in image: Strips of paper | Visual: a strip]" in run.texts.filter("doc_id = 'D' AND chunk_index = 0").first().chunk_text
    prompts = {r.doc_id: r for r in run.prompts.collect()}
    assert prompts["D"].status == prompts["E"].status == "ok" and "CHUNK 1 (Pages 1–3)" in prompts["D"].prompt
    # The self-check concept is flagged alone, its prerequisites are not looked at.
    flagged = [(r.kind, r.item) for r in run.flagged.filter("doc_id = 'D'").collect()]
    assert ("concept", "quantum entanglement theory") in flagged and not any("calculus" in i for _, i in flagged)
    metrics = {r.doc_id: r for r in run.metrics.collect()}
    assert metrics["D"].n_pages == 9 and metrics["D"].n_chunks == 3 and metrics["D"].n_concepts > 0 and metrics["E"].n_concepts == 0
    lines = [r.line for r in run.report.filter("doc_id = 'D'").orderBy("section", "at", "ord").collect()]
    assert lines[0].startswith("\n\n===== CHUNK 1") and "KEYWORD CLUSTERS" in lines[1] and any("FLAGGED" in x for x in lines)
    assert any("No concepts extracted." in r.line for r in run.report.filter("doc_id = 'E'").collect())


def test_statuses(spark):
    def load():
        def answer(batch):
            if len(batch) > 1:
                raise RuntimeError("one at a time")
            if batch[0] == "fail":
                raise RuntimeError("no answer")
            return ["{broken" if batch[0] == "bad" else '{"concepts": []}']
        return answer

    prompted = spark.createDataFrame([("A", "fine", "ok"), ("B", "fail", "ok"), ("C", "bad", "ok"), ("D", None, "prompt_too_large")], "doc_id string, prompt string, status string").coalesce(1)
    replies = concepts.ask(prompted, sources.provider(load, "string"))
    assert rows(replies.select("doc_id", "status", "error")) == [("A", "ok", None), ("B", "llm_error", "no answer"), ("C", "ok", None), ("D", "prompt_too_large", None)]
    assert rows(concepts.parsed(replies.filter("status = 'ok'")).select("doc_id", "status")) == [("A", "ok"), ("C", "json_error")]


def test_batches_and_one_load():
    calls = []
    load = lambda: (calls.append("load"), lambda batch: (calls.append(len(batch)), [x + 1 for x in batch])[1])[1]
    assert sources.answers("k", load, [1, 2]) == ([2, 3], [None, None]) and sources.answers("k", load, [3]) == ([4], [None])
    assert calls == ["load", 2, 1]
    assert sources.answers("lost", lambda: {}["no key"], [1]) == ([None], ["'no key'"])


def test_providers_of_vectors(spark):
    # Letters counted stand in for a model.
    embed = sources.embedder(lambda: lambda batch: [[float(x.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for x in batch])
    pages, stops = pages_of(spark), stops_of(spark)
    assert [round(r.sim, 3) == 1 for r in chunking.page_similarity(pages, embed).orderBy("page_number").collect()] == [True, True, False, True, True, False, True, True]
    tokens = spark.createDataFrame([("D", 0, ["abc", "abd", "zzz"])], "doc_id string, chunk_index int, tokens array<string>")
    assert keywords.topk_keywords(tokens, 1, embed).first().term == "abc abd zzz"
    terms = spark.createDataFrame([("D", 0, i, t, .5) for i, t in enumerate(["abc", "acb", "zzz", "zzy"])], "doc_id string, chunk_index int, ord int, term string, score double")
    assert rows(keywords.keyword_clusters(terms, embed=embed).select("terms")) == [(["abc", "acb"],), (["zzz", "zzy"],)]
    none = lambda t: F.when(t != "zzz", F.array(F.lit(1.0)))
    assert rows(keywords.missing_embeddings(terms, none)) == [("D", 0, 1)]
    names = spark.createDataFrame([("D", "area models"), ("D", "equal shares"), ("X", "zzz")], "doc_id string, name string")
    got = {r.concept: (r.best_page, r.found) for r in concepts.verification(names, concepts.built_index(pages), embed=embed).collect()}
    assert got["area models"][0] in (1, 4, 7) and got["zzz"] == (None, False)
    assert concepts.verification(names, concepts.built_index(pages), stops).count() == 3


def test_images(spark):
    listed = spark.createDataFrame([("D", 0, 0, 7, 300, 200), ("D", 0, 1, 8, 99, 200), ("D", 0, 2, 9, 100, 100), ("D", 1, 0, 6, 100, 100)], "doc_id string, page_number int, img_index int, xref int, width int, height int")
    contents = spark.createDataFrame([("D", 7, b"a long text"), ("D", 9, b"bad"), ("D", 8, b"x")], "doc_id string, xref int, bytes binary")

    def read():
        def answer(batch):
            if any(b == b"bad" for b in batch):
                raise ValueError("cannot decode")
            return [None if b is None else bytes(b).decode() for b in batch]
        return answer

    ocr, caption = sources.provider(read, "string"), sources.provider(lambda: lambda batch: [None if b is None else "a cat" for b in batch], "string")
    got = reports.image_descriptions(sources.described_images(listed, contents, ocr, caption))
    assert rows(got.select("page_number", "description")) == [
        (0, "[IMAGE 1: Text in image: a long text | Visual: a cat]"), (0, "[IMAGE 3: [Image analysis failed: cannot decode]]"), (1, "[IMAGE 1: Could not extract — no such image]")]


def test_outline_chat():
    prompt = concepts.PROMPT.replace("{toc}", "").replace("{clusters}", "\n  C1\n    - a\n    - b\n\n  C2\n    - a\n")
    reply = pipeline.outline_chat()([prompt])[0]
    assert json.loads(reply.removeprefix("```json\n").removesuffix("\n```")) == {"concepts": [{"name": "a", "prerequisites": []}, {"name": "b", "prerequisites": ["a"]}]}
