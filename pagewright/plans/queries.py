"""Queries of the core operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import chunking, cleaning, concepts, hierarchy, keywords, orphans, reports
from pagewright.plans import pipeline
from pagewright.runtime import materialize
from pagewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Stands in for OCR and captions: (doc_id, page_number, img_index, width, height, ocr_text, caption, error, extract_error).
IMAGES = [
    ("D1", 0, 0, 640, 480, "Count  the\ncubes  here", "a row of cubes", None, None),
    ("D1", 0, 1, 90, 480, "too small", None, None, None),
    ("D1", 0, 2, 300, 300, "abc", " a number line ", None, None),
    ("D1", 1, 0, 200, 200, "12", "", None, None),
    ("D1", 2, 0, 100, 100, None, None, "cannot decode", None),
    ("D2", 0, 0, 400, 99, "ignored", "ignored", None, None),
    ("D2", 0, 1, 400, 100, None, None, None, "bad xref"),
    ("D2", 3, 0, 1000, 800, "Table of values", None, None, None),
]
IMAGE_SCHEMA = (
    "doc_id string, page_number int, img_index int, width int, height int, ocr_text string, caption string, error string, extract_error string"
)


def images(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IMAGES, IMAGE_SCHEMA)


def pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


def texts(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_text(pages(s, d), table(s, d, "chunks"))


def tokens(s: SparkSession, d: str) -> DataFrame:
    return keywords.chunk_tokens(texts(s, d), table(s, d, "stop_words"))


def index(s: SparkSession, d: str) -> DataFrame:
    return concepts.given_versions(table(s, d, "page_index"))


def found(s: SparkSession, d: str) -> DataFrame:
    return concepts.found_names(table(s, d, "verification"))


def checked(s: SparkSession, d: str) -> DataFrame:
    """Names and prerequisites, all checked against the pages here and not looked up in a given table."""
    return concepts.verification(concepts.items(table(s, d, "concepts")), index(s, d), table(s, d, "stop_words"))


def checked_found(s: SparkSession, d: str) -> DataFrame:
    return materialize(concepts.supported(concepts.items(table(s, d, "concepts")), index(s, d), table(s, d, "stop_words")))


def whole_run(s: SparkSession, d: str) -> pipeline.Run:
    """All stages by the offline providers, with the self-check concept."""
    return pipeline.run(pages(s, d), table(s, d, "stop_words"), canary=True)


def prompt_inputs(s: SparkSession, d: str) -> DataFrame:
    """Prompts with the best keywords of each chunk in the place of cluster names."""
    names = keywords.distinct_keywords(table(s, d, "keywords")).select(
        "doc_id", "chunk_index", F.col("ord").alias("name_ord"), F.col("term").alias("name"))
    return concepts.prompts(table(s, d, "chunks"), names, chunking.toc_context(pages(s, d)))


def listed_clusters(s: SparkSession, d: str) -> DataFrame:
    """The keywords of each chunk as one cluster per first letter, for the report."""
    rows = keywords.distinct_keywords(table(s, d, "keywords")).withColumn("letter", F.substring("term", 1, 1)).filter("term <> ''")
    labels = table(s, d, "chunks").groupBy("doc_id", "chunk_index").agg(F.coalesce(F.max("label"), F.lit("")).alias("label"))
    members = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "ord", "term", "score")))
    groups = rows.groupBy("doc_id", "chunk_index", "letter").agg(members.alias("m"), F.min("ord").alias("cluster_ord"))
    return groups.join(labels, ["doc_id", "chunk_index"]).select(
        "doc_id", "chunk_index", "label", "cluster_ord", F.col("m")[0]["term"].alias("name"),
        F.transform("m", lambda x: x["term"]).alias("terms"), F.transform("m", lambda x: x["score"]).alias("scores"))


def queries() -> dict[str, Query]:
    return {
        "p2_found": lambda s, d: orphans.orphan_rows(table(s, d, "concepts"), table(s, d, "verification")),
        "p2_months": lambda s, d: orphans.orphan_counts(table(s, d, "concepts"), table(s, d, "verification")),
        "p5_found": lambda s, d: hierarchy.roots(table(s, d, "concepts")),
        "p5_nodes": lambda s, d: hierarchy.node_table(table(s, d, "concepts")),
        "p5_paths": lambda s, d: hierarchy.root_paths(table(s, d, "concepts")),
        "p5_descendants": lambda s, d: hierarchy.descendants(table(s, d, "concepts")),
        "p5_loops": lambda s, d: hierarchy.loop_table(table(s, d, "concepts")),
        "page_count": lambda s, d: chunking.page_counts(pages(s, d)),
        "clean_lines": lambda s, d: cleaning.clean_lines(pages(s, d)),
        "clean_text": lambda s, d: cleaning.clean_pages(pages(s, d)).select("doc_id", "page_number", "text"),
        "page_text_class": lambda s, d: cleaning.clean_pages(pages(s, d)).select(
            "doc_id", "page_number", chunking.embed_text(F.col("text")).alias("embed_text"),
            (F.length("text") >= 20).alias("has_content"), (F.length("text") > 20).alias("in_index")),
        "keyword_input": lambda s, d: texts(s, d).select("doc_id", "chunk_index", cleaning.keyword_input(
            F.concat(F.lit("[IMAGE 2: Text in image: abc | Visual: a cat]"), "chunk_text")).alias("text")),
        "keyword_filter": lambda s, d: table(s, d, "keywords").filter("term IS NOT NULL").select(
            "doc_id", "chunk_index", "ord", cleaning.normal_term("term").alias("term"), cleaning.good_keyword("term").alias("good")),
        "strip_fences": lambda s, d: table(s, d, "llm_raw").select("reply_id", "doc_id", "raw").distinct().select(
            "reply_id", "doc_id", cleaning.strip_fences("raw").alias("body")),
        "parse_replies": lambda s, d: concepts.parse_replies(table(s, d, "llm_raw")).select("reply_id", "doc_id", "status", "n_concepts"),
        "toc_detect": lambda s, d: cleaning.latest_pages(pages(s, d)).select("doc_id", "page_number", cleaning.is_toc("raw_text").alias("is_toc")),
        "toc_block": lambda s, d: cleaning.toc_block(pages(s, d)),
        "page_similarity": lambda s, d: chunking.page_similarity(pages(s, d)),
        "similarity_report": lambda s, d: chunking.similarity_report(pages(s, d)),
        "semantic_chunks": lambda s, d: chunking.chunk_list(chunking.semantic_chunks(pages(s, d))),
        "chunk_text": texts,
        "toc_context": lambda s, d: chunking.toc_context(pages(s, d)),
        "image_descriptions": lambda s, d: reports.image_descriptions(images(s)),
        "page_image_context": lambda s, d: reports.page_image_context(images(s)),
        "ngram_candidates": lambda s, d: keywords.ngram_candidates(tokens(s, d)),
        "topk_keywords": lambda s, d: keywords.topk_keywords(tokens(s, d)),
        "cosine_pairs": lambda s, d: keywords.cosine_pairs(table(s, d, "page_index")),
        "cluster_count": lambda s, d: keywords.cluster_count(table(s, d, "keywords")),
        "keyword_clusters": lambda s, d: keywords.keyword_clusters(table(s, d, "keywords")),
        "cluster_coherence": lambda s, d: keywords.cluster_coherence(table(s, d, "embeddings")),
        "coherent_documents": lambda s, d: keywords.cluster_coherence(table(s, d, "page_index", "doc_id", "embedding"), "doc_id").filter(
            F.col("coherence") >= 0.05),  # a low bar: page vectors of one document differ
        "cluster_report": lambda s, d: reports.cluster_report(listed_clusters(s, d)),
        "prompt": prompt_inputs,
        "verify_concepts": lambda s, d: concepts.verification(
            concepts.current(table(s, d, "concepts")).select("doc_id", cleaning.squeeze("name").alias("name")), index(s, d), table(s, d, "stop_words")),
        "verify_items": checked,
        "verified_clean": lambda s, d: concepts.clean_concepts(table(s, d, "concepts"), checked_found(s, d)).select(
            "concept_id", "doc_id", "name", F.array_join("prerequisites", "|").alias("prerequisites")),
        "verified_flagged": lambda s, d: concepts.flagged(table(s, d, "concepts"), checked_found(s, d)),
        "clean_concepts": lambda s, d: concepts.clean_concepts(table(s, d, "concepts"), found(s, d)).select(
            "concept_id", "doc_id", "name", F.array_join("prerequisites", "|").alias("prerequisites")),
        "flagged_concepts": lambda s, d: concepts.flagged(table(s, d, "concepts"), found(s, d)).filter("kind = 'concept'").select("concept_id", "doc_id", "item"),
        "flagged_all": lambda s, d: concepts.flagged(table(s, d, "concepts"), found(s, d)),
        "canary_check": lambda s, d: concepts.verification(
            concepts.canary(table(s, d, "page_index").select("doc_id").distinct()).select("doc_id", "name"), index(s, d), table(s, d, "stop_words")),
        "pipeline_keywords": lambda s, d: pipeline.keyword_stages(pages(s, d), table(s, d, "stop_words"))[2],
        "pipeline_report": lambda s, d: whole_run(s, d).report,
        "pipeline_metrics": lambda s, d: whole_run(s, d).metrics,
        "concept_report": lambda s, d: reports.concept_report(
            concepts.clean_concepts(table(s, d, "concepts"), found(s, d)), concepts.flagged(table(s, d, "concepts"), found(s, d))),
    }
