"""The stages put together: from pages to the report of a verified concept graph.

pages -> chunks -> texts with images -> keywords -> clusters -> prompts -> replies ->
concepts -> verification -> clean concepts, flagged items, report. All stages are keyed
by document, so any number of documents runs at once; what a later stage reads more
than once is written once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import chunking, concepts, keywords, reports
from pagewright.runtime import materialize
from pagewright.sources.pages import provider


def outline_chat() -> Callable[[list[str]], list[str]]:
    """The offline stand-in for a chat model: every cluster name of the prompt is a concept that builds on the one before."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            listed = prompt.partition("ALL TOPIC CLUSTERS BY SECTION:")[2].partition("\nYour task:")[0]
            names = list(dict.fromkeys(x[6:] for x in listed.split("\n") if x.startswith("    - ")))
            graph = {"concepts": [{"name": n, "prerequisites": [before] if before else []} for before, n in zip([None, *names], names)]}
            out.append("```json\n" + json.dumps(graph, ensure_ascii=False) + "\n```")
        return out

    return answer


@dataclass
class Run:
    """The frames of one run over all documents."""

    chunks: DataFrame  # doc_id, chunk_index, first_page, last_page, n_pages, label
    texts: DataFrame  # doc_id, chunk_index, chunk_text
    keywords: DataFrame  # doc_id, chunk_index, ord, term, score
    clusters: DataFrame  # doc_id, chunk_index, label, cluster_ord, name, terms, scores; a null name where all clusters were filtered
    prompts: DataFrame  # doc_id, n_chars, prompt, status
    replies: DataFrame  # doc_id, status, error, n_concepts
    verified: DataFrame  # doc_id, concept, found, score, best_page
    clean: DataFrame  # concept_id (place in the reply), doc_id, name, prerequisites, extra
    flagged: DataFrame  # concept_id, doc_id, kind, ord, item
    report: DataFrame  # doc_id, section, at, ord, line
    metrics: DataFrame  # doc_id, n_pages, n_chunks, n_keywords, n_clusters, n_concepts, n_flagged, status


def keyword_stages(pages: DataFrame, stop_words: DataFrame, images: DataFrame | None = None, embed: chunking.Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, texts and keywords of the segmented pages; images (doc_id, page_number, context) join the texts."""
    assigned = materialize(chunking.semantic_chunks(pages, embed=embed))
    chunks = materialize(chunking.chunk_list(assigned))
    listed = assigned.select("doc_id", "chunk_index", F.array("page_number").alias("pages"))
    texts = materialize(chunking.chunk_text(pages, listed, images))
    found = materialize(keywords.topk_keywords(keywords.chunk_tokens(texts, stop_words), embed=embed))
    return chunks, texts, found


def run(pages: DataFrame, stop_words: DataFrame, chat: Callable[[Column], Column] | None = None, images: DataFrame | None = None,
        embed: chunking.Embedder | None = None, canary: bool = False) -> Run:
    """All stages. chat and embed are providers, by default the offline ones; images are descriptions as reports.image_descriptions takes them.

    With canary, a concept that no page supports joins each reply that is ok, and must
    come out flagged. Documents whose prompt is too large, whose call failed or whose
    reply cannot be read keep their status and have no concepts.
    """
    context = None if images is None else reports.page_image_context(images)
    chunks, texts, found = keyword_stages(pages, stop_words, context, embed)
    made = keywords.keyword_clusters(found) if embed is None else keywords.keyword_clusters(found, embed=embed)
    with_keywords = found.select("doc_id", "chunk_index").distinct()
    labels = chunks.select("doc_id", "chunk_index", "label")
    clusters = materialize(
        with_keywords.join(made, ["doc_id", "chunk_index"], "left").join(labels, ["doc_id", "chunk_index"])
        .select("doc_id", "chunk_index", "label", "cluster_ord", "name", "terms", "scores"))
    names = clusters.select("doc_id", "chunk_index", F.col("cluster_ord").alias("name_ord"), "name")
    prompted = materialize(concepts.prompts(chunks, names, chunking.toc_context(pages)))

    replies = concepts.ask(prompted, chat or provider(outline_chat, "string"))
    answered = replies.filter("status = 'ok'")
    read = concepts.parsed(answered).select("doc_id", "status", "error", F.coalesce(F.size("entries"), F.lit(0)).alias("n_concepts"))
    unanswered = replies.filter("status <> 'ok'").select("doc_id", "status", "error", F.lit(0).alias("n_concepts"))
    states = materialize(read.unionByName(unanswered))
    rows = concepts.reply_concepts(answered)
    if canary:
        extra = concepts.canary(states.filter("status = 'ok'").select("doc_id"))
        rows = rows.unionByName(extra.withColumns({"ord": F.lit((1 << 31) - 1), "extra": F.lit(None).cast("string")}))
    graph = materialize(rows.select(
        F.col("ord").cast("bigint").alias("concept_id"), "doc_id", "name", "prerequisites", "extra", F.lit(None).cast("timestamp").alias("deleted_at")))

    verified = materialize(concepts.verification(concepts.items(graph), concepts.built_index(pages), stop_words, embed=embed))
    supported = verified.filter("found").select("doc_id", F.col("concept").alias("name"))
    clean = materialize(concepts.clean_concepts(graph, supported))
    flagged = materialize(concepts.flagged(graph, supported))

    bodies = reports.chunk_lines(chunks, texts).select("doc_id", F.lit(0).alias("section"), F.col("chunk_index").cast("bigint").alias("at"), F.lit(0).alias("ord"), "line")
    grouped = reports.cluster_report(clusters).select("doc_id", F.lit(0).alias("section"), F.col("chunk_index").cast("bigint").alias("at"), F.lit(1).alias("ord"), F.col("report").alias("line"))
    final = reports.concept_report(clean, flagged, states.select("doc_id")).select(
        "doc_id", (F.col("part") + 1).alias("section"), F.coalesce("concept_id", F.lit(-1)).alias("at"), "ord", "line")
    report = bodies.unionByName(grouped).unionByName(final)

    def per_doc(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))

    metrics = chunking.page_counts(pages)
    for df, name in ((chunks, "n_chunks"), (found, "n_keywords"), (clusters.filter("name IS NOT NULL"), "n_clusters"), (clean, "n_concepts"), (flagged, "n_flagged")):
        metrics = metrics.join(per_doc(df, name), "doc_id", "left").fillna(0, [name])
    metrics = metrics.join(states.select("doc_id", "status"), "doc_id", "left")
    return Run(chunks, texts, found, clusters, prompted, states, verified, clean, flagged, report, metrics)
