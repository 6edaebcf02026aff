"""Keyword candidates, their ranking, clusters of keywords and their coherence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.vectors import cosine, hashed_embedding
from pagewright.operators.chunking import Embedder, page_order
from pagewright.operators.cleaning import good_keyword, keyword_input, normal_term
from pagewright.runtime import materialize

TOP, NGRAMS, COHERENCE = 15, 3, 0.45


def chunk_tokens(texts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """doc_id, chunk_index, tokens: words of two letters or digits at least, lower case, without stop words.

    The stop list is broadcast: it is a fixed table of at most some thousand words.
    """
    tokens = F.regexp_extract_all(F.lower(keyword_input("chunk_text")), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    stops = stop_words.agg(F.collect_set(F.lower("word")).alias("stops"))
    return texts.select("doc_id", "chunk_index", tokens.alias("tokens")).join(F.broadcast(stops)).select(
        "doc_id", "chunk_index", F.filter("tokens", lambda t: ~F.array_contains("stops", t)).alias("tokens"))


def ngram_candidates(tokens: DataFrame, n: int = NGRAMS) -> DataFrame:
    """doc_id, chunk_index, term: the distinct runs of one to n tokens of each chunk."""

    def grams(k: int) -> F.Column:
        last = F.size("tokens") - k
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("tokens", i + 1, k), " "))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*(grams(k) for k in range(1, n + 1))))
    return tokens.select("doc_id", "chunk_index", F.explode_outer(every).alias("term")).filter(F.col("term").isNotNull())


def score_candidates(tokens: DataFrame) -> DataFrame:
    """doc_id, chunk_index, term, score: cosine of the candidate's and the chunk's word counts, 4 places (the offline provider).

    One shuffle by chunk: every later step keys on the chunk and more. A candidate's
    dot product is the sum of its positions' counts, and its own norm follows from
    which of its words are equal.
    """
    spread = tokens.repartition("doc_id", "chunk_index").select("doc_id", "chunk_index", F.posexplode_outer("tokens").alias("pos", "w0")).filter("w0 IS NOT NULL")
    chunk = Window.partitionBy("doc_id", "chunk_index")
    at = spread.withColumn("f0", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "chunk_index", "w0")))
    at = at.withColumn("norm", F.sum("f0").over(chunk))
    for k in range(1, NGRAMS):
        for c in ("w", "f"):
            at = at.withColumn(f"{c}{k}", F.lead(f"{c}0", k).over(chunk.orderBy("pos")))

    def gram(k: int) -> F.Column:
        words, places = [F.col(f"w{i}") for i in range(k)], range(k)
        own = F.lit(k)
        for a in places:
            for b in range(a + 1, k):
                own = own + F.when(words[a] == words[b], 2).otherwise(0)
        total = F.col("f0")
        for i in range(1, k):
            total = total + F.col(f"f{i}")
        # A run that the chunk's end cuts has a null total.
        return F.struct(F.concat_ws(" ", *words).alias("term"), total.alias("dot"), own.alias("own"))

    grams = at.select("doc_id", "chunk_index", "norm", F.explode(F.array(*(gram(k) for k in range(1, NGRAMS + 1)))).alias("g")).filter("g.dot IS NOT NULL")
    best = grams.groupBy("doc_id", "chunk_index", F.col("g.term").alias("term")).agg(F.max("g.dot").alias("dot"), F.max("g.own").alias("own"), F.max("norm").alias("norm"))
    score = F.col("dot").cast("double") / F.sqrt(F.col("own").cast("double") * F.col("norm"))
    return best.select("doc_id", "chunk_index", "term", F.round(score, 4).alias("score"))


def embedded_candidates(tokens: DataFrame, embed: Embedder) -> DataFrame:
    """As score_candidates, by a provider's vectors: each distinct candidate and each chunk's words are embedded once."""
    terms = materialize(ngram_candidates(tokens))
    vectors = materialize(terms.select("term").distinct().select("term", embed(F.col("term")).alias("e")))
    whole = tokens.select("doc_id", "chunk_index", embed(F.array_join("tokens", " ")).alias("f"))
    met = terms.join(vectors, "term").join(whole, ["doc_id", "chunk_index"])
    return met.select("doc_id", "chunk_index", "term", F.round(cosine(F.col("e"), F.col("f")), 4).alias("score"))


def topk_keywords(tokens: DataFrame, top: int = TOP, embed: Embedder | None = None) -> DataFrame:
    """doc_id, chunk_index, ord, term, score: the best candidates by score, then term; unsuitable ones are dropped after the cut."""
    best = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("score"), "term")
    ranked = (score_candidates(tokens) if embed is None else embedded_candidates(tokens, embed)).withColumn("ord", F.row_number().over(best) - 1).filter(F.col("ord") < top)
    return ranked.filter(good_keyword("term")).select("doc_id", "chunk_index", "ord", "term", "score")


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    """One row per chunk and normalised term: of repeated terms the last one's score and the first one's place. Null scores count as 0, null terms not at all."""
    rows = keywords.filter(F.col("term").isNotNull()).select("doc_id", "chunk_index", "ord", normal_term("term").alias("term"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.groupBy("doc_id", "chunk_index", "term").agg(F.min("ord").alias("ord"), F.max_by("score", F.struct("ord", "score")).alias("score"))


def cluster_count(keywords: DataFrame) -> DataFrame:
    """doc_id, chunk_index, n_terms, n_clusters: a third of the terms, two at least."""
    n = distinct_keywords(keywords).groupBy("doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("n_terms"))
    return n.withColumn("n_clusters", F.greatest(F.lit(2), F.least(F.floor(F.col("n_terms") / 3), F.col("n_terms") - 1)).cast("bigint"))


def average_linkage(vectors: np.ndarray, n_clusters: int) -> list[int]:
    """Cluster of each row, numbered by first appearance. Of equal distances the pair with the smallest first rows merges."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    dist = np.clip(1 - unit @ unit.T, 0, None).round(12)
    # Rows and columns stay in order of their first member, so the first smallest entry is the pair to merge.
    members = [[i] for i in range(len(vectors))]
    np.fill_diagonal(dist, np.inf)
    while len(members) > max(n_clusters, 1):
        i, j = sorted(divmod(int(dist.round(12).argmin()), len(members)))
        a, b = len(members[i]), len(members[j])
        row = (a * dist[i] + b * dist[j]) / (a + b)
        dist[i], dist[:, i] = row, row
        dist[i, i] = np.inf
        dist = np.delete(np.delete(dist, j, 0), j, 1)
        members[i] += members.pop(j)
    out = [0] * len(vectors)
    for k, m in enumerate(members):
        for i in m:
            out[i] = k
    return out


def word_embedding(term: F.Column) -> F.Column:
    return hashed_embedding(F.split(term, " "))


def keyword_clusters(keywords: DataFrame, threshold: float = COHERENCE, embed: Embedder = word_embedding) -> DataFrame:
    """doc_id, chunk_index, cluster_ord, name, terms, scores, coherence: average-linkage clusters of each chunk that are coherent.

    A chunk has at most some dozen keywords, so each is clustered in one task. Members
    are in order of score, then place; the name is the first's. Clusters of one term are
    never coherent. Terms without an embedding are left out (missing_embeddings counts them).
    """
    rows = distinct_keywords(keywords).withColumn("embedding", embed(F.col("term"))).filter(F.col("embedding").isNotNull())
    chunks = rows.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("ord", "term", "score", "embedding"))).alias("members"))

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, index, members in zip(batch["doc_id"], batch["chunk_index"], batch["members"]):
                n = len(members)
                terms, scores = [m["term"] for m in members], [m["score"] for m in members]
                vectors = np.array([m["embedding"] for m in members], dtype=float)
                norms = np.linalg.norm(vectors, axis=1)
                unit = vectors / np.where(norms > 0, norms, 1)[:, None]
                labels = average_linkage(vectors, max(2, min(n // 3, n - 1)))
                for k in range(max(labels) + 1):
                    at = sorted((i for i in range(n) if labels[i] == k), key=lambda i: (-scores[i], i))
                    total = unit[at].sum(axis=0)
                    coherence = float(total @ total) / len(at) ** 2 if len(at) > 1 else 0.0
                    if coherence >= threshold:
                        out.append((doc_id, index, k, terms[at[0]], [terms[i] for i in at], [scores[i] for i in at], round(coherence, 6)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "cluster_ord", "name", "terms", "scores", "coherence"])

    return chunks.mapInPandas(
        cluster, "doc_id string, chunk_index int, cluster_ord int, name string, terms array<string>, scores array<double>, coherence double")


def missing_embeddings(keywords: DataFrame, embed: Embedder = word_embedding) -> DataFrame:
    """doc_id, chunk_index, n_missing: terms that the provider gives no vector for; chunks without any give no row."""
    rows = distinct_keywords(keywords).filter(embed(F.col("term")).isNull())
    return rows.groupBy("doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("n_missing"))


def cluster_coherence(vectors: DataFrame, label: str = "label") -> DataFrame:
    """label, n_members, coherence: mean of the full cosine matrix of each group; 0 for groups of one.

    The mean over all pairs is the squared length of the sum of unit vectors over the
    squared size, so no pair is ever made and any group size will do.
    """
    unit = vectors.filter(F.col("embedding").isNotNull()).withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    parts = unit.select(label, "norm", F.posexplode("embedding").alias("at", "x"))
    sums = parts.groupBy(label, "at").agg(F.sum(F.coalesce(F.try_divide(F.col("x").cast("double"), "norm"), F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(label).agg(F.max("n").alias("n_members"), F.sum(F.col("s") * F.col("s")).alias("sq")).select(
        label, "n_members", F.round(F.when(F.col("n_members") > 1, F.col("sq") / (F.col("n_members") * F.col("n_members"))).otherwise(0.0), 6).alias("coherence"))


def cosine_pairs(page_index: DataFrame) -> DataFrame:
    """doc_id, page, cosine, distance: each indexed page with the one before it in the document, by their embeddings.

    Of pages indexed twice the last counts (then the greater index_id); rows without an embedding are left out.
    """
    rows = materialize(page_index.filter(F.col("embedding").isNotNull()).groupBy("doc_id", "page").agg(F.max_by("embedding", F.struct("indexed_at", "index_id")).alias("e")))
    order = page_order(rows.select("doc_id", "page"), "page").filter(F.col("prev_page").isNotNull())
    theirs = rows.select("doc_id", F.col("page").alias("prev_page"), F.col("e").alias("f"))
    pairs = order.join(rows, ["doc_id", "page"]).join(theirs, ["doc_id", "prev_page"])
    sim = cosine(F.col("e"), F.col("f"))
    return pairs.select("doc_id", "page", F.round(sim, 6).alias("cosine"), F.round(F.greatest(1 - sim, F.lit(0.0)), 6).alias("distance"))
