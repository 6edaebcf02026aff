"""Report lines, image descriptions and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The texts of the reports here are those that readers of the format expect.
RULE = "═" * 54


def cluster_report(clusters: DataFrame) -> DataFrame:
    """doc_id, chunk_index, report: head, and each cluster's name with its members (doc_id, chunk_index, label, cluster_ord, name, terms, scores)."""
    members = F.array_join(F.zip_with("terms", "scores", lambda t, s: F.concat(F.lit("      "), t, F.lit(": "), F.format_string("%.3f", F.round(s, 3)), F.lit("\n"))), "")
    body = clusters.select("doc_id", "chunk_index", "label", "cluster_ord", F.concat(F.lit("\n  ["), F.upper("name"), F.lit("]\n"), members).alias("body"))
    parts = F.array_sort(F.collect_list(F.struct("cluster_ord", "body")))
    return body.groupBy("doc_id", "chunk_index").agg(F.max("label").alias("label"), parts.alias("parts")).select(
        "doc_id", "chunk_index",
        F.concat(F.lit("\n===== KEYWORD CLUSTERS FOR "), F.coalesce("label", F.lit("")), F.lit(" =====\n"), F.array_join(F.transform("parts", lambda p: p["body"]), "")).alias("report"))


def concept_lines(concepts: DataFrame) -> DataFrame:
    """concept_id, doc_id, line: one report entry per concept."""
    names = F.filter("prerequisites", lambda p: p.isNotNull())
    listed = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("None")
    return concepts.select("concept_id", "doc_id", F.concat(
        F.lit("  Concept: "), F.coalesce("name", F.lit("Unknown")), F.lit("\n  Prerequisites: "), listed, F.lit("\n\n")).alias("line"))


def concept_report(concepts: DataFrame, flagged: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, part, concept_id, ord, line: the final report as ordered lines: head (0), concepts (1), head of the flagged (2), flagged (3).

    A document without concepts but with flagged items says that none were extracted,
    as does one of documents (doc_id) that has neither.
    Lines stay rows: a report is put together by its order, not in one cell.
    """
    entries = concept_lines(concepts).select("doc_id", F.lit(1).alias("part"), "concept_id", F.lit(-1).alias("ord"), "line")
    bad = flagged.select("doc_id", F.lit(3).alias("part"), "concept_id", "ord", F.concat(F.lit("  ⚠ "), "item", F.lit("\n")).alias("line"))
    held = entries.select("doc_id", F.lit(1).alias("c"), F.lit(0).alias("f")).union(bad.select("doc_id", F.lit(0), F.lit(1)))
    if documents is not None:
        held = held.union(documents.select("doc_id", F.lit(0), F.lit(0)))
    docs = held.groupBy("doc_id").agg(F.max("c").alias("c"), F.max("f").alias("f"))

    def head(part: int, line: Column) -> DataFrame:
        return docs.select("doc_id", "c", "f", F.lit(part).alias("part"), F.lit(None).cast("bigint").alias("concept_id"), F.lit(-1).alias("ord"), line.alias("line"))

    title = F.lit(f"\n\n{RULE}\n  FINAL CONCEPTS AND PREREQUISITES\n{RULE}\n")
    heads = head(0, title).drop("c", "f").unionByName(head(1, F.lit("  No concepts extracted.\n")).filter("c = 0").drop("c", "f")).unionByName(
        head(2, F.lit(f"\n{RULE}\n  FLAGGED HALLUCINATIONS\n{RULE}\n")).filter("f = 1").drop("c", "f"))
    return heads.unionByName(entries).unionByName(bad)


def image_descriptions(images: DataFrame) -> DataFrame:
    """doc_id, page_number, img_index, description of images of 100 pixels at least each way.

    Columns ocr_text, caption, error (of the description) and extract_error (of reading
    the image) come from providers; the index counts small images too.
    """
    ocr = F.trim(F.regexp_replace("ocr_text", r"(?U)\s+", " "))
    parts = F.concat_ws(" | ", F.when(F.length(ocr) > 5, F.concat(F.lit("Text in image: "), ocr)), F.when(F.length(F.trim("caption")) > 0, F.concat(F.lit("Visual: "), F.trim("caption"))))
    described = F.when(F.col("error").isNotNull(), F.concat(F.lit("[Image analysis failed: "), "error", F.lit("]"))).when(parts == "", "[Image: no content detected]").otherwise(parts)
    text = F.when(F.col("extract_error").isNotNull(), F.concat(F.lit("Could not extract — "), "extract_error")).otherwise(described)
    big = images.filter((F.col("width") >= 100) & (F.col("height") >= 100))
    return big.select("doc_id", "page_number", "img_index", F.concat(F.lit("[IMAGE "), (F.col("img_index") + 1).cast("string"), F.lit(": "), text, F.lit("]")).alias("description"))


def page_image_context(images: DataFrame) -> DataFrame:
    """doc_id, page_number, context: a page's descriptions, a line each, between line ends."""
    parts = F.array_sort(F.collect_list(F.struct("img_index", "description")))
    return image_descriptions(images).groupBy("doc_id", "page_number").agg(parts.alias("parts")).select(
        "doc_id", "page_number", F.concat(F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["description"]), "\n"), F.lit("\n")).alias("context"))


def concepts_json(concepts: DataFrame) -> DataFrame:
    """doc_id, value: the concept graph of each document as one JSON object {"concepts": [...]}, further keys of a concept beside its own.

    In the order of concept_id, or of the names where there is none. A graph comes from
    one reply of a model, so it fits into a row.
    """
    extra = F.col("extra") if "extra" in concepts.columns else F.lit(None).cast("string")
    own = F.to_json(F.struct("name", "prerequisites"))
    # Both are objects; the further keys go before the last brace.
    one = F.when(F.length(extra) > 2, F.concat(F.left(own, F.length(own) - 1), F.lit(","), F.substr(extra, F.lit(2)))).otherwise(own)
    order = "concept_id" if "concept_id" in concepts.columns else "name"
    parts = F.array_sort(F.collect_list(F.struct(order, one.alias("one"))))
    return concepts.groupBy("doc_id").agg(parts.alias("ps")).select(
        "doc_id", F.concat(F.lit('{"concepts":['), F.array_join(F.transform("ps", lambda p: p["one"]), ","), F.lit("]}")).alias("value"))


def chunk_lines(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, chunk_index, line: the head and text of each chunk."""
    labels = chunks.groupBy("doc_id", "chunk_index").agg(F.coalesce(F.max("label"), F.lit("")).alias("label"))
    return texts.join(labels, ["doc_id", "chunk_index"]).select(
        "doc_id", "chunk_index", F.concat(F.lit("\n\n===== "), "label", F.lit(" =====\n"), "chunk_text").alias("line"))


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text, ordered within each document, a folder per document."""
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "part", "concept_id", "ord").select("doc_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_concepts(concepts: DataFrame, path: str) -> None:
    """Write the concept graph of each document, a folder per document."""
    concepts_json(concepts).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)
