"""Similarity of consecutive pages and segmentation into chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.vectors import cosine
from pagewright.operators.cleaning import clean_pages, toc_block
from pagewright.runtime import materialize

DROP, MIN_PAGES, MAX_PAGES = 0.45, 3, 20
#: Pages of one block. Only one small entry per block of a document is ever put into one row:
#: page numbers are 32-bit integers, so there are at most two million.
BLOCK = 1024
WORD = r"[\p{L}\p{N}]+"
#: A provider of embeddings: a text column to a column of array<float>.
Embedder = Callable[[Column], Column]


def embed_text(text: Column) -> Column:
    """What is compared: pages of 20 characters or less count as empty pages."""
    return F.when(F.length(text) > 20, text).otherwise(F.lit("empty page"))


def block_of(page: str) -> Column:
    return F.floor(F.col(page) / BLOCK).alias("block")


def page_order(rows: DataFrame, page: str) -> DataFrame:
    """doc_id, page, prev_page: each page of a document (distinct rows) with the one before it, null for its first.

    Within a block by a window; a block's first page follows the last one of the block
    before, which is found from one entry per block.
    """
    blocks = rows.groupBy("doc_id", block_of(page)).agg(F.max(page).alias("last"))
    entries = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "last"))).alias("bs"))
    before = entries.select("doc_id", F.explode(F.transform("bs", lambda b, i: F.struct(
        b["block"].alias("block"), F.when(i > 0, F.get("bs", i - 1)["last"]).alias("carried")))).alias("b")).select("doc_id", "b.*")
    inside = Window.partitionBy("doc_id", "block").orderBy(page)
    near = rows.select("doc_id", page, block_of(page)).withColumn("near", F.lag(page).over(inside))
    return near.join(before, ["doc_id", "block"]).select("doc_id", page, F.coalesce("near", "carried").alias("prev_page"))


def page_similarity(pages: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """doc_id, page_number, prev_page, sim: cosine with the page before; a document's first page gives no row.

    By default of word counts: integer dot products and norms, so that thresholds fall
    alike in any engine. A page's counts and those of the page before meet in one
    aggregation by page and word. With a provider, of its vectors.
    """
    clean = clean_pages(pages).select("doc_id", "page_number", embed_text(F.col("text")).alias("text"))
    order = page_order(clean.select("doc_id", "page_number"), "page_number").filter(F.col("prev_page").isNotNull())
    if embed is not None:
        vectors = materialize(clean.select("doc_id", "page_number", embed(F.col("text")).alias("e")))
        theirs = vectors.select("doc_id", F.col("page_number").alias("prev_page"), F.col("e").alias("f"))
        return order.join(vectors, ["doc_id", "page_number"]).join(theirs, ["doc_id", "prev_page"]).select(
            "doc_id", "page_number", "prev_page", cosine(F.col("e"), F.col("f")).alias("sim"))
    words = clean.select("doc_id", "page_number", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counts = words.groupBy("doc_id", "page_number", "word").agg(F.count(F.lit(1)).alias("tf"))
    following = order.select("doc_id", F.col("prev_page").alias("page_number"), F.col("page_number").alias("next_page"))
    zero = F.lit(0).cast("bigint")
    shifted = counts.join(following, ["doc_id", "page_number"]).select("doc_id", F.col("next_page").alias("page_number"), "word", zero.alias("tf"), F.col("tf").alias("before"))
    met = counts.withColumn("before", zero).unionByName(shifted).groupBy("doc_id", "page_number", "word").agg(F.sum("tf").alias("tf"), F.sum("before").alias("before"))
    sums = met.groupBy("doc_id", "page_number").agg(
        F.sum(F.col("tf") * F.col("tf")).alias("n1"), F.sum(F.col("before") * F.col("before")).alias("n2"), F.sum(F.col("tf") * F.col("before")).alias("dot"))
    sim = F.coalesce(F.try_divide(F.col("dot").cast("double"), F.sqrt(F.col("n1").cast("double") * F.col("n2"))), F.lit(0.0))
    return order.join(sums, ["doc_id", "page_number"], "left").select("doc_id", "page_number", "prev_page", sim.alias("sim"))


def step(size: Column, sim: Column, drop: float, least: int, most: int) -> Column:
    """The size of the current chunk once the next page is taken in: 1 if it starts a chunk."""
    starts = (size >= most) | ((sim < 1 - drop) & (size >= least))
    return F.when(sim.isNull() | starts, F.lit(1)).otherwise(size + 1)


def assigned_chunks(sims: DataFrame, drop: float = DROP, least: int = MIN_PAGES, most: int = MAX_PAGES) -> DataFrame:
    """doc_id, page_number, starts, chunk_index; sims has all pages, null sim for the first.

    The rule is a fold whose state is the chunk's size, at most `most`. So a block of
    pages acts as a map of the size it begins with to the size it ends with and the
    chunks begun in it: the maps of all blocks are made in parallel, one short entry
    per block is put in order to find what each block begins with, and each block is
    then folded from there.
    """
    blocks = sims.groupBy("doc_id", block_of("page_number")).agg(F.array_sort(F.collect_list(F.struct("page_number", "sim"))).alias("pages"))
    blocks = materialize(blocks)

    def fold(size: Column) -> Column:
        return F.aggregate("pages", F.struct(size.alias("size"), F.lit(0).alias("begun")), lambda s, p: F.struct(
            step(s["size"], p["sim"], drop, least, most).alias("size"),
            (s["begun"] + F.when(step(s["size"], p["sim"], drop, least, most) == 1, 1).otherwise(0)).alias("begun")))

    maps = blocks.select("doc_id", "block", F.transform(F.sequence(F.lit(1), F.lit(most)), fold).alias("to"))
    state = "struct<size:int,begun:bigint>"
    entry = F.aggregate(
        F.array_sort(F.collect_list(F.struct("block", "to"))),
        F.struct(F.lit(1).alias("size"), F.lit(0).cast("bigint").alias("begun"), F.array().cast(f"array<struct<block:bigint,entry:{state}>>").alias("out")),
        lambda s, m: F.struct(
            F.get(m["to"], s["size"] - 1)["size"].alias("size"),
            (s["begun"] + F.get(m["to"], s["size"] - 1)["begun"]).alias("begun"),
            F.concat(s["out"], F.array(F.struct(m["block"].alias("block"), F.struct(s["size"].alias("size"), s["begun"].alias("begun")).alias("entry")))).alias("out")),
        lambda s: s["out"])
    entries = maps.groupBy("doc_id").agg(entry.alias("es")).select("doc_id", F.explode("es").alias("e")).select("doc_id", "e.*")
    out = "array<struct<page_number:int,size:int>>"
    walked = blocks.join(entries, ["doc_id", "block"]).select("doc_id", "block", "entry", F.explode(F.aggregate(
        "pages",
        F.struct(F.col("entry.size").alias("size"), F.array().cast(out).alias("out")),
        lambda s, p: F.struct(
            step(s["size"], p["sim"], drop, least, most).alias("size"),
            F.concat(s["out"], F.array(F.struct(p["page_number"].alias("page_number"), step(s["size"], p["sim"], drop, least, most).alias("size")))).alias("out")),
        lambda s: s["out"])).alias("p"))
    starts = F.col("p.size") == 1
    upto = Window.partitionBy("doc_id", "block").orderBy("p.page_number").rowsBetween(Window.unboundedPreceding, 0)
    return walked.select("doc_id", "p.page_number", starts.alias("starts"), (F.col("entry.begun") + F.sum(starts.cast("int")).over(upto) - 1).alias("chunk_index"))


def semantic_chunks(pages: DataFrame, drop: float = DROP, least: int = MIN_PAGES, most: int = MAX_PAGES, embed: Embedder | None = None) -> DataFrame:
    """doc_id, page_number, chunk_index (0-based): every page in one chunk, in order; documents without pages give no rows."""
    return chunked(pages, page_similarity(pages, embed), drop, least, most)


def chunked(pages: DataFrame, sims: DataFrame, drop: float = DROP, least: int = MIN_PAGES, most: int = MAX_PAGES) -> DataFrame:
    every = pages.select("doc_id", "page_number").distinct().join(sims.select("doc_id", "page_number", "sim"), ["doc_id", "page_number"], "left")
    return assigned_chunks(every, drop, least, most).select("doc_id", "page_number", "chunk_index")


def chunk_list(assigned: DataFrame) -> DataFrame:
    """doc_id, chunk_index, first_page, last_page, n_pages, label (pages counted from 1)."""
    return assigned.groupBy("doc_id", "chunk_index").agg(
        F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count(F.lit(1)).alias("n_pages"),
    ).withColumn("label", label(F.col("chunk_index"), F.col("first_page"), F.col("last_page")))


def label(index: Column, first: Column, last: Column) -> Column:
    return F.format_string("CHUNK %d (Pages %d–%d)", index + 1, first + 1, last + 1)


def similarity_report(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line: one report line per pair of consecutive pages; it marks pages that start a chunk."""
    sims = materialize(page_similarity(pages))
    starts = chunked(pages, sims).groupBy("doc_id", "chunk_index").agg(F.min("page_number").alias("page_number"))
    marked = sims.join(starts, ["doc_id", "page_number"], "left")
    bar = F.rpad(F.repeat(F.lit("█"), (F.col("sim") * 20).cast("int")), 20, " ")
    line = F.concat(
        F.lit("  Page "), F.lpad((F.col("prev_page") + 1).cast("string"), 4, " "), F.lit(" → "), F.rpad((F.col("page_number") + 1).cast("string"), 4, " "),
        F.lit(" | "), bar, F.lit(" | "), F.format_string("%.3f", F.round("sim", 3)),
        F.when(F.col("chunk_index").isNotNull(), " ← BOUNDARY").otherwise(""))
    return marked.select("doc_id", "page_number", line.alias("line"))


def chunk_text(pages: DataFrame, chunks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_index, chunk_text: the chunk's pages in order, each under its head; pages under 20 characters give the head only.

    images (doc_id, page_number, context) follow a page's text, but for contents pages
    and pages that give the head only.
    A chunk lists at most MAX_PAGES pages, so what is put together in one row is bounded.
    Repeated chunk rows count once; listed pages that do not exist are left out.
    """
    content = clean_pages(pages).join(toc_block(pages).filter("in_toc_block").select("doc_id", "page_number", "in_toc_block"), ["doc_id", "page_number"], "left")
    toc = F.coalesce("in_toc_block", F.lit(False))
    body = F.col("text")
    if images is not None:
        content = content.join(images.select("doc_id", "page_number", "context"), ["doc_id", "page_number"], "left")
        body = F.when(~toc & (F.length("context") > 0), F.concat("text", F.lit("\n"), "context")).otherwise(F.col("text"))
    piece = F.concat(
        F.lit("\n\n===== PAGE "), (F.col("page_number") + 1).cast("string"), F.when(toc, " (TOC)").otherwise(""), F.lit(" =====\n"),
        F.when(toc | (F.length("text") >= 20), body).otherwise(""))
    listed = chunks.select("doc_id", "chunk_index", F.explode("pages").alias("page_number")).distinct()
    joined = listed.join(content.select("doc_id", "page_number", piece.alias("piece")), ["doc_id", "page_number"])
    parts = F.array_sort(F.collect_list(F.struct("page_number", "piece")))
    return joined.groupBy("doc_id", "chunk_index").agg(parts.alias("parts")).select(
        "doc_id", "chunk_index", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("chunk_text"))


def toc_context(pages: DataFrame) -> DataFrame:
    """doc_id, toc_context: the cleaned pages of the contents block (three at most), each with a line end."""
    inside = toc_block(pages).filter("in_toc_block").select("doc_id", "page_number").join(clean_pages(pages), ["doc_id", "page_number"])
    parts = F.array_sort(F.collect_list(F.struct("page_number", F.concat("text", F.lit("\n")).alias("text"))))
    return inside.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("toc_context"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count_distinct("page_number").alias("n_pages"))
