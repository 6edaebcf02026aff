"""Page cleaning and other text rules, as expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import col, strip

# What the cleaning rules look for.
JUNK_GLYPHS = "\ufffd\u25a0\u25cf\u2022\u00b7\u2013\u2014\u00a0"
LEGAL_HEADS = "credits|copyright notice|licensing information|creative commons attribution"
BAD_PHRASES = (
    "copyright", "creative commons", "licensed", "licenced", "open up resources", "illustrative mathematics", "core knowledge", "photo credits",
    "illustration", "all rights reserved", "do not reproduce", "may not be reproduced", "for classroom use", "©",
)
BAD_KEYWORDS = "students?|teacher|activity|lesson|work|discussion|group|practice|example|problem|page"
TOC_HEADS = ("table of contents", "unit overview", "section overview", "concept overview")
MIN_ALPHA, ALPHA_SHARE = 5, 0.4


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases: plain searches, cheaper than a pattern of alternatives."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in phrases))


def lines_of(text: Column | str) -> Column:
    """Stripped lines of a text once line ends, control characters, glyphs, leaders and legal blocks are dealt with.

    A legal block goes from its head line to the next empty line, or to the text's end
    if that ends with a line end. The pattern is possessive: a lazy one would overflow
    the stack on long blocks.
    """
    t = F.regexp_replace(col(text), "\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x09\x0b-\x1f\x7f]", " ")
    t = F.translate(t, JUNK_GLYPHS, " " * len(JUNK_GLYPHS))
    t = F.regexp_replace(t, r"\.{2,}", " ")
    t = F.regexp_replace(t, r"(?:\. ){2,}", " ")
    t = F.regexp_replace(t, rf"(?dmi)^(?:{LEGAL_HEADS})[^\n]*\n(?:[^\n]++\n)*+(?=\n|\z)", "")
    return F.transform(F.split(t, r"[\n\x85\x{2028}\x{2029}]"), lambda x: strip(F.regexp_replace(x, " {2,}", " ")))


def kept_line(line: Column) -> Column:
    """Whether a stripped line is content: no running head, no legal phrase, letters enough."""
    low = F.lower(line)
    alpha = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    return (
        ~F.regexp(low, F.lit(r"(?U)^(?:grade|unit|lesson|page)\s*\d+$"))
        & ~holds(low, BAD_PHRASES)
        & (alpha >= MIN_ALPHA)
        & (alpha.cast("double") / F.greatest(F.length(line), F.lit(1)) > ALPHA_SHARE)
    )


def clean_text(text: Column | str) -> Column:
    """The kept lines, joined by line ends. Null for null."""
    return F.array_join(F.filter(lines_of(text), kept_line), "\n")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per (doc_id, page_number): the text loaded last; of equal times the greater text. Null texts count as empty."""
    newest = F.max(F.struct("loaded_at", F.coalesce("raw_text", F.lit("")).alias("raw_text")))
    return pages.groupBy("doc_id", "page_number").agg(newest.alias("r")).select("doc_id", "page_number", F.col("r.raw_text").alias("raw_text"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, raw_text, text: each page once, cleaned once."""
    return latest_pages(pages).withColumn("text", clean_text("raw_text"))


def clean_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no (among kept lines, 0-based), line."""
    kept = latest_pages(pages).select("doc_id", "page_number", F.posexplode(F.filter(lines_of("raw_text"), kept_line)).alias("line_no", "line"))
    return kept.withColumn("line_no", F.col("line_no").cast("bigint"))


def keyword_input(text: Column | str) -> Column:
    """Text without image marks, for the keyword extractor."""
    t = col(text)
    for pattern, by in ((r"\[IMAGE \d+:\s*", ""), (r"\]", ""), (r"Text in image:\s*", ""), (r"Visual:\s*", ""), (r"\|", " "), (" {2,}", " ")):
        t = F.regexp_replace(t, pattern, by)
    return t


def normal_term(term: Column | str) -> Column:
    return F.lower(strip(F.regexp_replace(col(term), r"(?U)\s+", " ")))


def good_keyword(term: Column | str) -> Column:
    """At most four words, none of those that tell classroom business."""
    return (F.size(F.split(normal_term(term), " ")) <= 4) & ~F.regexp(F.lower(col(term)), F.lit(rf"(?U)\b(?:{BAD_KEYWORDS})\b"))


def squeeze(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)\s+", " ")


def strip_fences(raw: Column | str) -> Column:
    """A reply without the fences of a code block around it."""
    t = F.regexp_replace(strip(raw), r"\A```json\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"\A```\s*", ""), r"\s*```\z", "")


def is_toc(raw: Column | str) -> Column:
    """A contents page: a head phrase, or three lines or more that end in leaders and a number."""
    shaped = F.filter(F.split(col(raw), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: F.regexp(x, F.lit(r"(?U)^.{5,}[.\s]{3}\d+\s*$")))
    # The pattern with its word borders is tried only where a phrase is.
    head = holds(F.lower(col(raw)), TOC_HEADS) & F.regexp(col(raw), F.lit(rf"(?iU)\b(?:{'|'.join(TOC_HEADS)})\b"))
    return head | (F.size(shaped) >= 3)


def toc_block(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, is_toc, in_toc_block: the first run of contents pages, three at most, never opened again.

    Only the three pages from the first contents page on can belong to it, so a
    document's first one is found by aggregation and no document is sorted as a whole.
    """
    flagged = latest_pages(pages).select("doc_id", "page_number", is_toc("raw_text").alias("is_toc"))
    first = flagged.groupBy("doc_id").agg(
        F.min(F.when(F.col("is_toc"), F.col("page_number"))).alias("first"))
    near = flagged.join(first, "doc_id").filter((F.col("page_number") > F.col("first")) & (F.col("page_number") < F.col("first") + 3))
    stop = near.filter(~F.col("is_toc")).groupBy("doc_id").agg(F.min("page_number").alias("stop"))
    ends = first.join(stop, "doc_id", "left").select("doc_id", "first", F.coalesce("stop", F.col("first") + 3).alias("stop"))
    inside = F.col("is_toc") & (F.col("page_number") >= F.col("first")) & (F.col("page_number") < F.col("stop"))
    return flagged.join(ends, "doc_id").select("doc_id", "page_number", "is_toc", F.coalesce(inside, F.lit(False)).alias("in_toc_block"))
