"""Prompts, replies of a language model, and the check of their concepts against the pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.vectors import cosine
from pagewright.operators.chunking import Embedder
from pagewright.operators.cleaning import clean_pages, strip_fences
from pagewright.operators.nearest import PAGE_BLOCK, PLACES, WordFilter, nearest_in_blocks, page_bags
from pagewright.runtime import materialize

MAX_PROMPT, FOUND_AT = 20_000, 0.5
NO_WORD = r"[^\p{L}\p{N}]+"
#: A concept that no curriculum page supports, for self-checks.
CANARY = ("quantum entanglement theory", ["relativistic calculus", "wave function collapse"])

# Fixed text of the prompt; {toc} and {clusters} are filled in.
PROMPT = """
You are a curriculum analyst.
Below is the ONLY source of truth, use the table of contents if present and the topic clusters extracted from each 
section of a curriculum document. Your job is to use your relational reasoning to identify and link educational concepts
and their prerequisite relationships. Pass through all TOC context and cluster names to inform your analysis.
Ignore any cluster that refers to materials, objects, or activities rather than curriculum concepts.
{toc}

ALL TOPIC CLUSTERS BY SECTION:
{clusters}

Your task:
1. Identify all distinct educational concepts.
2. For each concept, list its prerequisites — concepts a student must 
   understand BEFORE learning it.
3. IMPORTANT: Prerequisites must only come from concepts that also appear 
   in the clusters above. Do not invent external prerequisites.
4. Avoid making concept names too broad or too narrow and do not create duplicate concepts. Use your judgment to find the right level of granularity.
5. If a concept has no prerequisites within this curriculum, set prerequisites to [].
6. Recognize students level based on  curriculum context and avoid suggesting prerequisites that are advanced for curriculum's target audience.

Return ONLY valid JSON, no explanation, no markdown:
{
  "concepts": [
    {
      "name": "concept name",
      "prerequisites": ["prerequisite 1", "prerequisite 2",...]
    }
  ]
}
"""


def prompts(chunks: DataFrame, names: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, n_chars, prompt, status: one prompt per document with chunks; one over MAX_PROMPT characters is measured, not put together (null).

    names(doc_id, chunk_index, name_ord, name) are the clusters of the chunks that have
    keywords. A chunk without a row there had no keywords and does not appear; one whose
    only row has a null name lost all its clusters to the filter and stays as an empty
    section. The label of a chunk is taken from chunks.
    """
    line = F.concat(F.lit("    - "), "name", F.lit("\n"))
    known = names.withColumn("line", F.coalesce(line, F.lit("")))
    labels = chunks.groupBy("doc_id", "chunk_index").agg(F.coalesce(F.max("label"), F.lit("")).alias("label"))
    head, rest = PROMPT.split("{toc}")
    middle, tail = rest.split("{clusters}")
    contents = F.coalesce("toc_context", F.lit(""))
    # Lengths first: only what fits into a prompt is ever put into one row.
    per_chunk = known.groupBy("doc_id", "chunk_index").agg(F.sum(F.length("line")).alias("n")).join(labels, ["doc_id", "chunk_index"])
    per_doc = per_chunk.groupBy("doc_id").agg(F.sum(F.col("n") + F.length("label") + 4).alias("n"))
    sized = chunks.select("doc_id").distinct().join(per_doc, "doc_id", "left").join(toc, "doc_id", "left").withColumn(
        "n_chars", F.coalesce("n", F.lit(0)) + F.length(contents) + len(head + middle + tail))
    fits = sized.filter(F.col("n_chars") <= MAX_PROMPT).select("doc_id")
    sections = known.join(fits, "doc_id", "left_semi").groupBy("doc_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("name_ord", "line"))).alias("ls")).join(labels, ["doc_id", "chunk_index"])
    section = F.concat(F.lit("\n  "), "label", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "")).alias("section")
    body = sections.select("doc_id", "chunk_index", section).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "section"))).alias("ss"))
    listed = F.coalesce(F.array_join(F.transform("ss", lambda x: x["section"]), ""), F.lit(""))
    text = F.concat(F.lit(head), contents, F.lit(middle), listed, F.lit(tail))
    fit = F.col("n_chars") <= MAX_PROMPT
    return sized.join(body, "doc_id", "left").select(
        "doc_id", "n_chars", F.when(fit, text).alias("prompt"), F.when(fit, "ok").otherwise("prompt_too_large").alias("status"))


def ask(prompted: DataFrame, chat: Callable[[Column], Column]) -> DataFrame:
    """doc_id, raw, status, error: what a chat provider (struct<value, error>) answers to the prompts that fit; written once, as answers vary.

    Prompts that do not fit are not sent and keep their status; a failed call is llm_error.
    """
    sent = materialize(prompted.filter("status = 'ok'").select("doc_id", chat(F.col("prompt")).alias("a")).select("doc_id", "a.value", "a.error"))
    answered = sent.select("doc_id", F.col("value").alias("raw"), F.when(F.col("error").isNull() & F.col("value").isNotNull(), "ok").otherwise("llm_error").alias("status"), "error")
    unsent = prompted.filter("status <> 'ok'").select("doc_id", F.lit(None).cast("string").alias("raw"), "status", F.lit(None).cast("string").alias("error"))
    return answered.unionByName(unsent)


def parsed(rows: DataFrame) -> DataFrame:
    """rows (with raw) and body, entries, status.

    ok where the body is an object with a list of concepts that all have a name and
    prerequisites; json_error where it is no JSON; llm_error where it is JSON of another
    shape, or no reply came.
    """
    body = rows.withColumn("body", strip_fences("raw"))
    # A null marks a body that is not JSON as a whole; from_json alone would also read a broken one's beginning.
    whole = F.try_parse_json("body").isNotNull()
    entries = F.from_json("body", "struct<concepts:array<map<string,string>>>")["concepts"]
    shaped = F.when(whole, entries)
    good = F.coalesce(F.forall(shaped, lambda e: F.coalesce(F.map_contains_key(e, "name") & F.map_contains_key(e, "prerequisites"), F.lit(False))), F.lit(False))
    out = body.withColumn("entries", F.when(good, shaped))
    return out.withColumn("status", F.when(F.col("raw").isNull(), "llm_error").when(good, "ok").when(whole, "llm_error").otherwise("json_error"))


def parse_replies(raw: DataFrame) -> DataFrame:
    """reply_id, doc_id, body, status (see parsed), n_concepts per distinct reply."""
    replies = parsed(raw.select("reply_id", "doc_id", "raw").distinct())
    return replies.select("reply_id", "doc_id", "body", "status", F.coalesce(F.size("entries"), F.lit(0)).cast("bigint").alias("n_concepts"))


def reply_concepts(replies: DataFrame) -> DataFrame:
    """doc_id, ord, name, prerequisites, extra (JSON object of the further keys) of the replies (doc_id, raw) that are ok, in their order."""
    rows = parsed(replies).filter("status = 'ok'").select("doc_id", F.posexplode("entries").alias("ord", "e"))
    rest = F.map_filter("e", lambda k, v: ~k.isin("name", "prerequisites"))
    return rows.select(
        "doc_id", "ord", F.col("e")["name"].alias("name"), F.from_json(F.col("e")["prerequisites"], "array<string>").alias("prerequisites"),
        F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"))


def canary(doc_ids: DataFrame) -> DataFrame:
    """The self-check concept for each document: doc_id, name, prerequisites. Opt-in: unionByName it to the concepts."""
    name, prerequisites = CANARY
    return doc_ids.select("doc_id", F.lit(name).alias("name"), F.array(*map(F.lit, prerequisites)).alias("prerequisites"))


def given_index(page_index: DataFrame) -> DataFrame:
    """doc_id, page, text of an indexed table: pages of more than 20 characters, of those indexed twice the last."""
    return page_index.filter(F.length("text") > 20).groupBy("doc_id", "page").agg(F.max_by("text", F.struct("indexed_at", "index_id")).alias("text"))


def given_versions(page_index: DataFrame) -> DataFrame:
    """doc_id, page, text, version: as given_index, but with all rows of a page; nearest_by_words takes the last version."""
    return page_index.filter(F.length("text") > 20).select("doc_id", "page", "text", F.struct("indexed_at", "index_id").alias("version"))


def built_index(pages: DataFrame) -> DataFrame:
    """doc_id, page (1-based), text: the cleaned pages of more than 20 characters."""
    return clean_pages(pages).filter(F.length("text") > 20).select("doc_id", (F.col("page_number") + 1).alias("page"), "text")


def spaced(c: str) -> Column:
    """The words of a text in lower case, separated by spaces."""
    return F.regexp_replace(F.lower(c), NO_WORD, " ")


def word_filter(names: DataFrame) -> WordFilter:
    """The words of all names, in a filter of fixed size."""
    words = names.select(F.explode(F.split(spaced("name"), " ")).alias("word"))
    place = F.pmod(F.crc32("word"), F.lit(PLACES)) + 1  # Spark's buckets of places begin at 1
    places = words.agg(F.collect_set(place).alias("places")).select(F.explode("places").alias("place"))  # one set of a task, of PLACES at most
    bits = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    return WordFilter({r.bucket - 1: bytes(r.bits) for r in bits.collect()})


def nearest_by_words(names: DataFrame, index: DataFrame, stop_words: DataFrame) -> DataFrame:
    """doc_id, name, page, sim: each distinct name's nearest page in every block of pages of its document, by the cosine of word counts.

    A document has as many blocks as PAGE_BLOCK of its pages need, whatever their numbers
    are; a page's versions are in one. A name that shares no word with block 0 has a null
    page and sim there, so that every name has one row at least. Of a page, only the words
    that some name has, and the length of all, are shuffled once, by document and block;
    names follow them: to block 0, and to the further blocks of their document. Names and
    pages that share a word are never listed (WordBlock). The stop list and the filter of
    words go to every task.
    """
    stops = frozenset(r.word for r in stop_words.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct().collect())
    named = names.filter(F.col("name").isNotNull()).select("doc_id", "name")
    asked_words = word_filter(named)  # from all names, as distinct ones would be shuffled for it
    paged = index.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    counts = paged.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PAGE_BLOCK).alias("n_blocks"))
    # At most one row per PAGE_BLOCK pages, so it can be broadcast; written once, as pages and names read it.
    further = F.broadcast(materialize(counts.filter("n_blocks > 1")))
    version = F.col("version") if "version" in index.columns else F.lit(0)
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    texts = paged.select("doc_id", "page", version.alias("version"), spaced("text").alias("words"))
    bags = texts.mapInArrow(lambda batches: page_bags(batches, stops, asked_words), texts.withColumn("rest", F.lit(0).cast("bigint")).schema)
    theirs = bags.join(further, "doc_id", "left").select(
        "doc_id", F.pmod(F.xxhash64("page"), n_blocks).alias("block"), F.lit(0).alias("kind"), "page", "version", "rest", F.col("words").alias("text"))
    kinds = {f.name: f.dataType for f in theirs.schema}
    own = named.distinct().join(further, "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)).alias("block"), "name").select(
        "doc_id", "block", F.lit(1).alias("kind"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("page", "version", "rest")], F.col("name").alias("text"))
    met = theirs.unionByName(own).repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "kind", "page", "version")
    asks = F.col("kind") == 1
    rows = met.select("doc_id", "block", "kind", "page", "rest", F.when(asks, F.col("text")).alias("name"), F.when(asks, spaced("text")).otherwise(F.col("text")).alias("words"))
    return rows.mapInArrow(lambda batches: nearest_in_blocks(batches, stops), "doc_id string, name string, page int, sim double")


def nearest_by_vectors(asked: DataFrame, index: DataFrame, embed: Embedder, block: int = 256) -> DataFrame:
    """doc_id, name, page, sim: each name's nearest page in every block of pages of its document, by a provider's vectors.

    Each name and page is embedded once. A row holds a block of vectors, so a name meets
    a document's pages in as many rows as it has blocks.
    """
    names = materialize(asked.select("doc_id", "name", embed(F.col("name")).alias("e")))
    vectors = materialize(index.select("doc_id", "page", embed(F.col("text")).alias("v")))
    blocks = vectors.groupBy("doc_id", F.floor(F.col("page") / block).alias("block")).agg(F.collect_list(F.struct("page", "v")).alias("vs"))
    best = F.array_max(F.transform("vs", lambda p: F.struct(cosine(F.col("e"), p["v"]).alias("sim"), (-p["page"]).alias("down"))))
    return names.join(blocks, "doc_id").select("doc_id", "name", best.alias("b")).select("doc_id", "name", (-F.col("b.down")).alias("page"), "b.sim")


def verify(names: DataFrame, index: DataFrame, stop_words: DataFrame | None = None, embed: Embedder | None = None) -> DataFrame:
    """doc_id, name, best, best_page: the page (doc_id, page, text) that is nearest to each distinct name, 0 and null without any.

    By word counts without stop words, or by the vectors of a provider. Names are
    compared once however often they occur. Of equal pages the first counts.
    """
    if embed is None:
        sims = nearest_by_words(names, index, stop_words)
    else:
        asked = names.filter(F.col("name").isNotNull()).select("doc_id", "name").distinct()
        sims = asked.join(nearest_by_vectors(asked, index, embed), ["doc_id", "name"], "left")
    best = sims.groupBy("doc_id", "name").agg(F.max("sim").alias("best"), F.max_by("page", F.struct("sim", -F.col("page"))).alias("best_page"))
    return best.select("doc_id", "name", F.coalesce("best", F.lit(0.0)).alias("best"), "best_page")


def verification(names: DataFrame, index: DataFrame, stop_words: DataFrame | None = None, threshold: float = FOUND_AT, embed: Embedder | None = None) -> DataFrame:
    """doc_id, concept, found (by the unrounded score), score (3 places), best_page."""
    return verify(names, index, stop_words, embed).select(
        "doc_id", F.col("name").alias("concept"), (F.col("best") >= threshold).alias("found"), F.round("best", 3).alias("score"), "best_page")


def supported(names: DataFrame, index: DataFrame, stop_words: DataFrame, threshold: float = FOUND_AT) -> DataFrame:
    """(doc_id, name), distinct: the names that verification finds by word counts, without the scores and pages of all.

    A name is found where a block has a page that is near enough, so what is not near
    goes no further. The threshold must be above 0, which names without any page have.
    """
    return nearest_by_words(names, index, stop_words).filter(F.col("sim") >= threshold).select("doc_id", "name").distinct()


def current(concepts: DataFrame) -> DataFrame:
    """The concepts that count: not deleted, with a document and a name."""
    return concepts.filter(F.col("deleted_at").isNull() & F.col("doc_id").isNotNull() & F.col("name").isNotNull()).select("concept_id", "doc_id", "name", "prerequisites", *([c for c in ("extra",) if c in concepts.columns]))


def items(concepts: DataFrame) -> DataFrame:
    """(doc_id, name): what is to be checked, each current concept's name and each of its prerequisites, as written; repeats are left to verification."""
    asked = F.concat(F.array("name"), F.coalesce("prerequisites", F.array().cast("array<string>")))
    return current(concepts).select("doc_id", F.explode(asked).alias("name")).filter(F.col("name").isNotNull())


def found_names(verified: DataFrame) -> DataFrame:
    """(doc_id, name) that a verification table found last; of checks at the same time the found one."""
    rows = verified.filter(F.col("concept").isNotNull() & F.col("doc_id").isNotNull() & F.col("found").isNotNull())
    last = rows.groupBy("doc_id", F.col("concept").alias("name")).agg(F.max(F.struct("checked_at", "found")).alias("r"))
    return last.filter("r.found").select("doc_id", "name")


def clean_concepts(concepts: DataFrame, found: DataFrame) -> DataFrame:
    """concept_id, doc_id, name, prerequisites, extra (where concepts has it): found concepts with their found prerequisites, in order; none left gives an empty list."""
    kept = current(concepts).join(found, ["doc_id", "name"], "left_semi")
    entries = kept.select("concept_id", "doc_id", F.posexplode("prerequisites").alias("pos", "name")).join(found, ["doc_id", "name"], "left_semi")
    lists = entries.groupBy("doc_id", "concept_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("entries"))
    left = F.coalesce(F.transform("entries", lambda e: e["name"]), F.array().cast("array<string>"))
    return kept.drop("prerequisites").join(lists, ["doc_id", "concept_id"], "left").withColumn("prerequisites", left).drop("entries")


def flagged(concepts: DataFrame, found: DataFrame) -> DataFrame:
    """concept_id, doc_id, kind, ord, item: concepts and prerequisites that were not found, repeats kept.

    Prerequisites of a flagged concept are not looked at.
    """
    rows = current(concepts)
    lost = rows.join(found, ["doc_id", "name"], "left_anti").select("concept_id", "doc_id", F.lit("concept").alias("kind"), F.lit(-1).alias("ord"), F.col("name").alias("item"))
    entries = rows.join(found, ["doc_id", "name"], "left_semi").select("concept_id", "doc_id", F.posexplode("prerequisites").alias("ord", "name"))
    bad = entries.filter(F.col("name").isNotNull()).join(found, ["doc_id", "name"], "left_anti").select(
        "concept_id", "doc_id", F.lit("prerequisite").alias("kind"), "ord", F.col("name").alias("item"))
    return lost.unionByName(bad)
