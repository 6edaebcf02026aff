"""Text quality statistics and natural prose (problem 4).

Method: huge texts are cut into chunks that are spread over the cluster; every chunk
gives partial counts that add up, with the state at its borders carried along so that
a word or sentence that two chunks share is counted once; the counts are merged by
partial and final aggregation, and ratios and the outcome of the rule are derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import plain_space
from pagewright.runtime import materialize

#: Texts over this many characters are cut into chunks of about this many.
CHUNK = 50_000
#: Stop words are matched from a set inside the plan; more than this are refused.
MAX_STOP_WORDS = 20_000

#: ASCII first: the classes of other scripts are slower to test.
TOKEN = r"[[a-zA-Z0-9][\p{L}\p{N}]]+"
#: Texts are read with plain white space: blanks and line ends only.
#: Segments end at a line's end or after a sentence's last mark.
SEGMENT_END = r"(?s)(?:\n|[ ](?<=[.!?…].))[ \n]*+"
#: Where the first line starts; where any other line starts; a line's last character if it is punctuation.
FIRST_LINE, LINE_START = r"\A *+[^ \n]", r"\n[ \n]*+(?=[^ \n])"
PUNCT_LAST, TEXT_PUNCT_LAST = r"[[^a-zA-Z0-9 ]&&\p{P}](?= *+\n)", r"[[^a-zA-Z0-9 ]&&\p{P}](?= *+(?:\n|\z))"

#: A segment is running text if it has common words, they are at least this share of
#: its words, words in letters are this share of its tokens, and no more than this
#: share of them repeat the word before.
COMMON_SHARE, LETTER_SHARE, REPEAT_SHARE = 0.17, 0.6, 0.25
#: A text is natural prose if running text is at least this share of its visible characters.
PROSE_SHARE = 0.5


def uncut(pages: DataFrame, size: int) -> DataFrame:
    """(index_id, chunk, n_chunks, fresh, glue, glue_letters, part): each text of at most `size` characters as its only chunk."""
    one, none = F.lit(1), F.lit(0)
    return pages.filter(F.length("text") <= size).select(
        "index_id", none.alias("chunk"), one.alias("n_chunks"), F.lit(None).cast("int").alias("fresh"), none.alias("glue"), none.alias("glue_letters"), plain_space("text").alias("part"))


def chunked(pages: DataFrame, size: int) -> DataFrame:
    """As uncut, for texts over `size`, in chunks that are spread over the cluster.

    A chunk ends after white space and swallows what white space follows, so that a
    sentence's end or a line's end at its border is seen whole; without white space it
    ends after a symbol. Only a longer run of letters and digits is parted inside: then
    glue is 1, and glue_letters is 1 if either part of the token has letters only. fresh
    is 1 if the chunk's first visible character starts a line and no line end is before
    it in the chunk (null: the chunk is the text's first).
    """
    rest = size - 1
    cut = rf"(?s)(?:.{{0,{rest}}}[ \n]|.{{0,{rest}}}[^\p{{L}}\p{{N}}]|.{{1,{size}}})[ \n]*+"
    huge = pages.filter(F.length("text") > size).withColumn("parts", F.regexp_extract_all(plain_space("text"), F.lit(cut), F.lit(0)))
    huge = huge.select("index_id", F.size("parts").alias("n_chunks"), F.posexplode_outer(F.transform("parts", lambda p, i: F.struct(
        p.alias("part"), F.when(i > 0, F.get("parts", i - 1)).alias("prev")))).alias("chunk", "p"))
    part, prev = F.col("p.part"), F.col("p.prev")
    glued = F.coalesce(F.regexp(F.right(prev, F.lit(1)), F.lit(TOKEN)) & F.regexp(F.left(part, F.lit(1)), F.lit(TOKEN)), F.lit(False))
    pure = ~F.regexp(prev, F.lit(r"\p{N}")) | F.regexp(part, F.lit(r"\A\p{L}+(?:\z|[^\p{L}\p{N}])"))
    return huge.select(
        "index_id", "chunk", "n_chunks",
        F.regexp(prev, F.lit(r"\n[ \n]*+\z")).cast("int").alias("fresh"),
        F.when(glued, 1).otherwise(0).alias("glue"),
        F.when(glued & pure, 1).otherwise(0).alias("glue_letters"), part.alias("part")).repartition("index_id", "chunk")


def segments(chunks: DataFrame, stop_words: list[str]) -> DataFrame:
    """One row of counts per segment, or per part of one that a chunk's border cuts."""
    first, zero = F.col("pos") == 0, F.lit(0)
    end = F.when(F.col("chunk") == F.col("n_chunks") - 1, F.regexp_count("part", F.lit(TEXT_PUNCT_LAST))).otherwise(F.regexp_count("part", F.lit(PUNCT_LAST)))
    parts = chunks.select(
        "index_id", "chunk", "n_chunks", "glue", "glue_letters", F.split("part", SEGMENT_END).alias("pieces"),
        (F.regexp_count("part", F.lit(LINE_START)) + F.coalesce("fresh", F.regexp("part", F.lit(FIRST_LINE)).cast("int"))).alias("lines"), end.alias("punct_lines"))
    spread = parts.withColumn("n_pieces", F.size("pieces")).select(
        "index_id", "chunk", "n_chunks", "glue", "glue_letters", "lines", "punct_lines", "n_pieces", F.posexplode_outer("pieces").alias("pos", "piece"))
    spread = spread.select(
        "index_id", "chunk", "n_chunks", "pos", "n_pieces",
        F.when(first, F.col("glue")).otherwise(zero).alias("glue"),
        F.when(first, F.col("glue_letters")).otherwise(zero).alias("glue_letters"),
        # The counts of lines belong to the chunk and ride on its first segment.
        F.when(first, F.col("lines")).otherwise(zero).alias("n_lines"),
        F.when(first, F.col("punct_lines")).otherwise(zero).alias("n_punct_lines"),
        F.length(F.replace("piece", F.lit(" "), F.lit(""))).alias("n_visible"),
        F.regexp_extract_all(F.lower("piece"), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    # The second part of a parted token is no word of its own.
    own = F.when(F.col("glue") == 1, F.slice("tokens", 2, F.size("tokens"))).otherwise(F.col("tokens"))
    return spread.withColumn("own", own).select(
        "index_id", "chunk", "n_chunks", "pos", "n_pieces", "n_lines", "n_punct_lines", "n_visible",
        F.get("own", zero).alias("first_token"), F.try_element_at("own", F.lit(-1)).alias("last_token"),
        (F.size("tokens") - F.col("glue")).alias("n_tokens"),
        F.length(F.array_join("tokens", "")).alias("n_token_chars"),
        (F.size(F.filter("tokens", lambda t: ~F.regexp(t, F.lit(r"\p{N}")))) - F.col("glue_letters")).alias("n_words"),
        F.size(F.filter("own", lambda t: t.isin(stop_words))).alias("n_common"),
        F.size(F.filter("own", lambda t, i: t == F.get("own", i + 1))).alias("n_repeats"))


COUNTS = ["n_lines", "n_punct_lines", "n_visible", "n_tokens", "n_token_chars", "n_words", "n_common", "n_repeats"]


def judged(segment: DataFrame) -> DataFrame:
    """Counts of whole segments with n_running: their visible characters if they are running text."""
    running = (
        (F.col("n_common") >= 1)
        & (F.col("n_common") >= COMMON_SHARE * F.col("n_words"))
        & (F.col("n_words") >= LETTER_SHARE * F.col("n_tokens"))
        & (F.col("n_repeats") <= REPEAT_SHARE * F.col("n_words"))
    )
    return segment.select("index_id", *COUNTS, F.when(running, F.col("n_visible")).otherwise(0).alias("n_running"))


def mended(edges: DataFrame) -> DataFrame:
    """Whole segments from the parts that chunk borders cut: parts up to the next segment's start belong together."""
    order = Window.partitionBy("index_id").orderBy("chunk", "pos")
    numbered = edges.withColumn("segment", F.sum(F.when(F.col("pos") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("index_id", "segment").orderBy("chunk", "pos").rowsBetween(Window.unboundedPreceding, -1)
    met = F.when(F.last("last_token", ignorenulls=True).over(within) == F.col("first_token"), 1).otherwise(0)
    return numbered.withColumn("n_repeats", F.col("n_repeats") + met).groupBy("index_id", "segment").agg(*(F.sum(c).alias(c) for c in COUNTS))


def stop_list(stop_words: DataFrame) -> list[str]:
    """The distinct words in lower case; a longer list than MAX_STOP_WORDS is refused."""
    rows = stop_words.select(F.lower("word").alias("word")).filter(F.col("word").isNotNull()).distinct().limit(MAX_STOP_WORDS + 1).collect()
    if len(rows) > MAX_STOP_WORDS:
        raise ValueError(f"more than {MAX_STOP_WORDS} stop words")
    return sorted(r.word for r in rows) or [""]


def statistics(pages: DataFrame, stop_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per row with a text: index_id, n_words, mean_word_len, symbol_share, punct_line_share, common_share, prose_share, is_prose.

    A word is a run of letters and digits; symbols are visible characters that are
    neither; lines are the non-blank ones, and common words those of the list, of any
    language, in any letter case. A text without words has a mean length of 0, one
    without visible characters has shares of 0 and counts as prose: nothing in it is a
    list, a table or junk. Null texts give no row. index_id is taken to be unique.
    """
    stops = stop_list(stop_words)
    # Counts of the huge texts' segments are written once, as inner and border segments are read apart.
    huge = materialize(segments(chunked(pages, chunk), stops))
    at_border = (F.col("pos") == 0) | (F.col("pos") == F.col("n_pieces") - 1)
    whole = judged(segments(uncut(pages, chunk), stops)).unionByName(judged(huge.filter(~at_border))).unionByName(judged(mended(huge.filter(at_border))))
    return finish(whole.groupBy("index_id").agg(*(F.sum(c).alias(c) for c in [*COUNTS, "n_running"])))


def found(pages: DataFrame, stop_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(index_id) of the rows whose text is not natural prose."""
    return statistics(pages, stop_words, chunk).filter(~F.col("is_prose")).select("index_id")


def finish(total: DataFrame) -> DataFrame:
    """Ratios and the rule's outcome from the counts of a whole text."""

    def share(a: F.Column, b: str) -> F.Column:
        return F.round(F.coalesce(F.try_divide(a.cast("double"), F.col(b)), F.lit(0.0)), 6)

    shares = total.select(
        "index_id", F.col("n_tokens").alias("n_words"),
        share(F.col("n_token_chars"), "n_tokens").alias("mean_word_len"),
        share(F.col("n_visible") - F.col("n_token_chars"), "n_visible").alias("symbol_share"),
        share(F.col("n_punct_lines"), "n_lines").alias("punct_line_share"),
        share(F.col("n_common"), "n_tokens").alias("common_share"),
        share(F.col("n_running"), "n_visible").alias("prose_share"),
        F.col("n_visible"))
    return shares.withColumn("is_prose", (F.col("n_visible") == 0) | (F.col("prose_share") >= PROSE_SHARE)).drop("n_visible")
