"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import contamination, dedup, mixing, quality, residue, splitting
from pagewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: dedup.copies(table(s, d, "concepts")),
        "p1_records": lambda s, d: dedup.collapsed(table(s, d, "concepts")).select("concept_id", "doc_id", "n_copies"),
        "p3_found": lambda s, d: splitting.found(table(s, d, "page_index")),
        "p3_pieces": lambda s, d: splitting.split_long(table(s, d, "page_index")),
        "p4_found": lambda s, d: quality.found(table(s, d, "page_index"), table(s, d, "stop_words")),
        "p4_statistics": lambda s, d: quality.statistics(table(s, d, "page_index"), table(s, d, "stop_words")),
        "p6_found": lambda s, d: contamination.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_items": lambda s, d: contamination.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_clean_documents": lambda s, d: contamination.clean_documents(
            table(s, d, "documents", "doc_id", "source", "text"), table(s, d, "eval_items")).select("doc_id", "source"),
        "p6_clean_spans": lambda s, d: contamination.clean_spans(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: residue.found(table(s, d, "documents")),
        "p8_messages": lambda s, d: residue.message_report(table(s, d, "documents")),
    }


# Letters and digits of a text, without letter case.
_CANON = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_RECORDS = rf"""
WITH r AS (
  SELECT concept_id, doc_id, {_CANON.format('name')} AS name,
    list_sort(list_filter(list_transform(coalesce(prerequisites, []), lambda x: {_CANON.format("coalesce(x, '')")}), lambda x: x <> '')) AS entries,
    CASE WHEN extra IS NOT NULL THEN list_sort(list_transform(json_keys(extra), lambda k:
      {_CANON.format('k')} || '=' || coalesce({_CANON.format("json_extract_string(extra, '$.\"' || k || '\"')")}, 'null'))) END AS extras
  FROM concepts
), g AS (
  SELECT *, min(concept_id) OVER (PARTITION BY doc_id, name, entries, extras) AS keep_id FROM r WHERE name <> ''
)"""

_STATS = r"""
WITH t AS (
  SELECT index_id, regexp_replace(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'),
    '[\t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g') AS x
  FROM page_index WHERE text IS NOT NULL
), l AS (
  SELECT *, list_filter(string_split(x, chr(10)), lambda s: trim(s) <> '') AS lines,
    length(regexp_replace(x, '[ \n]+', '', 'g')) AS visible,
    regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS words,
    list_filter(list_transform(regexp_extract_all(regexp_replace(x, '([.!?…]) [ \n]*', '\1' || chr(10), 'g'), '[^\n]+'), lambda s: struct_pack(
      v := length(replace(s, ' ', '')), w := regexp_extract_all(lower(s), '[\p{L}\p{N}]+'))), lambda s: s.v > 0) AS segs
  FROM t
), c AS (SELECT list(DISTINCT lower(word)) AS common FROM stop_words WHERE word IS NOT NULL
), f AS (
  SELECT *, len(words) AS n, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS chars,
    list_transform(segs, lambda s: struct_pack(v := s.v, k := len(s.w),
      c := len(list_filter(s.w, lambda w: list_contains(common, w))),
      l := len(list_filter(s.w, lambda w: NOT regexp_matches(w, '\p{N}'))),
      r := len(list_filter(range(1, len(s.w)), lambda i: s.w[i] = s.w[i + 1])))) AS marks
  FROM l, c
), e AS (
  SELECT index_id, CAST(n AS BIGINT) AS n_words,
    round(CASE WHEN n > 0 THEN chars::DOUBLE / n ELSE 0 END, 6) AS mean_word_len,
    round(CASE WHEN visible > 0 THEN (visible - chars)::DOUBLE / visible ELSE 0 END, 6) AS symbol_share,
    round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda s: regexp_matches(s, '\p{P} *$')))::DOUBLE / len(lines) ELSE 0 END, 6) AS punct_line_share,
    round(CASE WHEN n > 0 THEN len(list_filter(words, lambda w: list_contains(common, w)))::DOUBLE / n ELSE 0 END, 6) AS common_share,
    round(CASE WHEN visible > 0 THEN coalesce(list_sum(list_transform(list_filter(marks,
      lambda m: m.c >= 1 AND m.c >= 0.17::DOUBLE * m.l AND m.l >= 0.6::DOUBLE * m.k AND m.r <= 0.25::DOUBLE * m.l), lambda m: m.v)), 0)::DOUBLE / visible ELSE 0 END, 6) AS prose_share,
    visible
  FROM f
)"""

_LEAKS = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
x AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM x)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (gram))"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; splitting, cutting spans, tokenising and the residue rules are tested by brute force."""
    return {
        "p1_found": _RECORDS + " SELECT keep_id, concept_id AS copy_id FROM g WHERE concept_id <> keep_id",
        "p1_records": _RECORDS + " SELECT keep_id AS concept_id, doc_id, count(*) AS n_copies FROM g GROUP BY keep_id, doc_id",
        "p3_found": "SELECT index_id FROM page_index WHERE length(text) > 2000",
        "p4_found": _STATS + " SELECT index_id FROM e WHERE visible > 0 AND prose_share < 0.5",
        "p4_statistics": _STATS + """ SELECT index_id, n_words, mean_word_len, symbol_share, punct_line_share, common_share, prose_share,
            visible = 0 OR prose_share >= 0.5 AS is_prose FROM e""",
        "p6_found": _LEAKS + " SELECT doc_id, item_id FROM leaks",
        "p6_items": _LEAKS + " SELECT item_id, count(doc_id) AS n_docs FROM eval_items LEFT JOIN leaks USING (item_id) GROUP BY item_id",
        "p6_clean_documents": _LEAKS + " SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    }
