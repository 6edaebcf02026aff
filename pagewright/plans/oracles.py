"""SQL for the core queries, as DuckDB runs it."""

from __future__ import annotations

from pagewright.operators.cleaning import BAD_KEYWORDS, BAD_PHRASES, LEGAL_HEADS, TOC_HEADS
from pagewright.operators.concepts import PROMPT
from pagewright.operators.reports import RULE
from pagewright.plans.queries import IMAGES

SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CANON = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


LATEST = """
latest AS (
  SELECT doc_id, page_number, raw_text FROM (
    SELECT doc_id, page_number, coalesce(raw_text, '') AS raw_text,
      row_number() OVER (PARTITION BY doc_id, page_number ORDER BY loaded_at DESC, coalesce(raw_text, '') DESC) AS rn FROM pages) WHERE rn = 1
)"""

CLEAN = LATEST + rf""", c1 AS (
  SELECT doc_id, page_number, raw_text,
    regexp_replace(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), '[\x00-\x09\x0b-\x1f\x7f]', ' ', 'g') AS t FROM latest
), c2 AS (
  SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(t, '[\x{{fffd}}\x{{25a0}}\x{{25cf}}\x{{2022}}\x{{b7}}\x{{2013}}\x{{2014}}\x{{a0}}]', ' ', 'g'),
    '\.{{2,}}', ' ', 'g'), '(\. ){{2,}}', ' ', 'g') AS t) FROM c1
), c3 AS (
  SELECT * REPLACE (regexp_replace(t, '(?mi)^(?:{LEGAL_HEADS})[^\n]*\n(?:[^\n]+\n)*(\n|\z)', '\1', 'g') AS t) FROM c2
), c4 AS (
  SELECT doc_id, page_number, raw_text, list_transform(regexp_split_to_array(t, '[\n\x{{85}}\x{{2028}}\x{{2029}}]'),
    lambda x: {strip("regexp_replace(x, ' {2,}', ' ', 'g')")}) AS lines FROM c3
), clean AS (
  SELECT doc_id, page_number, raw_text, list_filter(lines, lambda x: NOT regexp_matches(lower(x), '^(?:grade|unit|lesson|page)[{SPACES}]*\p{{Nd}}+$')
    AND NOT regexp_matches(lower(x), '{'|'.join(BAD_PHRASES)}')
    AND length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) >= 5
    AND length(regexp_replace(x, '[^\p{{L}}]+', '', 'g'))::DOUBLE / greatest(length(x), 1) > 0.4::DOUBLE) AS kept FROM c4
), texts AS (SELECT doc_id, page_number, raw_text, array_to_string(kept, chr(10)) AS text FROM clean)"""

TOC = rf""", toc AS (
  SELECT doc_id, page_number, regexp_matches(raw_text, '(?i)\b(?:{'|'.join(TOC_HEADS)})\b')
    OR len(list_filter(regexp_split_to_array(raw_text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
      lambda x: regexp_matches(x, '^.{{5,}}[.{SPACES}]{{3}}\p{{Nd}}+[{SPACES}]*$'))) >= 3 AS is_toc FROM latest
), tocs AS (
  SELECT *, min(CASE WHEN is_toc THEN page_number END) OVER (PARTITION BY doc_id) AS first FROM toc
), block AS (
  SELECT doc_id, page_number, is_toc, coalesce(is_toc AND page_number < first + 3 AND NOT EXISTS (
    SELECT 1 FROM tocs u WHERE u.doc_id = t.doc_id AND NOT u.is_toc AND u.page_number > t.first AND u.page_number < t.page_number), false) AS in_toc_block FROM tocs t
)"""

SIMS = r""", emb AS (
  SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS o,
    CASE WHEN length(text) > 20 THEN text ELSE 'empty page' END AS x FROM texts
), w AS (
  SELECT doc_id, page_number, o, word, count(*) AS tf FROM (SELECT doc_id, page_number, o, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS word FROM emb) GROUP BY ALL
), norm AS (SELECT doc_id, o, sum(tf * tf) AS n FROM w GROUP BY ALL
), dots AS (SELECT a.doc_id, a.o, sum(a.tf * b.tf) AS dot FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND b.o = a.o - 1 GROUP BY ALL
), sims AS (
  SELECT e.doc_id, e.page_number, p.page_number AS prev_page, e.o,
    CASE WHEN coalesce(n.n, 0) * coalesce(m.n, 0) > 0 THEN coalesce(d.dot, 0)::DOUBLE / sqrt(n.n::DOUBLE * m.n) ELSE 0 END AS sim
  FROM emb e JOIN emb p ON p.doc_id = e.doc_id AND p.o = e.o - 1
  LEFT JOIN norm n ON n.doc_id = e.doc_id AND n.o = e.o LEFT JOIN norm m ON m.doc_id = e.doc_id AND m.o = e.o - 1
  LEFT JOIN dots d ON d.doc_id = e.doc_id AND d.o = e.o
)"""

CHUNKED = """, walk AS (
  SELECT doc_id, page_number, 1::BIGINT AS o, 1 AS size, 0 AS idx FROM emb WHERE o = 1
  UNION ALL
  SELECT s.doc_id, s.page_number, s.o,
    CASE WHEN w.size >= 20 OR (s.sim < 1 - 0.45::DOUBLE AND w.size >= 3) THEN 1 ELSE w.size + 1 END,
    CASE WHEN w.size >= 20 OR (s.sim < 1 - 0.45::DOUBLE AND w.size >= 3) THEN w.idx + 1 ELSE w.idx END
  FROM walk w JOIN sims s ON s.doc_id = w.doc_id AND s.o = w.o + 1
)"""

LISTED = "SELECT DISTINCT doc_id, chunk_index, unnest(pages) AS page_number FROM chunks"
SEGMENTED = "SELECT doc_id, idx::BIGINT AS chunk_index, page_number FROM walk"
CHUNK_TEXT = TOC + f""", listed AS ({LISTED}
), chunk_texts AS (
  SELECT l.doc_id, l.chunk_index, string_agg(chr(10) || chr(10) || '===== PAGE ' || (l.page_number + 1) || CASE WHEN b.in_toc_block THEN ' (TOC)' ELSE '' END || ' =====' || chr(10)
    || CASE WHEN b.in_toc_block OR length(t.text) >= 20 THEN t.text ELSE '' END, '' ORDER BY l.page_number) AS chunk_text
  FROM listed l JOIN texts t USING (doc_id, page_number) JOIN block b USING (doc_id, page_number) GROUP BY ALL
)"""


def keyword_input(x: str) -> str:
    for pattern, by in ((r"\[IMAGE \d+:\s*", ""), (r"\]", ""), (r"Text in image:\s*", ""), (r"Visual:\s*", ""), (r"\|", " "), (" {2,}", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


TOKENS = CHUNK_TEXT + rf""", tokens AS (
  SELECT doc_id, chunk_index, list_filter(regexp_extract_all(lower({keyword_input('chunk_text')}), '[\p{{L}}\p{{N}}_]{{2,}}'),
    lambda t: NOT list_contains(stops, t)) AS ts FROM chunk_texts, (SELECT list(lower(word)) AS stops FROM stop_words)
), candidates AS (
  SELECT DISTINCT doc_id, chunk_index, array_to_string(ts[i:i + k - 1], ' ') AS term
  FROM (SELECT doc_id, chunk_index, ts, k, unnest(range(1, len(ts) - k + 2)) AS i FROM tokens, (VALUES (1), (2), (3)) AS v(k))
)"""

TERMS = rf"""
terms AS (
  SELECT doc_id, chunk_index, min(ord) AS ord, term, arg_max(score, ord * 1000.0 + score) AS score FROM (
    SELECT doc_id, chunk_index, ord, lower({strip(f"regexp_replace(term, '[{SPACES}]+', ' ', 'g')")}) AS term, coalesce(score, 0) AS score FROM keywords WHERE term IS NOT NULL)
  GROUP BY doc_id, chunk_index, term
), labels AS (SELECT doc_id, chunk_index, coalesce(max(label), '') AS label FROM chunks GROUP BY ALL)"""

FOUND = """
found AS (
  SELECT doc_id, concept AS name FROM (
    SELECT doc_id, concept, found, row_number() OVER (PARTITION BY doc_id, concept ORDER BY checked_at DESC NULLS LAST, found DESC) AS rn
    FROM verification WHERE concept IS NOT NULL AND doc_id IS NOT NULL AND found IS NOT NULL) WHERE rn = 1 AND found
), cur AS (SELECT concept_id, doc_id, name, prerequisites FROM concepts WHERE deleted_at IS NULL AND doc_id IS NOT NULL AND name IS NOT NULL
), good AS (SELECT * FROM cur SEMI JOIN found USING (doc_id, name)
), entries AS (SELECT concept_id, doc_id, unnest(prerequisites) AS name, unnest(range(len(prerequisites))) AS pos FROM good
), kept AS (
  SELECT g.concept_id, g.doc_id, g.name, coalesce(e.ps, []) AS prerequisites FROM good g LEFT JOIN (
    SELECT concept_id, list(name ORDER BY pos) AS ps FROM entries SEMI JOIN found USING (doc_id, name) GROUP BY ALL) e USING (concept_id)
), flagged AS (
  SELECT concept_id, doc_id, 'concept' AS kind, -1 AS ord, name AS item FROM cur ANTI JOIN found USING (doc_id, name)
  UNION ALL
  SELECT concept_id, doc_id, 'prerequisite', pos::INTEGER, name FROM entries ANTI JOIN found USING (doc_id, name) WHERE name IS NOT NULL
)"""

ORPHANS = rf"""
WITH refs AS (
  SELECT 'concepts' AS src_table, concept_id AS src_id, unnest(range(len(prerequisites))) AS ref_pos, doc_id, unnest(prerequisites) AS name, loaded_at AS tm FROM concepts
  UNION ALL SELECT 'verification', verification_id, 0, doc_id, concept, checked_at FROM verification
), r AS (SELECT src_table, src_id, ref_pos, doc_id, tm, {CANON.format('name')} AS k FROM refs),
t AS (SELECT doc_id, {CANON.format('name')} AS k, loaded_at, deleted_at FROM concepts),
o AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id AND t.k = r.k AND t.loaded_at <= r.tm AND (t.deleted_at IS NULL OR t.deleted_at > r.tm)) AS answered
  FROM r WHERE k <> '')"""

GRAPH = rf"""
WITH RECURSIVE alive AS (SELECT concept_id, doc_id, {CANON.format('name')} AS k, prerequisites FROM concepts WHERE deleted_at IS NULL AND doc_id IS NOT NULL AND name IS NOT NULL),
nodes AS (SELECT doc_id, k, min(concept_id) AS id FROM alive WHERE k <> '' GROUP BY ALL),
named AS (SELECT DISTINCT doc_id, k, {CANON.format('p')} AS pk FROM (SELECT doc_id, k, unnest(prerequisites) AS p FROM alive WHERE k <> '')),
links AS (SELECT DISTINCT a.id, b.id AS parent FROM named n JOIN nodes a ON a.doc_id = n.doc_id AND a.k = n.k JOIN nodes b ON b.doc_id = n.doc_id AND b.k = n.pk),
reach AS (SELECT id, parent AS up FROM links UNION SELECT r.id, l.parent FROM reach r JOIN links l ON l.id = r.up),
loops AS (SELECT a.id, least(a.id, min(a.up)) AS loop_id FROM reach a JOIN reach b ON b.id = a.up AND b.up = a.id GROUP BY a.id),
tops AS (SELECT id, id AS root FROM nodes WHERE id NOT IN (SELECT id FROM links) UNION SELECT id, loop_id FROM loops)"""

# Loops as one vertex, the deepest parent of each, and the chains of heaviest children.
CHAINS = GRAPH + """,
vx AS (SELECT n.id, coalesce(l.loop_id, n.id) AS v, l.id IS NOT NULL AS in_loop FROM nodes n LEFT JOIN loops l ON l.id = n.id),
ups AS (SELECT DISTINCT a.v AS low, b.v AS high FROM links JOIN vx a ON a.id = links.id JOIN vx b ON b.id = links.parent WHERE a.v <> b.v),
deep AS (SELECT DISTINCT v, 0 AS k FROM vx WHERE v NOT IN (SELECT low FROM ups) UNION SELECT low, k + 1 FROM deep JOIN ups ON high = v),
dep AS (SELECT v, max(k) AS depth FROM deep GROUP BY v),
prim AS (SELECT low AS v, high AS p FROM (SELECT low, high, row_number() OVER (PARTITION BY low ORDER BY depth DESC, high) AS rn FROM ups JOIN dep ON v = high) WHERE rn = 1),
ways AS (SELECT v, [v] AS path FROM dep WHERE v NOT IN (SELECT v FROM prim) UNION ALL SELECT prim.v, list_append(path, prim.v) FROM ways JOIN prim ON prim.p = ways.v),
sz AS (SELECT v, count(*) AS n FROM (SELECT unnest(path) AS v FROM ways) GROUP BY v),
hv AS (SELECT v, p FROM (SELECT v, p, row_number() OVER (PARTITION BY p ORDER BY n DESC, v) AS rn FROM prim JOIN sz USING (v)) WHERE rn = 1),
ch AS (SELECT v, v AS chain, 0 AS place FROM dep WHERE v NOT IN (SELECT v FROM hv) UNION ALL SELECT hv.v, chain, place + 1 FROM ch JOIN hv ON hv.p = ch.v),
rt AS (SELECT id, root FROM tops UNION SELECT r.id, t.root FROM reach r JOIN tops t ON t.id = r.up)"""

WORDS = r"""
stops AS (SELECT DISTINCT lower(word) AS word FROM stop_words),
asked AS (SELECT DISTINCT doc_id, regexp_replace(name, '[""" + SPACES + r"""]+', ' ', 'g') AS name FROM concepts WHERE deleted_at IS NULL AND doc_id IS NOT NULL AND name IS NOT NULL),
own AS (SELECT doc_id, name, word, count(*) AS tf FROM (SELECT doc_id, name, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) AS word FROM asked) ANTI JOIN stops USING (word) GROUP BY ALL),
pg AS (SELECT doc_id, page, text FROM (SELECT doc_id, page, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY indexed_at DESC, index_id DESC) AS rn FROM page_index WHERE length(text) > 20) WHERE rn = 1),
theirs AS (SELECT doc_id, page, word, count(*) AS tf FROM (SELECT doc_id, page, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM pg) ANTI JOIN stops USING (word) GROUP BY ALL),
n1 AS (SELECT doc_id, name, sum(tf * tf) AS n FROM own GROUP BY ALL), n2 AS (SELECT doc_id, page, sum(tf * tf) AS n FROM theirs GROUP BY ALL),
dots AS (SELECT o.doc_id, o.name, t.page, sum(o.tf * t.tf) AS dot FROM own o JOIN theirs t USING (doc_id, word) GROUP BY ALL),
sims AS (SELECT d.doc_id, d.name, d.page, d.dot::DOUBLE / sqrt(n1.n::DOUBLE * n2.n) AS sim FROM dots d JOIN n1 USING (doc_id, name) JOIN n2 ON n2.doc_id = d.doc_id AND n2.page = d.page),
best AS (SELECT doc_id, name, page, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY sim DESC, page) AS rn FROM sims) WHERE rn = 1)"""


def literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


IMAGE_ROWS = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in IMAGES)
DESCRIBED = rf"""
WITH i(doc_id, page_number, img_index, width, height, ocr_text, caption, error, extract_error) AS (VALUES {IMAGE_ROWS}),
p AS (SELECT *, trim(regexp_replace(ocr_text, '\s+', ' ', 'g')) AS ocr, trim(caption) AS cap FROM i WHERE width >= 100 AND height >= 100),
q AS (SELECT *, concat_ws(' | ', CASE WHEN length(ocr) > 5 THEN 'Text in image: ' || ocr END, CASE WHEN length(cap) > 0 THEN 'Visual: ' || cap END) AS parts FROM p),
d AS (SELECT doc_id, page_number, img_index, '[IMAGE ' || (img_index + 1) || ': ' || CASE WHEN extract_error IS NOT NULL THEN 'Could not extract — ' || extract_error
  WHEN error IS NOT NULL THEN '[Image analysis failed: ' || error || ']' WHEN parts = '' THEN '[Image: no content detected]' ELSE parts END || ']' AS description FROM q)"""


def oracle_sql() -> dict[str, str]:
    """Clusters by linkage have no SQL; they are tested by brute force."""
    head, rest = PROMPT.split("{toc}")
    middle, tail = rest.split("{clusters}")
    cosine = "list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i]::DOUBLE * f[i])) / sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x)) * list_sum(list_transform(f, lambda x: x::DOUBLE * x)))"
    coherence = """
WITH m AS (SELECT a.label, count(*) AS n2, avg(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)))) AS c
  FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.label),
k AS (SELECT label, sqrt(n2)::BIGINT AS n_members, round(CASE WHEN n2 > 1 THEN c ELSE 0 END, 6) AS coherence FROM m)"""
    top = rf""", tf AS (SELECT doc_id, chunk_index, word, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest(ts) AS word FROM tokens) GROUP BY ALL),
            nn AS (SELECT doc_id, chunk_index, sum(tf * tf) AS n FROM tf GROUP BY ALL),
            ow AS (SELECT doc_id, chunk_index, term, word, count(*) AS own FROM (SELECT doc_id, chunk_index, term, unnest(string_split(term, ' ')) AS word FROM candidates) GROUP BY ALL),
            dd AS (SELECT doc_id, chunk_index, term, sum(own * tf) AS dot, sum(own * own) AS n1 FROM ow JOIN tf USING (doc_id, chunk_index, word) GROUP BY ALL),
            sc AS (SELECT doc_id, chunk_index, term, round(dot::DOUBLE / sqrt(n1::DOUBLE * n), 4) AS score FROM dd JOIN nn USING (doc_id, chunk_index)),
            rk AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY score DESC, term) - 1)::INTEGER AS ord FROM sc)
            SELECT doc_id, chunk_index, ord, term, score FROM rk WHERE ord < 15 AND NOT regexp_matches(term, '(?:^|[^\p{{L}}\p{{N}}_])(?:{BAD_KEYWORDS})(?:[^\p{{L}}\p{{N}}_]|$)')"""
    report = f"""
WITH {TERMS}, g AS (
  SELECT doc_id, chunk_index, left(term, 1) AS letter, min(ord) AS cluster_ord, first(term ORDER BY score DESC, ord, term) AS name,
    string_agg('      ' || term || ': ' || printf('%.3f', round(score::DECIMAL(18, 9), 3)::DOUBLE) || chr(10), '' ORDER BY score DESC, ord, term) AS body FROM terms WHERE term <> '' GROUP BY ALL)
SELECT g.doc_id, g.chunk_index, chr(10) || '===== KEYWORD CLUSTERS FOR ' || label || ' =====' || chr(10)
  || string_agg(chr(10) || '  [' || upper(name) || ']' || chr(10) || body, '' ORDER BY cluster_ord, '[' || upper(name) || ']' || body) AS report FROM g JOIN labels USING (doc_id, chunk_index) GROUP BY g.doc_id, g.chunk_index, label"""
    return {
        "p2_found": ORPHANS + " SELECT src_table, src_id, ref_pos FROM o WHERE NOT answered",
        "p2_months": ORPHANS + " SELECT src_table, strftime(tm AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_refs, count(*) FILTER (NOT answered) AS n_orphans FROM o GROUP BY ALL",
        "p5_found": GRAPH + " SELECT id AS concept_id, root AS root_id FROM tops UNION SELECT r.id, t.root FROM reach r JOIN tops t ON t.id = r.up",
        "p5_nodes": CHAINS + """ SELECT vx.id AS concept_id, depth::INTEGER AS depth, array_to_string(path, '/') AS path,
            (SELECT count(*) FROM rt WHERE rt.id = vx.id)::INTEGER AS n_roots, (SELECT count(*) FROM reach r WHERE r.up = vx.id) AS n_below,
            in_loop, chain, place::INTEGER AS place FROM vx JOIN dep USING (v) JOIN ways USING (v) JOIN ch USING (v)""",
        "p5_descendants": GRAPH + " SELECT up AS concept_id, id AS below_id FROM reach",
        "p5_loops": GRAPH + " SELECT loop_id, id AS concept_id FROM loops",
        "page_count": "SELECT doc_id, count(DISTINCT page_number) AS n_pages FROM pages GROUP BY doc_id",
        "clean_lines": f"WITH {CLEAN} SELECT doc_id, page_number, unnest(range(len(kept))) AS line_no, unnest(kept) AS line FROM clean",
        "clean_text": f"WITH {CLEAN} SELECT doc_id, page_number, text FROM texts",
        "page_text_class": f"""WITH {CLEAN} SELECT doc_id, page_number, CASE WHEN length(text) > 20 THEN text ELSE 'empty page' END AS embed_text,
            length(text) >= 20 AS has_content, length(text) > 20 AS in_index FROM texts""",
        "keyword_input": f"WITH {CLEAN}{CHUNK_TEXT} SELECT doc_id, chunk_index, {keyword_input("'[IMAGE 2: Text in image: abc | Visual: a cat]' || chunk_text")} AS text FROM chunk_texts",
        "keyword_filter": rf"""WITH n AS (SELECT doc_id, chunk_index, ord, term AS raw, lower({strip(f"regexp_replace(term, '[{SPACES}]+', ' ', 'g')")}) AS term FROM keywords WHERE term IS NOT NULL)
            SELECT doc_id, chunk_index, ord, term, len(string_split(term, ' ')) <= 4 AND NOT regexp_matches(lower(raw), '(?:^|[^\p{{L}}\p{{N}}_])(?:{BAD_KEYWORDS})(?:[^\p{{L}}\p{{N}}_]|$)') AS good FROM n""",
        "strip_fences": rf"""SELECT reply_id, doc_id, regexp_replace(regexp_replace(regexp_replace({strip('raw')}, '\A```json\s*', ''), '\A```\s*', ''), '\s*```\z', '') AS body
            FROM (SELECT DISTINCT reply_id, doc_id, raw FROM llm_raw)""",
        "parse_replies": rf"""WITH b AS (SELECT reply_id, doc_id, raw, regexp_replace(regexp_replace(regexp_replace({strip('raw')}, '\A```json\s*', ''), '\A```\s*', ''), '\s*```\z', '') AS body FROM (SELECT DISTINCT reply_id, doc_id, raw FROM llm_raw)),
            v AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM b),
            k AS (SELECT *, CASE WHEN json_type(j, '$.concepts') = 'ARRAY' THEN j::JSON->'$.concepts[*]' END AS es FROM v),
            g AS (SELECT *, es IS NOT NULL AND len(list_filter(es, lambda e: NOT coalesce(json_exists(e, '$.name') AND json_exists(e, '$.prerequisites'), false))) = 0 AS good FROM k)
            SELECT reply_id, doc_id, CASE WHEN raw IS NULL THEN 'llm_error' WHEN good THEN 'ok' WHEN j IS NOT NULL THEN 'llm_error' ELSE 'json_error' END AS status,
              CASE WHEN good THEN len(es) ELSE 0 END AS n_concepts FROM g""",
        "toc_detect": f"WITH {LATEST}{TOC} SELECT doc_id, page_number, is_toc FROM toc",
        "toc_block": f"WITH {LATEST}{TOC} SELECT doc_id, page_number, is_toc, in_toc_block FROM block",
        "page_similarity": f"WITH {CLEAN}{SIMS} SELECT doc_id, page_number, prev_page, sim FROM sims",
        "similarity_report": f"""WITH RECURSIVE {CLEAN}{SIMS}{CHUNKED} SELECT s.doc_id, s.page_number, '  Page ' || lpad((s.prev_page + 1)::VARCHAR, 4, ' ') || ' → ' || rpad((s.page_number + 1)::VARCHAR, 4, ' ')
            || ' | ' || rpad(repeat('█', trunc(s.sim * 20)::INTEGER), 20, ' ') || ' | ' || printf('%.3f', round(s.sim, 3)) || CASE WHEN w.size = 1 THEN ' ← BOUNDARY' ELSE '' END AS line
            FROM sims s JOIN walk w ON w.doc_id = s.doc_id AND w.o = s.o""",
        "semantic_chunks": f"""WITH RECURSIVE {CLEAN}{SIMS}{CHUNKED} SELECT doc_id, idx::BIGINT AS chunk_index, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages,
            'CHUNK ' || (idx + 1) || ' (Pages ' || (min(page_number) + 1) || '–' || (max(page_number) + 1) || ')' AS label FROM walk GROUP BY doc_id, idx""",
        "chunk_text": f"WITH {CLEAN}{CHUNK_TEXT} SELECT doc_id, chunk_index, chunk_text FROM chunk_texts",
        "toc_context": f"WITH {CLEAN}{TOC} SELECT doc_id, string_agg(text || chr(10), '' ORDER BY page_number) AS toc_context FROM block JOIN texts USING (doc_id, page_number) WHERE in_toc_block GROUP BY doc_id",
        "image_descriptions": DESCRIBED + " SELECT doc_id, page_number, img_index, description FROM d",
        "page_image_context": DESCRIBED + " SELECT doc_id, page_number, chr(10) || string_agg(description, chr(10) ORDER BY img_index) || chr(10) AS context FROM d GROUP BY ALL",
        "ngram_candidates": f"WITH {CLEAN}{TOKENS} SELECT doc_id, chunk_index, term FROM candidates",
        "topk_keywords": f"WITH {CLEAN}{TOKENS}{top}",
        "pipeline_keywords": f"WITH RECURSIVE {CLEAN}{SIMS}{CHUNKED}{TOKENS.replace(LISTED, SEGMENTED)}{top}",
        "cosine_pairs": f"""WITH r AS (SELECT doc_id, page, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY indexed_at DESC, index_id DESC) AS rn FROM page_index WHERE embedding IS NOT NULL) WHERE rn = 1),
            p AS (SELECT doc_id, page, e, lag(e) OVER (PARTITION BY doc_id ORDER BY page) AS f FROM r), c AS (SELECT doc_id, page, {cosine} AS sim FROM p WHERE f IS NOT NULL)
            SELECT doc_id, page, round(sim, 6) AS cosine, round(greatest(1 - sim, 0), 6) AS distance FROM c""",
        "cluster_count": f"WITH {TERMS} SELECT doc_id, chunk_index, count(*) AS n_terms, greatest(2, least(count(*) // 3, count(*) - 1)) AS n_clusters FROM terms GROUP BY doc_id, chunk_index",
        "cluster_coherence": coherence + " SELECT label, n_members, coherence FROM k",
        "coherent_documents": coherence.replace("embeddings", "(SELECT doc_id AS label, embedding FROM page_index WHERE embedding IS NOT NULL)") + " SELECT label AS doc_id, n_members, coherence FROM k WHERE coherence >= 0.05",
        "cluster_report": report,
        "prompt": f"""WITH {CLEAN}{TOC}, {TERMS.strip()}, toc_text AS (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY page_number) AS t FROM block JOIN texts USING (doc_id, page_number) WHERE in_toc_block GROUP BY doc_id),
            sec AS (SELECT l.doc_id, l.chunk_index, chr(10) || '  ' || label || chr(10) || string_agg('    - ' || term || chr(10), '' ORDER BY ord, term) AS s FROM labels l JOIN terms USING (doc_id, chunk_index) GROUP BY l.doc_id, l.chunk_index, label),
            pr AS (SELECT d.doc_id, {quoted(head)} || coalesce(max(t), '') || {quoted(middle)} || coalesce(string_agg(s, '' ORDER BY chunk_index), '') || {quoted(tail)} AS p
              FROM (SELECT DISTINCT doc_id FROM labels) d LEFT JOIN sec USING (doc_id) LEFT JOIN toc_text USING (doc_id) GROUP BY d.doc_id)
            SELECT doc_id, length(p) AS n_chars, CASE WHEN length(p) <= 20000 THEN p END AS prompt, CASE WHEN length(p) > 20000 THEN 'prompt_too_large' ELSE 'ok' END AS status FROM pr""",
        "verify_concepts": f"WITH {WORDS} SELECT a.doc_id, a.name AS concept, coalesce(sim, 0) >= 0.5 AS found, round(coalesce(sim, 0), 3) AS score, page AS best_page FROM asked a LEFT JOIN best USING (doc_id, name)",
        "canary_check": f"WITH {WORDS} SELECT a.doc_id, a.name AS concept, coalesce(sim, 0) >= 0.5 AS found, round(coalesce(sim, 0), 3) AS score, page AS best_page FROM asked a LEFT JOIN best USING (doc_id, name)".replace(
            WORDS[WORDS.index("asked AS"):WORDS.index("own AS")], "asked AS (SELECT DISTINCT doc_id, 'quantum entanglement theory' AS name FROM page_index),\n"),
        "clean_concepts": f"WITH {FOUND} SELECT concept_id, doc_id, name, array_to_string(prerequisites, '|') AS prerequisites FROM kept",
        "flagged_concepts": f"WITH {FOUND} SELECT concept_id, doc_id, item FROM flagged WHERE kind = 'concept'",
        "flagged_all": f"WITH {FOUND} SELECT concept_id, doc_id, kind, ord, item FROM flagged",
        "concept_report": f"""WITH {FOUND}, docs AS (SELECT doc_id, max(c) AS c, max(f) AS f FROM (SELECT doc_id, 1 AS c, 0 AS f FROM kept UNION ALL SELECT doc_id, 0, 1 FROM flagged) GROUP BY doc_id)
            SELECT doc_id, 0 AS part, NULL::BIGINT AS concept_id, -1 AS ord, {quoted(chr(10) * 2 + RULE + chr(10) + '  FINAL CONCEPTS AND PREREQUISITES' + chr(10) + RULE + chr(10))} AS line FROM docs
            UNION ALL SELECT doc_id, 1, NULL, -1, '  No concepts extracted.' || chr(10) FROM docs WHERE c = 0
            UNION ALL SELECT doc_id, 2, NULL, -1, {quoted(chr(10) + RULE + chr(10) + '  FLAGGED HALLUCINATIONS' + chr(10) + RULE + chr(10))} FROM docs WHERE f = 1
            UNION ALL SELECT doc_id, 1, concept_id, -1, '  Concept: ' || name || chr(10) || '  Prerequisites: ' || CASE WHEN len(prerequisites) > 0 THEN array_to_string(prerequisites, ', ') ELSE 'None' END || chr(10) || chr(10) FROM kept
            UNION ALL SELECT doc_id, 3, concept_id, ord, '  ⚠ ' || item || chr(10) FROM flagged""",
    }
