"""The training-data operators against brute force on small tables with every kind of dirt."""

import json
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pagewright.llm import contamination, dedup, mixing, quality, residue, splitting

C = "concept_id bigint, doc_id string, name string, prerequisites array<string>, extra string, key string, code int"
D = "doc_id bigint, text string, source string, h1 int"


def canon(x):
    return "".join(ch for ch in x.lower() if ch.isalnum())


# --- 1 ---------------------------------------------------------------------------------


def dedup_rows(seed, n=250):
    rng = random.Random(seed)
    written = lambda x: rng.choice([x, x.upper(), x.replace(" ", " "), f"* {x}!", x.replace(" ", "")])
    out = []
    for i in range(n):
        name = rng.choice([None, "", "--", *map(written, ["Net sums", "Cube sums", "Net sums", "Net sums"])])
        ps = rng.choice([None, [], [None], ["?"], [written("a b"), written("c")], [written("c"), None, written("a b")], [written("c"), written("c")]])
        extra = rng.choice([None, "{}", '{"Grade": "1", "unit": "U 2"}', '{"UNIT":"u2","grade":"1"}', '{"grade":null,"unit":"u2"}', "not json", "NOT-JSON", ""])
        out.append((i, rng.choice(["A", "B", None]), name, ps, extra, "k", 1))
    return out


def dedup_brute(cs):
    groups = defaultdict(list)
    for i, d, n, ps, x, *_ in cs:
        if not n or not canon(n):
            continue
        entries = tuple(sorted(canon(p) for p in ps or [] if p and canon(p)))
        try:
            more = None if x is None else tuple(sorted((canon(k), None if v is None else canon(v)) for k, v in json.loads(x).items()))
        except ValueError:
            more = canon(x)
        groups[d, canon(n), entries, more].append(i)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_copies(spark, seed):
    cs = dedup_rows(seed)
    df = spark.createDataFrame(cs, C)
    want = dedup_brute(cs)
    assert rows(dedup.copies(df)) == sorted(((g[0], i) for g in want.values() for i in g[1:]), key=repr)
    assert rows(dedup.collapsed(df).select("concept_id", "n_copies")) == sorted(((g[0], len(g)) for g in want.values()), key=repr)


def test_identifiers_are_tried_until_none_is_shared(spark, monkeypatch):
    tried = []
    real = dedup.coded

    def first_clashes(values, seed):
        tried.append(seed)
        book = real(values, seed)
        return book.withColumn("codes", F.transform("codes", lambda _: F.lit(7).cast("bigint"))) if seed == 1 else book

    monkeypatch.setattr(dedup, "coded", first_clashes)
    df = spark.createDataFrame(dedup_rows(3, 40), C)
    assert rows(dedup.copies(df)) == sorted(((g[0], i) for g in dedup_brute(dedup_rows(3, 40)).values() for i in g[1:]), key=repr) and tried == [1, 2]


def test_copies_empty(spark):
    assert dedup.copies(spark.createDataFrame([], C)).count() == 0


# --- 3 ---------------------------------------------------------------------------------


def long_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", ".", "?"]) + rng.choice(["", "", "", "\n", "\n\n"]) for _ in range(n))
    return ["", "x" * 2000, "x" * 2001, "é" * 9000, prose(700), prose(3000), "word " * 5000, "é" * 3000, "\n" * 4321, " " * 2500, prose(100) + "z" * 5000 + prose(200), "a. " * 700 + "b" * 1999]


@pytest.mark.parametrize("limit,overlap", [(2000, 200), (100, 0), (50, 20)])
def test_round_trip(limit, overlap):
    for text in long_texts():
        pieces = splitting.cut_text(text, limit, overlap)
        assert "".join(text[fresh:end] for _, fresh, end in pieces) == text
        for (start, fresh, end), before in zip(pieces, [(0, 0, 0), *pieces]):
            assert end - start <= limit and 0 <= fresh - start <= overlap and fresh == before[2]
            assert len(text) <= limit or end > fresh
        if overlap and len(text) > 2 * limit:
            assert all(s < f for s, f, _ in pieces[1:])


def test_natural_boundaries():
    text = "\n\n".join(" ".join(f"This is sentence {i} of paragraph {p}." for i in range(12)) for p in range(12))
    cuts = [text[:e] for _, _, e in splitting.cut_text(text)[:-1]]
    assert cuts and all(c.endswith("\n\n") for c in cuts)


def test_few_pieces_in_linear_time():
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(rng.randint(4, 20))).capitalize() + ". "
    for text in ("".join(sentence() + "\n\n" * (rng.random() < .2) for _ in range(20_000)), "x" * 200_000 + "".join(sentence() for _ in range(3000)), "word " * 60_000):
        began = time.process_time()
        pieces = splitting.cut_text(text)
        assert len(pieces) <= 1.1 * (1 + (len(text) - 2000) / 1800) + 1
        assert time.process_time() - began < 3e-6 * len(text)


def test_split_frame(spark):
    schema = "index_id bigint, doc_id string, page int, text string, piece string, start int"
    df = spark.createDataFrame([(i, "D", i, t, "clash", 0) for i, t in enumerate([*long_texts(), None])], schema)
    assert rows(splitting.found(df)) == [(i,) for i in sorted((i for i, t in enumerate(long_texts()) if len(t) > 2000), key=lambda i: repr((i,)))]
    assert splitting.split_long(df.filter("false")).count() == 0


# --- 4 ---------------------------------------------------------------------------------

STOPS = {"the", "of", "and", "to", "is", "les", "de", "a", "in"}
PROSE = "The size of the net is given to the class, and the rest of it is left to them. "
LIST = "- mean values\n- unit cubes\n- 31 paper squares\n"
PAGES = [
    None, "", "   \n ", PROSE * 3, LIST * 9, PROSE + LIST * 9, PROSE * 9 + LIST, PROSE.upper() * 2, "les pages de maths sont de retour " * 4,
    "the the the the page page page scan scan " * 9, "a1 b2 c3 4f 99 " * 30, "x" * 300, "Unit: 3\nGrade: 4\n" * 9, "the\r\nsize of the net\n\n. \n", "—" * 90,
    PROSE.replace(" ", "\n") * 3, "the size of" + "z" * 120 + " the net is in", "“" + PROSE * 2 + "”", "area models sort fact families quotients quiet record " * 5,
]


def stats_brute(text):
    plain = re.sub("\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n", text).replace(" ", " ").replace("\t", " ")
    tokens = re.findall(r"[^\W_]+", plain.lower())
    visible = len(re.sub(r"\s", "", plain))
    chars = sum(map(len, tokens))
    lines = [x.strip() for x in plain.split("\n") if x.strip()]
    running = 0
    for seg in re.split(r"\n+|(?<=[.!?…])\s+", plain):
        w = re.findall(r"[^\W_]+", seg.lower())
        common, letters, again = sum(x in STOPS for x in w), sum(x.isalpha() for x in w), sum(a == b for a, b in zip(w, w[1:]))
        if common >= 1 and common >= .17 * letters and letters >= .6 * len(w) and again <= .25 * letters:
            running += len(re.sub(r"\s", "", seg))
    over = lambda a, b: round(a / b, 6) if b else 0.0
    return (len(tokens), over(chars, len(tokens)), over(visible - chars, visible), over(sum(x[-1] in ".,!?:;-—”“" for x in lines), len(lines)),
            over(sum(x in STOPS for x in tokens), len(tokens)), over(running, visible), not visible or running / visible >= .5)


@pytest.mark.parametrize("chunk", [50_000, 64, 7])
def test_quality(spark, chunk):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(PAGES)], "index_id bigint, text string, pos int")
    stops = spark.createDataFrame([("en", w) for w in STOPS] + [(None, None), ("fr", "LES")], "lang string, word string")
    got = {r.index_id: tuple(r)[1:] for r in quality.statistics(df, stops, chunk).collect()}
    assert got == {i: stats_brute(t) for i, t in enumerate(PAGES) if t is not None}
    assert quality.statistics(df.filter("false"), stops, chunk).count() == 0


# --- 6 ---------------------------------------------------------------------------------


def test_leaks(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, item), (2, "short item"), (3, None), (4, item.upper() + " and more"), (5, "ten " * 20)]
    docs = [(1, item.replace(" ", "—"), "a", 0), (2, "Two" + item[7:], "a", 0), (3, item.replace("seven", "7"), "a", 0), (4, None, "a", 0), (5, "", None, 0),
            (6, "before " + " ".join(item.split()[:12]) + ". after! " + "ten " * 12, "b", 0), (7, "eleven words " * 5000 + item, "b", 0), (8, "ten " * 11, "b", 0)]
    d, i = spark.createDataFrame(docs, D), spark.createDataFrame(items, "item_id bigint, text string")
    grams = defaultdict(set)
    for k, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for x in range(len(w) - 11):
            grams[tuple(w[x:x + 12])].add(k)
    want = set()
    for k, t, *_ in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        want |= {(k, m) for x in range(len(w) - 11) for m in grams[tuple(w[x:x + 12])]}
    assert rows(contamination.leaks(d, i)) == sorted(want, key=repr)
    assert rows(contamination.leaks(d, i, most=30)) == sorted(want, key=repr) and len(contamination.gram_sets(i, 12, 30)) > 2
    assert {r.item_id: r.n_docs for r in contamination.leak_report(d, i).collect()} == Counter(m for _, m in want) | {2: 0, 3: 0}
    assert {r.doc_id for r in contamination.clean_documents(d, i).collect()} == {k for k, *_ in docs} - {k for k, _ in want}
    clean = {r.doc_id: r.text for r in contamination.clean_spans(d, i).collect()}
    assert clean[1] == "" and clean[6].split() == ["before", ".", "after!"] and clean[3] == docs[2][1] and clean[4] is None
    assert contamination.leaks(d.filter("false"), i).count() == 0 and contamination.leaks(d, i.filter("false")).count() == 0


def test_words_are_cut_before_they_are_folded(spark):
    # Folding these capitals adds marks that are no letters; they stay one word all the same.
    assert contamination.words("İstanbul ΐota STRASSE") == ["İstanbul".casefold(), "ΐota".casefold(), "strasse"]
    leaked = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, f"İstanbul ΐota {leaked} tail words here", "a", 0), (2, f"İstanbul {leaked[4:]}", "a", 0)], D)
    i = spark.createDataFrame([(1, leaked.title()), (2, f"İstanbul {leaked[8:]} xx")], "item_id bigint, text string")
    assert rows(contamination.leaks(d, i)) == [(1, 1)]
    assert rows(contamination.clean_spans(d, i)) == [(1, "İstanbul ΐota  tail words here", 12), (2, f"İstanbul {leaked[4:]}", 0)]


def test_spans_round_trip():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "É", "7", " ", "-", "\n", "\u0301"]) for _ in range(rng.randint(1, 60)))
        items = Counter(rng.choice("abcdé7") for _ in range(3))
        grams = contamination.Grams([(1, " ".join(items)), (2, "a b a b")], 2)
        at = [k for k, _ in grams.hits(text)] if len(text) >= 3 else []
        w = re.findall(r"[^\W_]+", text)
        bad = {x for k in at for x in (k, k + 1)}
        cut, n = contamination.cut(text, at, 2)
        assert n == len(bad) and re.findall(r"[^\W_]+", cut) == [x for k, x in enumerate(w) if k not in bad]


# --- 7 ---------------------------------------------------------------------------------


def test_water_fill():
    size = mixing.water_fill(100, {"a": 10, "b": 50, "c": 40}, {"a": .5, "b": .3, "c": .1, "d": .1}, {"a": 2, "b": 1, "c": 3, "d": 9})
    assert size == {"a": 20.0, "b": 50.0, "c": 30.0, "d": 0.0}
    assert mixing.water_fill(1000, {"a": 10}, {"a": 1.0}, {"a": 2}) == {"a": 20.0}
    assert mixing.water_fill(0, {}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([None, "", *["some words here " * rng.randint(1, 9)] * 9]), rng.choice(["a"] * 6 + ["b", "c", "other", None]), 0) for i in range(600)]
    targets = spark.createDataFrame([("a", .3, 1), ("b", .4, 3), ("c", .2, 1), ("gone", .1, 5), (None, .1, 1)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, D)
    enc = mixing.encoding(mixing.VOCABULARY)
    have = Counter()
    for _, t, s, _ in docs:
        if s and t:
            have[s] += len(enc.encode_ordinary(t))
    size = mixing.water_fill(sum(have.values()), have, {"a": .3, "b": .4, "c": .2, "gone": .1}, {"a": 1, "b": 3, "c": 1, "gone": 5})
    got = mixing.mixture(d, targets).collect()
    most = {"a": 1, "b": 3, "c": 1}
    used = Counter()
    for r in got:
        assert 1 <= r.copies <= most[r.source] and r.n_tokens == len(enc.encode_ordinary(docs[r.doc_id][1]))
        used[r.source] += r.copies * r.n_tokens
    longest = max(len(enc.encode_ordinary(t)) for _, t, *_ in docs if t)
    assert all(size[s] - longest <= used[s] <= size[s] for s in most)
    shares = {r.source: r for r in mixing.shares(d, targets).collect()}
    assert shares["gone"].mixed_tokens == 0 and {s: shares[s].mixed_tokens for s in most} == dict(used)
    assert {(r.doc_id, r.copies) for r in mixing.mixture(d, targets).collect()} == {(r.doc_id, r.copies) for r in got}
    assert mixing.mixture(d.filter("false"), targets).count() == 0 and mixing.mixture(d, targets.filter("false")).count() == 0


def test_long_text_tokens():
    enc = mixing.encoding(mixing.VOCABULARY)
    text = "several words, with commas and 12 numbers " * 6000
    assert mixing.count_tokens(enc, text) == len(enc.encode_ordinary(text))


# --- 8 ---------------------------------------------------------------------------------

RESIDUE = [
    "Dear {{parent_name}},", "Today pairs work on ${topic}.", "Unit #{LESSON_TITLE}: Nets", "<%= due_date %>", "Welcome to %school% at <<unit_name>>.", "{% topic %}", "__due_date__",
    "Hello null,", "Welcome back, undefined!", "#REF!", "[object Object]", "Dear ,", "your child is in class  .", "[INSERT BODY COPY HERE]", "TODO: write a title", "TBD - text to follow",
    "XXX Heading XXX", "Heading goes here", "Type your text here...", "*** replace with answer key ***", "Lorem ipsum dolor sit amet turpis.", "blah blah blah blah blah blah", "Cursus tempor fusce semper cursus pretium quis rutrum.", "Error 404: Page not found",
    "HTTP 500 – Internal Server Error", "Gone (code 410)", "We could not load this section.", "Página no encontrada.", "Traceback (most recent call last):", "THIS SITE IS UNDER CONSTRUCTION.",
    "You need to enable JavaScript to run this reader.", "Checking your browser before you continue...", "Cookies and scripts must be allowed to open this unit.", "Course portal JavaScript is disabled.",
]
PLAIN = [
    "The sign on the storeroom read “access denied”, and the children wondered who had made it.", "The museum has 404 tiles in the hall and 500 in the yard, so 33 more are needed.",
    "Some sites ask visitors to enable JavaScript, and the club explains what a script does and why.", "In algebra a letter is a placeholder: it stands in the place of a number.",
    "Printers fill an empty layout with lorem ipsum, the guide says, so that readers look at the shapes.", "Write the set of even factors as {2, 4, 6} and explain why 4 belongs to it.",
    'print(f"Hello {name}, you scored 9")', "Solve for the unknown: 3 x [  ] = 9, then <, > or = in each box.", "Name: ____________   Date: ________", "3) 4 + 5 = ____",
    "$9 for the large tray, 9% off for teams, and #9 on the list goes first.", "[Teacher reads the story aloud while the pairs follow with a finger.]", "===== PAGE 404 =====",
    "The server in the lunch hall ran into a problem with the trays, and the internal door stayed shut.", "Common errors on this page: pupils add the denominators, or they forget to regroup.",
    "They learn that a browser shows a not-found page when an address is mistyped.", None, "", "   ", "Rates of 50% and 60%, then 5% of 70% each.",
]


def test_residue(spark):
    docs = [(i, None if t is None else f"Some words come first.\n{t}\nSome more words." if i % 2 else t, "s", 0) for i, t in enumerate(RESIDUE + PLAIN)]
    docs.append((900, "plain words and more of them " * 40_000 + "\n{{topic}}", None, 0))
    d = spark.createDataFrame(docs, D)
    got = {r.doc_id for r in residue.found(d).collect()}
    want = {*range(len(RESIDUE)), 900}
    assert {(RESIDUE + PLAIN)[i] for i in (got ^ want) - {900}} == set() and 900 in got
    assert {r.doc_id for r in residue.clean(d).collect()} == {x[0] for x in docs} - want
    assert residue.found(d.filter("false")).count() == 0


def test_residue_counts_across_sources(spark):
    d = spark.createDataFrame([(i, "Please try again later.\nWords.", s, 0) for i, s in enumerate(["a", "a", "b", None])], D)
    assert rows(residue.message_report(d).select("message", "kind", "n_docs", "n_sources")) == [("Please try again later.", "error", 4, 2)]
    masked = spark.createDataFrame([("Call 12 at 5/6/2025, see https://x.org/a or me@x.org; error 404",)], "t string").select(residue.mask(F.col("t"))).first()[0]
    assert masked == "Call 0 at <date>, see <url> or <mail>; error 404"


def test_every_match_holds_a_literal_of_its_rule():
    # All rules tried on all messages without the automaton find nothing that it would hide.
    import regex

    rules = residue.Rules()
    mixed = [m for m in RESIDUE + PLAIN if m] + [f"Title of a page {m} Return to start" for m in RESIDUE] + [m.upper() for m in RESIDUE]
    for m in mixed:
        for kind, of_kind in residue.KINDS.items():
            for literals, pattern in of_kind:
                if regex.search(pattern, m, regex.I):
                    assert any(x in m.lower() for x in literals), (pattern, m)
        assert (rules.kind(m) is not None) >= any(regex.search(p, m, regex.I) for k, of_kind in residue.KINDS.items() if k not in residue.SPOKEN for _, p in of_kind)


def test_repeats_count_once_a_document(spark):
    d = spark.createDataFrame([(1, "Coming soon\nComing soon\nWords.", "a", 0)], D)
    assert residue.found(d).count() == 0
    two = d.union(spark.createDataFrame([(2, "Words.\nComing soon", "a", 0)], D))
    assert {r.doc_id for r in residue.found(two).collect()} == {1, 2}
    assert rows(residue.message_report(two).select("message", "n_docs")) == [("Coming soon", 2)]


def test_residue_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(residue, "MAX_BROADCAST", 0)
    d = spark.createDataFrame([(i, f"Words.\n{t}", "a", 0) for i, t in enumerate(["{{topic}}", "{{topic}}", "plain", "Dear ,"])], D)
    assert {r.doc_id for r in residue.found(d).collect()} == {0, 1, 3}


def test_residue_rules_need_no_cue(spark):
    # None of these has a mark or a word that a cheaper test before the rules looked for.
    texts = ["Not found", "Not found.", "NOT FOUND!", "Lesson.Title.Heading", "Sit amet elit sed erat quis."]
    d = spark.createDataFrame([(i, f"Words.\n{t}\nWords.", "s", 0) for i, t in enumerate([*texts, "U.S.A."])], D)
    assert {r.doc_id for r in residue.found(d).collect()} == set(range(len(texts)))


def test_residue_in_addresses(spark):
    bad = ["See https://school.org/{{unit_slug}} today", "www.school.org/${path}", "https://{{ host }}/a", "At https://school.org/%NAME%/a.", "https://school.org/unit/undefined",
           "http://school.org/a?b=null&c=d", "https://school.org/[object Object]", "https://school.org/%5Bobject%20Object%5D", "Write to %school%@school.org or __name__@school.org", "https://school.org/{unit}/a"]
    good = ["https://school.org/caf%C3%A9/%20a%20b", "https://school.org/undefined-terms", "https://school.org/a_b__c/$5?x=[1]", "me@school.org or www.school.org"]
    d = spark.createDataFrame([(i, f"Words.\n{t}\nWords.", "s", 0) for i, t in enumerate(bad + good)], D)
    assert {(bad + good)[r.doc_id] for r in residue.found(d).collect()} == set(bad)
    assert [r[0] for r in d.filter(d.doc_id >= len(bad)).select(residue.mask(F.element_at(F.split("text", "\n"), 2))).collect()] == ["<url>", "<url>", "<url>", "<mail> or <url>"]
