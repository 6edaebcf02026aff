"""Evaluation texts in training text (problem 6).

Method: the normalised n-grams of all test items form a hash set that is broadcast;
the token windows of the corpus are scanned against it where they lie, hits are
verified word by word, and the leaked spans or whole documents are removed.

A word is cut from the text as it stands and then folded, so that folding can part no
word. The set has words as numbers: a window is tried only where all its words occur
in items, and what it is tried with are its words themselves, so a hit is verified.
Rows have no expression that looks a window up in a set, and a row per window would
cost more than the whole scan, so batches of texts go to Python.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 12
#: N-grams of one set at most, about 200 bytes each; more of them are tried set by set, each with a scan of its own.
MAX_GRAMS = 200_000
#: A word is an unbroken run of letters and digits.
WORD = regex.compile(r"[\p{L}\p{N}]+")
ASCII_WORD = regex.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return [w.casefold() for w in WORD.findall(text)]


class Grams:
    """The n-grams of some items: which items each belongs to, and the vocabulary."""

    def __init__(self, items: Iterator[tuple[int, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        held = defaultdict(set)
        for item, text in items:
            at = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            ids = np.array(at, dtype=np.int32)
            for k in range(len(ids) - n + 1):
                held[ids[k : k + n].tobytes()].add(item)
        self.items = {g: tuple(sorted(s)) for g, s in held.items()}

    def hits(self, text: str | None) -> list[tuple[int, tuple[int, ...]]]:
        """(at, items) of each window of n words that is an n-gram of items."""
        if not text or len(text) < 2 * self.n - 1:
            return []
        known = self.vocabulary.get
        ids = np.array([known(w, -1) for w in words(text)], dtype=np.int32)
        if len(ids) < self.n:
            return []
        # Windows without a foreign word: as many foreign words before their end as before their start.
        foreign = np.concatenate([[0], np.cumsum(ids < 0)])
        out, n = [], self.n
        for k in np.flatnonzero(foreign[n:] == foreign[:-n]).tolist():
            found = self.items.get(ids[k : k + n].tobytes())
            if found:
                out.append((k, found))
        return out


def gram_sets(items: DataFrame, n: int, most: int) -> list:
    """Broadcast sets of the n-grams of all items, each of at most `most` unless a single item has more.

    The items of a set are fetched together; their share of the whole is known from
    their lengths, so the driver holds one set at a time.
    """
    long = items.filter(F.col("item_id").isNotNull() & (F.length("text") >= 2 * n - 1)).select("item_id", "text")
    # A text of c characters has at most c / 2 words.
    total = long.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    parts = int(total // most) + 1
    context = items.sparkSession.sparkContext
    sets = []
    for k in range(parts):
        rows = long.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toLocalIterator()
        sets.append(context.broadcast(Grams(((r.item_id, r.text) for r in rows), n)))
    return sets


def scanned(documents: DataFrame, items: DataFrame, n: int, most: int) -> DataFrame:
    """(doc_id, item_id): the items of each set that each document leaks; once per set, as an item lies in one set."""

    def scan(grams):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    out += [(doc, i) for i in sorted({i for _, found in grams.value.hits(text) for i in found})]
                yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        return run

    # Ids go as text: with nulls among them pandas would hold them as floats.
    texts = documents.select(F.col("doc_id").cast("string"), "text").filter(F.length("text") >= 2 * n - 1)
    parts = [texts.mapInPandas(scan(g), "doc_id string, item_id bigint") for g in gram_sets(items, n, most)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def leaks(documents: DataFrame, items: DataFrame, n: int = N, most: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, item_id): one row per document and item that share n consecutive words.

    Null texts and texts of fewer words have none, items without an id are left out;
    repeated rows of an id count once.
    """
    return scanned(documents, items, n, most).distinct()


def leak_report(documents: DataFrame, items: DataFrame, n: int = N, most: int = MAX_GRAMS) -> DataFrame:
    """(item_id, n_docs) of every item; 0 where it does not leak."""
    counts = leaks(documents, items, n, most).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))


def clean_documents(documents: DataFrame, items: DataFrame, n: int = N, most: int = MAX_GRAMS) -> DataFrame:
    """The documents without those that hold a leak."""
    return documents.join(leaks(documents, items, n, most).select("doc_id").distinct(), "doc_id", "left_anti")


def cut(text: str | None, hits: list[int], n: int) -> tuple[str | None, int]:
    """The text without the words of the windows that begin at `hits`, and how many words went."""
    if not hits:
        return text, 0
    spans = [m.span() for m in WORD.finditer(text)]
    out, at, removed, first, last = [], 0, 0, hits[0], hits[0] + n - 1
    for k in [*hits[1:], len(spans) + n]:
        if k > last + 1:
            out.append(text[at : spans[first][0]])
            at, removed, first = spans[last][1], removed + last - first + 1, k
        last = k + n - 1
    return "".join([*out, text[at:]]), removed


def clean_spans(documents: DataFrame, items: DataFrame, n: int = N, most: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, text, n_removed): all documents, leaked spans of words cut out of their text.

    Overlapping and adjoining windows are one span; it goes from its first word's
    start to its last word's end. Texts without a leak are returned as they are. One
    scan where the texts lie, without a join.
    """
    sets = gram_sets(items, n, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                at = sorted({k for g in sets for k, _ in g.value.hits(text)})
                rows.append((doc, *cut(text, at, n)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_removed"])

    cleaned = documents.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, text string, n_removed bigint")
    return cleaned.withColumn("doc_id", F.col("doc_id").cast("bigint"))
