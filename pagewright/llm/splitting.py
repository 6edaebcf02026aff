"""Splitting oversized texts at natural boundaries (problem 3).

Method: the least number of pieces that can hold the text is computed, cuts are aimed
at equal distances, each is moved to the strongest boundary near its aim, and where the
rest of the text no longer fits into the pieces planned for it, it gets one more. The
plan is made anew for the rest after each cut, so nothing is cut twice and the time
grows with the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: A boundary counts as near an aim within one REACHth of a piece's share.
REACH = 6

#: Boundaries from the strongest to the weakest; a cut lies at a match's end.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),  # a blank line
    re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]\s*"),  # a line's end
    re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+"),  # a sentence's end
    re.compile(r"[;:,،、，；](?=\s)\s+|\s[–—-]\s+"),  # a clause's end
    re.compile(r"\s+"),  # between words
]


def whole(text: str, at: int, low: int) -> int:
    """The nearest place at or before `at`, but after `low`, that parts no letter from its marks."""
    while at > low + 1 and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return at


def snap(text: str, aim: int, low: int, high: int) -> int:
    """The strongest boundary in low < cut <= high; of equal ones the nearest to the aim, then the first."""
    window = text[low:high]
    for kind in BOUNDARIES:
        cuts = [low + m.end() for m in kind.finditer(window) if m.end() and (low + m.end() < high or not text[high : high + 1].isspace())]
        if cuts:
            return min(cuts, key=lambda c: (abs(c - aim), c))
    return whole(text, aim, low)


def overlap_start(text: str, cut: int, overlap: int, floor: int) -> int:
    """Where the piece after `cut` begins to repeat: at most `overlap` back, at a sentence or else a word."""
    low = max(floor, cut - overlap)
    if low >= cut:
        return cut
    window = text[low:cut]
    for kind in (BOUNDARIES[2], BOUNDARIES[4]):
        for m in kind.finditer(window):
            if m.end() < len(window):
                return low + m.end()
    return low


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece; text[start:fresh] repeats the piece before.

    Pieces have at most `limit` characters (code points) and cover the text: the
    pieces' text[fresh:end] joined are the text. A text within the limit is one piece.
    """
    size, room = len(text), limit - overlap
    pieces, start, fresh = [], 0, 0
    while size - start > limit:
        # The least number of pieces for the rest, this one with its repeated part among them; equal shares of what is fresh.
        count = 1 + -(-(size - start - limit) // room)
        share = (size - fresh) / count
        high = min(start + limit, size - 1)
        aim = min(round(fresh + share), high)
        reach = int(share / REACH)
        cut = snap(text, aim, max(fresh, aim - reach), min(high, aim + reach))
        pieces.append((start, fresh, cut))
        start, fresh = overlap_start(text, cut, overlap, fresh), cut
    return [*pieces, (start, fresh, size)]


def split_batches(batches: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            for k, (start, fresh, end) in enumerate(cut_text(row.text, limit, overlap)):
                out.append((row.index_id, row.doc_id, row.page, k, start, fresh - start, row.text[start:end]))
        yield pd.DataFrame(out, columns=["index_id", "doc_id", "page", "piece", "start", "repeated", "text"])


def split_long(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text over the limit: index_id, doc_id, page, piece (0-based), start, repeated, text.

    `repeated` characters at a piece's start are the end of the piece before. Null
    texts and texts within the limit give no rows; every repeated row gives its own
    pieces. Needs columns index_id, doc_id, page and text; others are not read. Rows
    are cut where they are, without a shuffle, and only long ones reach Python.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half the limit")
    long = pages.select("index_id", "doc_id", "page", "text").filter(F.length("text") > limit)
    return long.mapInPandas(
        lambda it: split_batches(it, limit, overlap),
        "index_id bigint, doc_id string, page int, piece int, start bigint, repeated int, text string")


def found(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(index_id) of every row that had to be cut."""
    return split_long(pages, limit, overlap).filter(F.col("piece") == 0).select("index_id")
