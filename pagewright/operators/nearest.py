"""The page nearest to a name by word counts, within one block of a document's pages."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

#: Pages of one block: what a task holds at once. Names of a document meet each of its blocks.
PAGE_BLOCK = 8192
#: Rows turned into Python objects at once; answers and word vectors kept for a block.
ROWS, ANSWERS, VECTORS = 512, 50_000, 1024
Bag = tuple[int, tuple[tuple[int, int], ...]]
#: Places of a WordFilter; words whose answers a task remembers.
PLACES, KNOWN = 1 << 21, 100_000


class WordFilter(dict):
    """Whether a word may be in a set of words: True for each of the set, and by chance for few others.

    The set is a bit for each word's CRC-32 modulo PLACES, so its size is fixed. bits is
    what Spark's bitmap functions make of the places, by their buckets of 32,768.
    """

    def __init__(self, bits: dict[int, bytes]):
        super().__init__()
        self.bits = bits

    def __reduce__(self):
        return WordFilter, (self.bits,)

    def __missing__(self, word: str) -> bool:
        if len(self) >= KNOWN:
            self.clear()
        bucket, at = divmod(zlib.crc32(word.encode()) % PLACES, 32_768)
        part = self.bits.get(bucket)
        found = self[word] = part is not None and bool(part[at >> 3] >> (at & 7) & 1)
        return found


def page_bags(batches: Iterator[pa.RecordBatch], stops: frozenset[str], asked: WordFilter) -> Iterator[pa.RecordBatch]:
    """The rows with fewer words, and rest: words (separated by spaces) keeps those that are asked for, each as often as before.

    Stop words go; of the others that go, rest is the sum of the squared counts.
    """
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            words, rests = [], []
            for text in batch.column("words").to_pylist():
                kept, rest = [], 0
                for word, tf in Counter(text.split()).items():
                    if word not in stops:
                        if asked[word]:
                            kept.append(word if tf == 1 else " ".join([word] * tf))
                        else:
                            rest += tf * tf
                words.append(" ".join(kept))
                rests.append(rest)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"words": pa.array(words, pa.string()), "rest": pa.array(rests, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class WordBlock:
    """Pages, added in their order (of versions of a page the last counts), then names.

    The answer depends on the words that a name shares with the block and on its length
    alone, so names that agree in both are answered once. For another, the counts of
    each shared word are added up for all pages of the block at a time.
    """

    def __init__(self, stops: frozenset[str]):
        self.stops, self.numbers, self.bags, self.rests = stops, [], [], []
        self.postings = None

    def count(self, words: str) -> Counter:
        counts = Counter(words.split())
        for word in self.stops.intersection(counts):
            del counts[word]
        return counts

    def add(self, page: int, words: str, rest: int = 0) -> None:
        """rest: the squared counts of words that the page has and no name asks for."""
        if self.numbers and self.numbers[-1] == page:
            self.bags[-1], self.rests[-1] = self.count(words), rest
        else:
            self.numbers.append(page)
            self.bags.append(self.count(words))
            self.rests.append(rest)

    def close(self) -> None:
        # A page without words is near to no name.
        kept = [(n, b, r) for n, b, r in zip(self.numbers, self.bags, self.rests) if b]
        self.numbers, self.bags, self.rests = [n for n, _, _ in kept], None, None
        self.norms = np.array([sum(t * t for t in b.values()) + r for _, b, r in kept], dtype=np.float64)
        self.places, self.postings = {}, []
        for at, (_, bag, _) in enumerate(kept):
            for word, tf in bag.items():
                if (place := self.places.get(word)) is None:
                    place = self.places[word] = len(self.postings)
                    self.postings.append(([], []))
                ats, tfs = self.postings[place]
                ats.append(at)
                tfs.append(tf)
        self.answers, self.vectors, self.lengths = {}, {}, {}

    def vector(self, place: int) -> np.ndarray:
        """The counts of a word on all pages of the block."""
        if (v := self.vectors.get(place)) is None:
            if len(self.vectors) >= VECTORS:
                self.vectors.clear()
            v = self.vectors[place] = np.zeros(len(self.numbers))
            ats, tfs = self.postings[place]
            v[ats] = tfs
        return v

    def length(self, n1: int) -> np.ndarray:
        if (v := self.lengths.get(n1)) is None:
            if len(self.lengths) >= VECTORS:
                self.lengths.clear()
            v = self.lengths[n1] = np.sqrt(float(n1) * self.norms)
        return v

    def nearest(self, bag: Bag) -> tuple[int, float]:
        n1, shared = bag
        (place, tf), *rest = shared
        dots = self.vector(place) * tf
        for place, tf in rest:
            dots += self.vector(place) if tf == 1 else self.vector(place) * tf
        dots /= self.length(n1)
        at = int(dots.argmax())  # the first of equal ones
        return self.numbers[at], float(dots[at])

    def answer(self, words: str) -> tuple[int | None, float | None]:
        if self.postings is None:
            self.close()
        counts = self.count(words)
        shared = sorted((self.places[w], tf) for w, tf in counts.items() if w in self.places)
        if not shared:
            return None, None
        bag = sum(tf * tf for tf in counts.values()), tuple(shared)
        if (found := self.answers.get(bag)) is None:
            if len(self.answers) >= ANSWERS:
                self.answers.clear()
            found = self.answers[bag] = self.nearest(bag)
        return found


def nearest_in_blocks(batches: Iterator[pa.RecordBatch], stops: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """doc_id, name, page, sim for rows (doc_id, block, kind, page, name, words separated by spaces) in order of doc_id, block, kind (pages 0, names 1) and page.

    Where page_bags left words out, a page has a rest too.
    Names without a near page have a row in block 0 only, where all names are.
    """
    key, block = None, WordBlock(stops)
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            docs, blocks, kinds, pages, words = (batch.column(c).to_pylist() for c in ("doc_id", "block", "kind", "page", "words"))
            rests = batch.column("rest").to_pylist() if "rest" in batch.schema.names else [0] * batch.num_rows
            out, asked = [], []
            for (doc, number, kind), run in groupby(range(batch.num_rows), lambda i: (docs[i], blocks[i], kinds[i])):
                if key != (doc, number):
                    key, block = (doc, number), WordBlock(stops)
                if kind == 0:
                    for i in run:
                        block.add(pages[i], words[i], rests[i])
                else:
                    for i in run:
                        found = block.answer(words[i])
                        if number == 0 or found[0] is not None:
                            asked.append(i)
                            out.append(found)
            if asked:
                taken = batch.take(pa.array(asked))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("doc_id"), taken.column("name"), pa.array([p for p, _ in out], pa.int32()), pa.array([s for _, s in out], pa.float64())],
                    names=["doc_id", "name", "page", "sim"])
