"""Benchmark decontamination: test items found in documents within an edit budget.

An item of n characters may differ by ``ERROR_RATE`` * n edits.  It is split into one piece more than it may
have errors, so any occurrence within the budget holds one piece unchanged, shifted by no more than the budget.
Exact piece hits come from one Aho-Corasick pass over a document; the item is then compared with the window
around the hit by Myers' bit-parallel edit distance, a machine-integer column for each character of the window.
An item of fewer than ``FUZZY_FROM`` characters has no budget: it is one piece and must occur as it is, as whole words.

Items and documents are compared in lower case with white space collapsed to single blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.shared import bounded_batches, lean, written

ERROR_RATE = 0.08  #: edits allowed for each character of an item
FUZZY_FROM = 24  #: characters from which an item may differ at all
ITEMS_PER_BLOCK = 4000  #: items searched for in one pass over the documents; more items, more passes


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n_chars: int) -> int:
    return int(n_chars * ERROR_RATE) if n_chars >= FUZZY_FROM else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that cover the item."""
    n = budget(len(item)) + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item's character masks for Myers' algorithm, for both reading directions."""

    def __init__(self, item: str):
        self.item, self.top, self.all = item, 1 << (len(item) - 1), (1 << len(item)) - 1
        self.forward, self.backward = self._masks(item), self._masks(item[::-1])

    @staticmethod
    def _masks(item: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for k, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << k
        return masks

    def distances(self, text: str, backward: bool = False) -> Iterator[int]:
        """Edit distance of the item to the best substring that ends at each character of ``text``.

        ``backward``: of the reversed item to the prefix of ``text`` that ends there.
        """
        masks, top, full = (self.backward if backward else self.forward), self.top, self.all
        plus, minus, score = full, 0, len(self.item)
        first = 1 if backward else 0
        for c in text:
            equal = masks.get(c, 0)
            across = (((equal & plus) + plus) ^ plus) | equal
            equal |= minus
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = ((up << 1) | first) & full
            down = (down << 1) & full
            plus = down | (full & ~(equal | up))
            minus = up & equal
            yield score

    def best(self, text: str, most: int) -> tuple[int, int, int] | None:
        """(distance, start, stop) of the best match within ``most`` edits: least distance, then first end, then longest."""
        found = min(((d, k + 1) for k, d in enumerate(self.distances(text))), default=None)
        if found is None or found[0] > most:
            return None
        distance, stop = found
        back = text[:stop][::-1][: len(self.item) + most]
        begin = max((k + 1 for k, d in enumerate(self.distances(back, backward=True)) if d == distance), default=stop)
        return distance, stop - begin, stop


class Searcher:
    """One automaton of all pieces of a block of items."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        import ahocorasick

        self.items = [(item_id, Pattern(text)) for item_id, text in items]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, pattern) in enumerate(self.items):
            for offset, piece in pieces(pattern.item):
                owners.setdefault(piece, []).append((k, offset))
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) for each item found: its best place in the normalised text, the first of equals."""
        if self.empty or not text:
            return []
        places: dict[int, set[int]] = {}
        for end, (size, own) in self.automaton.iter(text):
            for k, offset in own:
                if size >= FUZZY_FROM or len(self.items[k][1].item) >= FUZZY_FROM or _apart(text, end + 1 - size, end + 1):
                    places.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, begins in sorted(places.items()):
            item_id, pattern = self.items[k]
            most, n, best, upto = budget(len(pattern.item)), len(pattern.item), None, -1
            ordered = sorted(begins)
            at = 0
            while at < len(ordered):
                first = last = ordered[at]
                while at < len(ordered) and ordered[at] <= last + 2 * most + 1:  # hits on near diagonals share a window
                    last = ordered[at]
                    at += 1
                lo = max(0, first - most)
                found = pattern.best(text[lo : last + n + most], most)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], lo + found[1], lo + found[2]
            if best:
                out.append((item_id, *best))
        return out


def _apart(text: str, start: int, stop: int) -> bool:
    """Whether no word goes on over the ends of text[start:stop]."""
    joined = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
    return not joined(start) and not joined(stop)


@lru_cache(1)
def _searcher(items: tuple[tuple[int, str], ...]) -> Searcher:
    return Searcher(items)


def _blocks(items: DataFrame) -> list[tuple[tuple[int, str], ...]]:
    """The items in blocks of about ``ITEMS_PER_BLOCK``, one after another."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = -(-rows.count() // ITEMS_PER_BLOCK)
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        cut = sorted((r["item_id"], normalised(r["text"])) for r in own.toLocalIterator())
        yield tuple(x for x in cut if x[1])


def find_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, stop) for every document and item within the item's budget.

    documents: ``doc_id`` and ``text``, items: ``item_id`` and ``text``; further columns are ignored.  Rows without a
    text, and items without a character, find nothing.  start and stop are in the normalised document, of the best
    place, the first of equals.  Repeated documents are reported each; items that share an id are searched for each.
    What one block of items finds is a table in the shared folder before the next block is read, so driver and tasks
    hold one block; a single block needs no table.
    """
    bounded_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")

    def searching(items_: tuple[tuple[int, str], ...]):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(items_)
            for batch in batches:
                found = [(doc_id, *hit) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in searcher.search(normalised(text))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        return search

    kind = "doc_id long, item_id long, distance int, start long, stop long"
    out = held = None
    for block in _blocks(items):
        if held is not None:
            own = written(held, "found-items")
            out = own if out is None else out.unionByName(own)
        held = rows.mapInArrow(lean(searching(block)), kind)
    if held is None:
        return documents.sparkSession.createDataFrame([], kind)
    return held if out is None else out.unionByName(written(held, "found-items"))


def without_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, in which no item was found; null ids are kept apart by their text."""
    leaked = find_items(documents.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(leaked, F.xxhash64(documents["doc_id"], documents["text"]) == leaked["_leaked"], "left_anti")
