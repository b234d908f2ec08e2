"""Benchmark passages in documents, by pigeonhole matching with a bounded edit distance.

Texts are compared lower-cased and with every run of white space as one space. A test item of m characters may have
``budget`` * m edits (rounded down, e). It is cut into e + 1 pieces: whatever e edits do, one piece stays as it is.
All pieces of all items are found in one pass over a document by an Aho-Corasick automaton. Around each hit the item is
searched by Myers' bit-parallel algorithm, with one bit per character of the item in a Python integer.

Items are a stated query set. They are taken in blocks of bounded size, each block is one pass over the documents, so
the automaton that goes to the executors has a fixed bound whatever the benchmark holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches, store

BUDGET = 0.08
# characters of a block's items
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def search(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least distance, its first end) of the non-empty pattern and any part of the text.

    With ``anchored`` the part begins where the text begins.
    """
    masks, m = _masks(pattern), len(pattern)
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    carry = int(anchored)
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 | carry
        plus = (down << 1 | ~(xv | up)) & full
        minus = up & xv & full
        if score < best:
            best, end = score, i
    return best, end


class Items:
    """A block of items, ready to be searched."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        import ahocorasick

        self.items = [(i, normal(t)) for i, t in items]
        self.edits = [int(len(t) * budget + 1e-9) for _, t in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            n = self.edits[k] + 1
            for j in range(n if text else 0):
                a, b = len(text) * j // n, len(text) * (j + 1) // n
                places.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str, one: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of every item within its budget; with ``one``, of any."""
        if self.empty:
            return []
        text = normal(text)
        near: dict[int, list[list[int]]] = {}
        for last, (length, at) in self.automaton.iter(text):
            for k, a in at:
                e = self.edits[k]
                begin = last + 1 - length - a
                low, high = max(0, begin - e), begin + len(self.items[k][1]) + e
                spans = near.setdefault(k, [])
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        out = []
        for k, spans in near.items():
            item_id, pattern = self.items[k]
            found = None
            for low, high in spans:
                distance, end = search(pattern, text[low:high])
                if distance <= self.edits[k] and (found is None or distance < found[0]):
                    found = (distance, low, low + end)
            if found is not None:
                distance, low, end = found
                # its start, by the same search backwards from the end
                _, back = search(pattern[::-1], text[low:end][::-1], anchored=True)
                out.append((item_id, distance, end - back, end))
                if one:
                    break
        return out


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items of ``items(item_id, text)`` in blocks of about ``limit`` characters, streamed through the driver."""
    held, size = [], 0
    for row in items.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


_CACHE: dict[str, Items] = {}


def _built(key: str, shared, budget: float) -> Items:
    """This worker's automaton of a broadcast block."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Items(shared.value, budget)
    return _CACHE[key]


FOUND = "doc_id long, item_id long, distance int, start long, end long"


def find_items(docs: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, distance, start, end of every document and item that it holds within the item's budget.

    ``docs(doc_id, text, ...)`` are searched whole; start and end count characters of the normalised text. The best
    place counts, the first of equals. Null and empty texts hold nothing, null and empty items are held by nothing.
    Repeated rows and null ids give rows of their own; other columns are ignored. Empty tables give an empty result.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(items):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def each(batches, shared=shared, key=key):
            searched = _built(key, shared, budget)
            for piece in W.passes(batches):
                found = [(i, *m) for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True) if t for m in searched.matches(t)]
                columns = zip(*found, strict=True) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = rows.mapInArrow(each, FOUND)
        # later blocks must not repeat the passes of the earlier ones
        out = part if out is None else store(out, "decontaminate").unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def without_items(docs: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs(text, ...)`` that hold no item within its budget, with all their columns."""
    bounded_batches(docs.sparkSession)
    for block in blocks(items):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def each(batches, shared=shared, key=key):
            searched = _built(key, shared, budget)
            for piece in W.passes(batches):
                clean = [not t or not searched.matches(t, one=True) for t in piece.column("text").cast(pa.string()).to_pylist()]
                yield piece.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(each, docs.schema)
    return docs


