"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space collapsed. An item of m characters may differ in
``floor(rate * m)`` edits; cut into one piece more than that, at least one piece of any match is exact. One automaton
finds the exact pieces of all items in one pass over a text; the windows they point at are joined where they overlap
and verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, documents, keyed, saved, unkeyed

RATE = 0.06
#: Characters of items that are searched in one pass over the documents; more items take more passes.
BLOCK = 4_000_000
SCHEMA = "doc_id long, row long, item_id long, distance int, start int, end int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers 1999: after each character of ``text`` the edit distance of ``pattern`` to a string ending there;
    anchored: to the whole text so far."""
    m = len(pattern)
    full, top, masks = (1 << m) - 1, 1 << (m - 1), {}
    for n, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << n
    up, down, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
        yield score


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the nearest match of each item, the first of equally near ones."""
        if not self.any or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                _, item, budget = self.items[n]
                start = last + 1 - size - offset
                a, b = max(0, start - budget), min(len(text), start + len(item) + budget)
                found = windows.setdefault(n, [])
                if found and a <= found[-1][1]:  # ends grow by less than a budget's play
                    found[-1] = [min(a, found[-1][0]), max(b, found[-1][1])]
                else:
                    found.append([a, b])
        out = []
        for n, spans in windows.items():
            key, item, budget = self.items[n]
            best = min(((d, a + k + 1) for a, b in spans for k, d in enumerate(distances(item, text[a:b]))), default=(budget + 1, 0))
            if best[0] <= budget:
                distance, end = best
                before = text[max(0, end - len(item) - budget) : end][::-1]
                length = min((d, k + 1) for k, d in enumerate(distances(item[::-1], before, True)))[1]
                out.append((key, distance, end - length, end))
        return sorted(out)


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Items in normal form, a bounded number of characters at a time; empty ones match nothing."""
    held, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append((row.item_id, text))
        total += len(text)
    if held:
        yield held


def _pass(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    def run(batches):
        matcher = Matcher(items, rate)
        for batch in batches:
            rows = []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                rows += [(doc_id, row, *found) for found in matcher.find(normal(text))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["doc_id", "row", "item_id", "distance", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.mapInArrow(run, SCHEMA)


def matches(df: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item it holds within the item's edits: doc_id, row (hash of the text), item_id,
    distance, start, end (characters of the text in lower case with white space collapsed, end exclusive).

    Null and empty texts and items match nothing; repeated documents and items each have their rows. Of an item that
    occurs several times in a document the nearest occurrence counts, of equally near ones the first.
    """
    docs = documents(df).withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "row", "text")
    passes = [_pass(docs, items, rate) for items in blocks(benchmark)]
    return reduce(DataFrame.union, passes) if passes else df.sparkSession.createDataFrame([], SCHEMA)


def clean(df: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``df`` that hold no item, with all columns."""
    found = matches(df, benchmark, rate).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row").distinct()
    return unkeyed(keyed(df).join(saved(found, "matches"), ["id", "row"], "left_anti"), df.columns)
