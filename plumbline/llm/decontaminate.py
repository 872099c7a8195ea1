"""Benchmark decontamination: pigeonhole edit matching.

An item of m characters may differ from a passage by k = m // 20 edits. Cut into k + 1
pieces, one piece must then stand in the passage unchanged; an Aho-Corasick automaton finds
all pieces of all items in one pass over a text, and Myers' bit-parallel
distance verifies the place around each hit. Both sides are case-folded, with runs of white
space as one space; positions are in that form of the text.

Items come through the driver to the executors in blocks of at most ``BLOCK_CHARS`` characters, one
pass over the documents for each block. An item longer than a block is a block of its own.

Cases: null texts are empty; a null doc_id or item_id stays null; several texts under one id each match by themselves; a very long text is searched in one piece; an empty item matches nothing; items under 20 characters match
exactly; items with equal texts each match; repeated documents each match; an empty
table gives no rows; extra columns are ignored. A document's best place for an item is the one with
the least distance, then the first.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

CHARS_PER_EDIT = 20
BLOCK_CHARS = 4 << 20


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def myers(pattern, text, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of the text, if at most ``most``, and that stretch's end; else (-1, -1)."""
    m = len(pattern)
    masks: dict = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) & full) ^ plus) | x
        h_plus = minus | (full & ~(d0 | plus))
        h_minus = plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus <<= 1  # a stretch may start anywhere: the row above the pattern is all zero
        plus = ((h_minus << 1) & full) | (full & ~(d0 | (h_plus & full)))
        minus = h_plus & full & d0
        if score < best:
            best, end = score, j + 1
    return (best, end) if end >= 0 else (-1, -1)


def edit_distance(a, b) -> int:
    """Edit distance of two whole sequences by the same bit-parallel recursion, its top row counting up."""
    m = len(a)
    if not m:
        return len(b)
    masks: dict = defaultdict(int)
    for i, c in enumerate(a):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in b:
        eq = masks.get(c, 0)
        d0 = ((((eq & plus) + plus) & full) ^ plus) | eq | minus
        h_plus, h_minus = minus | (full & ~(d0 | plus)), plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = ((h_plus << 1) | 1) & full
        plus, minus = ((h_minus << 1) & full) | (full & ~(d0 | h_plus)), h_plus & d0
    return score


def edits_of(chars: int) -> int:
    return chars // CHARS_PER_EDIT


@functools.lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...]):
    import ahocorasick

    at: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, text) in enumerate(items):
        n = edits_of(len(text)) + 1
        cuts = [len(text) * k // n for k in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            at[text[a:b]].append((i, a))
    found = ahocorasick.Automaton()
    for piece, places in at.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found


def find(items: tuple[tuple[int, str], ...], text: str) -> list[tuple[int, int, int, int]]:
    """(item index, distance, start, end) of each item in a normal text, its best place."""
    best: dict[int, tuple[int, int, int, int]] = {}
    seen: dict[int, set[tuple[int, int]]] = defaultdict(set)  # an item's verified windows: a later hit can have an earlier one
    for last, (n, places) in _automaton(items).iter(text):
        for i, offset in places:
            item = items[i][1]
            m, k = len(item), edits_of(len(item))
            start = last + 1 - n - offset
            if i in best and best[i][1] == 0:
                continue
            if start >= 0 and text.startswith(item, start):
                best[i] = (i, 0, start, start + m)
                continue
            a, b = max(0, start - k), min(len(text), start + m + k)
            if (a, b) in seen[i]:
                continue
            seen[i].add((a, b))
            distance, end = myers(item, text[a:b], k)
            if distance < 0 or i in best and (best[i][1], best[i][3]) <= (distance, a + end):
                continue
            back, length = myers(item[::-1], text[a : a + end][::-1], k)
            best[i] = (i, distance, a + end - length if back == distance else max(a, a + end - m), a + end)
    return list(best.values())


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normal text) of every item found in a document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("text != ''")
    own = texts(docs)
    schema = "doc_id long, item_id long, distance int, start long, end long"
    out = spark.createDataFrame([], schema)
    for known in _blocks(items):
        out = out.union(own.mapInArrow(_finder(spark.sparkContext.broadcast(known)), schema))
    return out


def _blocks(items: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in their normal form, some at a time: BLOCK_CHARS characters of them, or a longer one alone."""
    block, size = [], 0
    for r in items.toLocalIterator():
        if not (text := normal(r.text)):
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield tuple(block)
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text)
    if block:
        yield tuple(block)


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            rows = [(d, *hit) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in find(items, normal(text))]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([items[r[1]][0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
