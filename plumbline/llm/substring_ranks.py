"""Exact-substring dedup: every byte under a string of ``length`` bytes that starts anywhere else goes.

Prefix doubling with two economies. (1) Positions are ranked in blocks. Each window of
``length`` bytes has an anchor, the leftmost least of its hashed 32-byte strings; equal windows have equal anchors at
equal offsets, so a block is an anchor with a range of offsets, and needs ranking only against
blocks with the same range. (2) A rank is a 64-bit fingerprint, since only equality matters.

Each round ranks blocks by a pair: the rank of the string common to all windows of
the block (the core), and the rank of the string that spans them all (the hull). Spark groups and joins
the position-rank pairs. A block with a unique core has no repeated window and
leaves; one with a repeated hull is past the threshold and its hull's bytes go; the rest,
and the first of each finished class as their witness, are ranked again in narrower blocks, by longer cores,
until a core is the whole window: 216, 364 and at last 400 bytes for windows of 400 (``block_sizes``).

Rows with the same document id and text are documents of their own, each a copy of the
others. A null text is empty; texts shorter than ``length`` keep all; an empty table
gives no rows; extra columns are ignored; a very long text is cut into overlapping parts while anchors are sought.
Of equal strings all go, none is kept as the first, and equal least hashes fall to the leftmost: there are no other ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, prefix_hash, slices, span_hash, table, texts, utf8

LENGTH, GRAM = 400, 32
#: Window starts of one text looked at together; positions within are packed into 24 bits.
PART = 8 << 20
_LOW = np.uint64((1 << 24) - 1)
#: Text bytes of a batch of results.
OUT_BYTES = 4 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_J = 1024  # blocks an anchor can have; positions are anchor * _J + block


def block_sizes(length: int, gram: int = GRAM) -> tuple[int, ...]:
    """Offsets in a block, by round, each a divisor of the one before: cores of about a half and nine tenths of the window, then all of it."""
    if not gram <= length < _J:
        raise ValueError(f"strings of {gram} to {_J - 1} bytes")
    narrow = -(-(length - gram + 1) // 10)
    return (5 * narrow, narrow, 1) if narrow > 1 else (1,)


def _anchors(prefix: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """The anchor of the window at each of the n - length + 1 starts."""
    w, out = length - gram + 1, []
    for at in range(0, n - length + 1, PART):
        m = min(PART + w - 1, n - gram + 1 - at)
        start = np.arange(at, at + m)
        key = (span_hash(prefix, start, start + gram) & ~_LOW) | np.arange(m, dtype=np.uint64)
        full = np.full(-(-m // w) * w, np.uint64(2**64 - 1))
        full[:m] = key
        rows = full.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        out.append((np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & _LOW).astype(np.int64) + at)
    return np.concatenate(out)


def blocks(offsets: np.ndarray, data: np.ndarray, size: int, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """doc (index), pos (anchor within the document * 1024 + block), core and hull ranks of all blocks of ``size`` offsets; hull 0: it leaves the document."""
    empty = {"doc": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "core": np.zeros(0, np.int64), "hull": np.zeros(0, np.int64)}
    n = len(data)
    if n < length:
        return empty
    prefix = prefix_hash(data)
    start = np.arange(n - length + 1)
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[doc + 1]
    if not inside.any():
        return empty
    anchor = _anchors(prefix, n, length, gram)[inside]
    start, doc = start[inside], doc[inside]
    j = (anchor - start) // size
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (j[1:] != j[:-1])])
    anchor, j, doc = anchor[new], j[new], doc[new]
    least, most = j * size, np.minimum((j + 1) * size, length - gram + 1) - 1
    core = span_hash(prefix, anchor - least, anchor - most + length)
    a, b = anchor - most, anchor - least + length
    whole = (a >= offsets[doc]) & (b <= offsets[doc + 1])
    hull = np.where(whole, span_hash(prefix, np.where(whole, a, 0), np.where(whole, b, 1)) | np.uint64(1), np.uint64(0))
    return {"doc": doc, "pos": (anchor - offsets[doc]) * _J + j, "core": core.view(np.int64), "hull": hull.view(np.int64)}


def _ranked(docs: DataFrame, size: int, within: int | None, length: int) -> DataFrame:
    """key columns, pos, core, hull of the blocks of all texts, or of those in the wider blocks (of ``within`` offsets) that ``pos`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(["doc_id", *batch.schema.names[1:]])
            hash_of, row = batch.column("text_hash").to_numpy(), 0
            lists = batch.column("listed") if within else None
            for ids, offsets, data in slices(iter([batch])):
                b = blocks(offsets, data, size, length)
                if within:
                    part = lists.slice(row, len(ids))
                    o = part.offsets.to_numpy().astype(np.int64)
                    listed = np.repeat(np.arange(len(ids)), np.diff(o)) << 40
                    listed += part.values.to_numpy()[o[0] : o[-1]]
                    wide = b["pos"] // _J * _J + b["pos"] % _J * size // within
                    here = np.isin((b["doc"] << 40) + wide, listed)
                    b = {k: v[here] for k, v in b.items()}
                yield pa.RecordBatch.from_arrays([pa.array(ids[b["doc"]]), pa.array(hash_of[row : row + len(ids)][b["doc"]]), pa.array(b["pos"]), pa.array(b["core"]), pa.array(b["hull"])], ["key", "text_hash", "pos", "core", "hull"])
                row += len(ids)

    return docs.select("key", "text", "text_hash", *(["listed"] if within else [])).mapInArrow(run, "key long, text_hash long, pos long, core long, hull long")


def repeated_spans(own: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, text_hash, spans: array of (start, end) byte ranges, overlapping, that repeated strings cover."""
    docs, within, spans, sizes = own, None, None, block_sizes(length)
    for size in sizes:
        every = cut(_ranked(docs, size, within, length))
        # Written, so that joins with a very frequent core can be split.
        repeated = cut(every.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"))
        rows = cut(every.join(repeated, "core"))
        drop(every, repeated)
        at = F.struct("key", "text_hash", "pos")
        classes = rows.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(at).alias("first"))
        classes = cut(classes.select("core", "hull", "first", ((F.col("hull") != 0) & (F.col("n") > 1)).alias("done")))
        # The first of each finished class is ranked on where an unfinished one of its core may repeat a part of it.
        open_cores = cut(classes.groupBy("core").agg(F.max(~F.col("done")).alias("open")).filter("open"))
        known = cut(classes.join(open_cores, "core", "left"))
        on = ~F.col("done") | (F.col("open") & (F.col("first") == at))
        marked = cut(rows.join(known, ["core", "hull"]).select("key", "text_hash", "pos", "done", on.alias("on")))
        drop(rows, classes, open_cores, known)
        anchor, j = F.expr(f"pos div {_J}"), F.expr(f"pos % {_J}")
        most = F.least((j + 1) * size, F.lit(length - GRAM + 1)) - 1
        found = marked.filter("done").select("key", "text_hash", (anchor - most).alias("start"), (anchor - j * size + length).alias("end"))
        spans = found if spans is None else spans.union(found)
        if size == sizes[-1]:
            break
        mixed = marked.filter("on").groupBy("key", "text_hash").agg(F.collect_set("pos").alias("listed"))
        before, docs, within = docs, cut(docs.drop("listed").join(mixed, ["key", "text_hash"])), size
        drop(before)
    return spans.groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, removed: array of (start, end) maximal byte runs, kept: the other bytes; and ``carried``, a struct of the columns to carry.

    With ``whole_characters`` a character that a run cuts in two leaves ``kept`` too, so ``kept`` is text; ``removed`` is the same.
    """
    keys = {"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "text_hash": F.xxhash64("text")}
    spans = repeated_spans(texts(docs).withColumns(keys).select("key", "text", "text_hash"), length)
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), carried.alias("carried")).withColumns(keys)
    both = full.join(spans, ["key", "text_hash"], "left").select("doc_id", "text", "spans", "carried")

    def runs_of(spans: list[dict] | None) -> list[dict]:
        runs = []
        for s in sorted(spans or (), key=lambda s: s["start"]):
            if runs and s["start"] <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], s["end"])
            else:
                runs.append(dict(s))
        return runs

    def rest(text: np.ndarray, runs: list[dict]) -> bytes:
        parts, at = [], 0
        for s in runs:
            start, end = s["start"], s["end"]
            while whole_characters and start > at and start < len(text) and text[start] & 0xC0 == 0x80:
                start -= 1
            while whole_characters and end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            parts.append(text[at:start].tobytes())
            at = end
        return b"".join([*parts, text[at:].tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends, i = utf8(whole.column("text"))[0], 0
            while i < len(whole):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + OUT_BYTES, "right")) - 1)
                batch = whole.slice(i, j - i)
                offsets, data = utf8(batch.column("text"))
                removed = [runs_of(spans) for spans in batch.column("spans").to_pylist()]
                kept = [rest(data[a:b], runs) for a, b, runs in zip(offsets[:-1], offsets[1:], removed, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, _RUNS), pa.array(kept, pa.binary()), batch.column("carried")], ["doc_id", "n_bytes", "removed", "kept", "carried"])
                i = j

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary").add("carried", both.schema["carried"].dataType)
    return both.mapInArrow(run, schema)


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
