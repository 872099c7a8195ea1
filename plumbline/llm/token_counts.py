"""Token counts: every distinct pre-token is counted once, and documents add up the counts.

A task splits whole texts into pre-tokens, some megabytes of them (a chunk) at a time. Of each chunk it writes its distinct
pre-tokens, numbered, and its frequencies: for each pre-token the documents that have it and how often each does. The
pre-tokens are exchanged and sorted, each distinct one is counted once with the
tokenizer's library, and its count goes back to the chunks that have it, where it is joined to the frequencies and
summed per document. No ids are kept, and all rows grow with the chunks' distinct pre-tokens.
A pre-token that many documents have is exchanged by pre-token and share of the input (``SHARE`` partitions), so
however frequent it is, a task gets a bounded part of its rows, and counts it anew.

Chunks are numbered by partition and place, so ``docs`` should be a table, whose rows stand in the same
places whenever it is read. Cases: every row of the input is counted by itself, whatever its id, which can be
null or repeated; equal rows give equal rows; a null text is empty and has no token; a very long text is one
row like any other; an empty table gives no rows; extra columns, whatever their names, are ignored.
Counts have no ties.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_parts, texts, utf8

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
#: Text characters whose pre-tokens a task gathers before it writes them.
GATHER = 16 << 20
#: Documents of a chunk at most (their places fit 16 bits), frequency that an entry can have (a greater one is several), and pre-tokens of a written batch.
ROWS, TIMES, WRITE = 1 << 15, (1 << 15) - 1, 20_000
#: Documents of a chunk beyond which a pre-token is exchanged by shares of so many partitions (a power of two).
MANY, SHARE = 64, 6
#: What a task holds of a pre-token and document: the document's place, above how often the pre-token stands there.
_DOC_SHIFT, _TIMES_MASK = 40, (1 << 40) - 1
#: A chunk's number is its partition and its place there.
PLACE_BITS = 40
#: Pre-tokens of the model's own splitting pattern; special strings are cut out first.
PATTERN = regex.compile(public_tokenizers.PATTERN)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return sorted((x["content"] for x in json.load(f)["added_tokens"]), key=len, reverse=True)


#: Code points on whose classes the ``regex`` module and the tokenizer agree (a test holds them against each other).
PLAIN = regex.compile("[\\x00-\\u052f\\u0600-\\u06ff\\u0900-\\u097f\\u2000-\\u206f\\u3040-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fef\\uac00-\\ud7a3\\U0001f300-\\U0001f64f]*")


def splitter(path: str):
    """A function from a text to its pre-tokens, special strings among them."""
    specials, before = _specials(path), _tokenizer(path).pre_tokenizer

    def plain(text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in before.pre_tokenize_str(text)]

    if not specials:
        return plain
    cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return plain(text)
        return [x for i, part in enumerate(cut.split(text)) for x in ([part] if i % 2 else plain(part))]

    return split


#: A chunk's frequencies, one after another in bytes; named: whether each document has an id.
_CHUNK = {"docs": np.int16, "times": np.int16, "sizes": np.int32, "doc_id": np.int64, "named": np.bool_, "n_bytes": np.int64}
_FOUND = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("piece", pa.string()), ("in_docs", pa.int32()), ("frequencies", pa.binary())])
_COUNTED = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("frequencies", pa.binary())])


def _packed(columns: dict) -> bytes:
    parts = [np.asarray(columns[c]).astype(kind) for c, kind in _CHUNK.items()]
    whole = np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> dict[str, np.ndarray]:
    blob = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    out, at = {}, 8 * len(_CHUNK)
    for (c, kind), n in zip(_CHUNK.items(), np.frombuffer(blob, np.int64, len(_CHUNK)).tolist(), strict=True):
        out[c] = np.frombuffer(blob, kind, n, at)
        at += out[c].nbytes
    return out


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """``rows`` rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def chunks(docs: DataFrame, path: str) -> DataFrame:
    """Rows of two kinds: chunk, place, piece, in_docs (documents that have it); and chunk, frequencies: by piece, in the order of places, docs (places in the chunk, each less the one before), times and sizes (entries of each piece), and by document doc_id and n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, size, rows, chunk = splitter(path), {}, 0, [], TaskContext.get().partitionId() << PLACE_BITS

        def write():
            names = sorted(held)
            lists = [held.pop(x) for x in names]
            in_docs = np.fromiter(map(len, lists), np.int32, len(lists))
            ends = np.cumsum([0, *in_docs])
            both = np.frombuffer(b"".join(lists), np.int64)
            times = both & _TIMES_MASK
            entries = -(-times // TIMES)
            each = np.full(entries.sum(), TIMES)
            each[np.cumsum(entries) - 1] = times - (entries - 1) * TIMES
            doc, sizes = np.repeat(both >> _DOC_SHIFT, entries), np.diff(np.r_[0, np.cumsum(entries)][ends]).astype(np.int32)
            ids, n_bytes = zip(*rows, strict=True)
            own = {"docs": np.diff(doc, prepend=0), "times": each, "sizes": sizes, "doc_id": [d or 0 for d in ids], "named": [d is not None for d in ids], "n_bytes": n_bytes}
            yield _batch(_FOUND, 1, chunk=pa.array([chunk]), frequencies=pa.array([_packed(own)], pa.binary()))
            for i in range(0, len(names), WRITE):
                part = names[i : i + WRITE]
                yield _batch(_FOUND, len(part), chunk=pa.array([chunk] * len(part)), place=pa.array(np.arange(i, i + len(part), dtype=np.int32)), piece=pa.array(part, pa.string()), in_docs=pa.array(in_docs[i : i + len(part)]))

        for part, words in text_parts(batches):
            for doc_id, n_bytes, text in zip(part.column("doc_id").to_pylist(), np.diff(utf8(part.column("text"))[0]).tolist(), words, strict=True):
                i = len(rows)
                rows.append((doc_id, n_bytes))
                for x, n in Counter(split(text)).items():
                    if x in held:
                        held[x].append(i << _DOC_SHIFT | n)
                    else:
                        held[x] = array("q", (i << _DOC_SHIFT | n,))
                size += len(text)
                if size >= GATHER or len(rows) == ROWS:
                    yield from write()
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield from write()

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, place int, piece string, in_docs int, frequencies binary")


def counted(found: DataFrame, path: str) -> DataFrame:
    """chunk, place, n (tokens of the piece), and the chunks' other rows as they are; ``found`` is sorted by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = _tokenizer(path), ("", 0)
        for whole in batches:
            is_chunk = pc.is_null(whole.column("piece"))
            own, batch = whole.filter(is_chunk), whole.filter(pc.invert(is_chunk))
            if len(own):
                yield _batch(_COUNTED, len(own), chunk=own.column("chunk"), frequencies=own.column("frequencies"))
            if not len(batch):
                continue
            coded = batch.column("piece").dictionary_encode()
            names, n = coded.dictionary.to_pylist(), np.zeros(len(coded.dictionary), np.int32)
            again = names[0] == known[0]  # the piece that the batch before ended with
            n[0] = known[1] if again else 0
            for i in range(int(again), len(names), 2048):
                n[i : i + 2048] = [len(e.ids) for e in t.encode_batch(names[i : i + 2048], add_special_tokens=False)]
            of = coded.indices.to_numpy()
            known = (names[of[-1]], n[of[-1]])
            yield _batch(_COUNTED, len(batch), chunk=batch.column("chunk"), place=batch.column("place"), n=pa.array(n[of]))

    return found.mapInArrow(run, "chunk long, place int, n int, frequencies binary")


def _summed(t: pa.Table) -> pa.Table:
    """doc_id, n_bytes, n_tokens of a chunk's documents."""
    is_chunk = pc.is_valid(t.column("frequencies"))
    own, pieces = t.filter(is_chunk), t.filter(pc.invert(is_chunk))
    of = _unpacked(own.column("frequencies")[0].as_py())
    n = np.zeros(len(of["sizes"]), np.int64)
    n[pieces.column("place").to_numpy()] = pieces.column("n").to_numpy()
    tokens = np.bincount(np.cumsum(of["docs"], dtype=np.int64), np.repeat(n, of["sizes"]) * of["times"].astype(np.int64), len(of["doc_id"])).astype(np.int64)
    return pa.table({"doc_id": pa.array(of["doc_id"], mask=~of["named"]), "n_bytes": of["n_bytes"], "n_tokens": tokens})


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    path = public_tokenizers.path(model)
    share = F.when(F.col("in_docs") > MANY, F.shiftright("chunk", PLACE_BITS + SHARE)).otherwise(F.lit(-1))
    found = chunks(texts(docs), path).repartition(F.coalesce("piece", F.col("chunk").cast("string")), share).sortWithinPartitions("piece")
    each = counted(found, path).groupBy("chunk").applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return each.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
