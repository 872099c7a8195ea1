"""Shared pieces of the corpus operators.

* ``cut`` writes an intermediate table into the shared checkpoint folder and
  reads it back, so that a lost executor costs one stage and not the lineage;
  ``drop`` deletes such tables once what reads them is written, and ``forget`` all
  that this process has cut, once results are written.
* ``utf8``/``slices`` give numpy views of Arrow text columns.
* ``words_of`` finds and hashes all words of a slice of documents at once.

Word definition everywhere: maximal runs of bytes other than 0x20, 0x09-0x0D.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as numpy arrays at a time (a longer text is a slice of its own).
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII string in SQL, bit by bit."""
    bit = "lambda v, _: xor(v >> 1, (v & 1) * 3988292384)"
    byte = f"lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), {byte}), 4294967295)"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, with no lineage behind it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _written.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``cut`` gave, once all that reads them is written; other frames are left alone."""
    for df in frames:
        if (at := getattr(df, "_cut_at", None)) in _written:
            _written.remove(at)
            _delete(df.sparkSession, at)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this process has cut; frames that read them end with it."""
    while _written:
        _delete(spark, _written.pop())


def row_key():
    """What tells rows apart whose ids clash or are null: a 64-bit hash of id and text. Equal rows have equal keys."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone; a null text is an empty one. Other columns never reach the operators."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, offsets from 0, bytes) of some whole documents at a time, about ``size`` bytes."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        offsets, data = utf8(batch.column("text"))
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield ids[i:j], offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            i = j


def text_parts(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of about ``size`` bytes of text at a time, whole texts, and their texts."""
    for batch in batches:
        offsets, i = utf8(batch.column("text"))[0], 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            part = batch.slice(i, j - i)
            yield part, part.column("text").to_pylist()
            i = j


# Polynomial hashes modulo 2**64 over per-byte random values; any substring's hash is a difference of prefixes.
_RNG = np.random.default_rng(20240607)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps)
    return have[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """n + 1 prefix sums; see ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power("inverse", _INVERSE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end), equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _power("base", _BASE, len(prefix))[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """All words of a slice: the slice-wide byte range, document index and hash of each; and the hash prefixes of the slice."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray


def words_of(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # a word never crosses into the next document
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    doc = np.searchsorted(offsets, start, "right") - 1
    prefix = prefix_hash(data)
    return Words(start, end, doc, span_hash(prefix, start, end), prefix)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position on, and the positions where all n are of one document."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out + hashes[at + k] + np.uint64(0x9E3779B97F4A7C15))
    return out, at
