"""Corpus-wide counts of hashed keys, known to the documents that hold the keys.

Documents are dealt by hash into groups. A group sends its distinct
keys, sorted and packed, to key ranges; a range adds up what all groups have of a key and
replies, to each group, which of its keys other groups have too and their counts over the corpus. A key of
one group only needs no reply: its own count is the corpus count. A very frequent key is one entry for each group.

A row from a group to a range holds some ``ROW_KEYS`` keys, so rows grow with the distinct keys of
the groups and not with the square of the groups: beyond ``GROUP_BYTES`` squared over ``ROW_BYTES`` (some 40 GB of text) there are
fewer ranges than groups, and both grow in size with the square root of the text (some 300 MB at 100 TB).

Equal rows are spread over groups by their partition too, so ``docs`` should be a
table, whose rows stand in the same partitions whenever it is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Keys are the upper bits of 64-bit hashes.
KEY_BITS = 56
#: Least size of a group, keys that a row holds at least, and the text that so many come from.
GROUP_BYTES, ROW_KEYS = 6 << 20, 128
ROW_BYTES = 8 * ROW_KEYS


@dataclass(frozen=True)
class Grouped:
    docs: DataFrame  # g, doc_id, text and text_key
    groups: int
    ranges: int
    rows: int


def sizes(total: int, group_bytes: int) -> tuple[int, int]:
    """Groups and ranges for ``total`` bytes of text."""
    size = max(group_bytes, math.isqrt(total * ROW_BYTES))
    groups = max(1, math.ceil(total / size))
    return groups, max(1, min(groups, size // ROW_BYTES))


def grouped(docs: DataFrame, group_bytes: int | None = None) -> Grouped:
    own = texts(docs)
    rows, total = own.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    n, ranges = sizes(total or 0, group_bytes or GROUP_BYTES)
    g = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int")
    return Grouped(own.select(g.alias("g"), "doc_id", "text", F.xxhash64("text").alias("text_key")), n, ranges, rows)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes each as the greatest needs, byte planes apart."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + len(values).to_bytes(8, "little") + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers packed at ``at``, and where the next thing starts."""
    width, n = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little")
    planes = np.frombuffer(blob, np.uint8, width * n, at + 9).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel(), at + 9 + width * n


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    steps, at = unpack(blob, at)
    return np.cumsum(steps, dtype=np.uint64), at


def cuts(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The key ranges that have some of the sorted keys, and where their keys start, and the end."""
    of = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return of[at].astype(np.int64), np.append(at, len(keys))


SENT = "bucket int, g int, blob binary"


def send(g: int, keys: np.ndarray, ranges: int, *columns: np.ndarray) -> pa.Table:
    """Rows for the key ranges: sorted distinct keys with columns of unsigned integers."""
    of, at = cuts(keys, ranges)
    rows = []
    for i, b in enumerate(of.tolist()):
        part = slice(at[i], at[i + 1])
        rows.append((b, pack_keys(keys[part]) + b"".join(pack(c[part]) for c in columns)))
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "g": pa.array([g] * len(rows), pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})


def received(t: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """What one range got, groups in order: groups, key count of each, all keys, all columns."""
    t = t.sort_by("g")
    keys, cols, sizes = [], [[] for _ in range(columns)], []
    for blob in t.column("blob").to_pylist():
        k, at = unpack_keys(blob)
        keys.append(k)
        sizes.append(len(k))
        for c in cols:
            v, at = unpack(blob, at)
            c.append(v)
    return t.column("g").to_numpy(), np.array(sizes), np.concatenate(keys), [np.concatenate(c) for c in cols]


def reply(groups: np.ndarray, sizes: np.ndarray, shared: np.ndarray, *columns: np.ndarray) -> list[bytes]:
    """For each group: which of its keys are shared, and columns of those."""
    out, ends = [], np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        here = shared[a:b]
        out.append(pack(np.packbits(here)) + b"".join(pack(c[a:b][here]) for c in columns))
    return out


def shared_columns(keys: np.ndarray, ranges: int, replies: dict[int, bytes], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Reads the replies to what ``send`` sent: positions of shared keys, and their columns."""
    (of, at), places, cols = cuts(keys, ranges), [], [[] for _ in range(columns)]
    for i, b in enumerate(of.tolist()):
        n = at[i + 1] - at[i]
        bits, end = unpack(replies[b])
        places.append(at[i] + np.flatnonzero(np.unpackbits(bits.astype(np.uint8), count=n)))
        for c in cols:
            v, end = unpack(replies[b], end)
            c.append(v)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(places), [join(c) for c in cols]
