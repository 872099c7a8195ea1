"""Vector code compression: a code of one entry number for each part of a vector, from codebooks fitted on all vectors.

Components become whole numbers, floor(256 x), and vectors are cut into equal parts. A task takes some thousands of
vectors at a time (a chunk); of each part position it sorts the chunk's parts along a Hilbert curve and cuts them into
flat blocks of ``BLOCK`` parts, which keep their least and greatest components (a box) and their sums. A round measures the
distances of each box to the entries of the codebook: only an entry whose least distance to the box is no more than the smallest
greatest distance can be the nearest of any of its parts. A block with one such entry gives its sums as they are; the others are
evaluated against their shortlists in whole numbers. The parts of a chunk add up to at most 64 sums for each part position, Spark adds those
over the chunks, and the driver gets ``PARTS`` x ``ENTRIES`` sums a round, whatever the table's size.

Cases: rows whose vector is null, empty, or holds a null or a non-finite component are dropped, as is a vector whose length is not that of
the first one (by vec_id); a length that ``parts`` does not divide, or a component beyond ``LARGEST`` in size, whose squares could pass
a long, raises. Null vec_ids stand last. Equal vec_ids are rows of their own, ordered by their vectors; with fewer rows than entries
there are fewer entries; equal distances go to the lower index. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a chunk, and parts of a block.
CHUNK, BLOCK = 1 << 14, 16
#: Components in size: differences of 2**25 squared, of 4,096 components, still sum below 2**63.
LARGEST = float(1 << 16)
#: Labels whose errors are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """A whole number for each point (a row of whole numbers), in the order of a Hilbert curve; of finer grids than fit, the upper bits."""
    points = points[:, :62] - points[:, :62].min(axis=0)
    d, bits = points.shape[1], max(1, int(points.max()).bit_length())
    fit = 62 // d
    x = (points >> max(0, bits - fit)).T.copy()
    bits = min(bits, fit)
    # Undo the rotations of the curve from the coarsest bit to the finest, then the Gray code across the axes.
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in range(d):
            on = (x[axis] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in range(d):
            key = (key << 1) | (((x[axis] ^ flip) >> b) & 1)
    return key


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of points (blocks x points x components) and their boxes: each point's nearest entry, and for each block its only candidate or -1."""
    under, over = low[:, None, :] - entries, entries - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(entries - low[:, None, :]), np.abs(entries - high[:, None, :])) ** 2).sum(axis=2)
    listed = least <= most.min(axis=1)[:, None]
    many = listed.sum(axis=1)
    found = np.empty(points.shape[:2], np.int64)
    alone = np.where(many == 1, listed.argmax(axis=1), -1)
    found[many == 1] = alone[many == 1][:, None]
    for size in np.unique(many[many > 1]).tolist():  # blocks with shortlists of one length are evaluated at once
        at = np.flatnonzero(many == size)
        short = np.nonzero(listed[at])[1].reshape(-1, size)
        apart = ((points[at][:, :, None, :] - entries[short][:, None, :, :]) ** 2).sum(axis=3)
        found[at] = np.take_along_axis(short, apart.argmin(axis=2), axis=1)  # ascending, so ties go to the lower index
    return found, alone


def _blocked(points: np.ndarray, block: int) -> dict[str, bytes]:
    """One part position of a chunk (rows of components): order, points, and boxes and sums of its blocks."""
    order = np.argsort(hilbert_keys(points), kind="stable")
    n, d = points.shape
    blocks = -(-n // block)
    own = points[order]
    padded = own[np.minimum(np.arange(blocks * block), n - 1)].reshape(blocks, block, d)  # the last point fills the last block
    sums = np.add.reduceat(own, np.arange(0, n, block), axis=0)
    return {"placed": order.astype(np.int32).tobytes(), "points": own.astype(np.int32).tobytes(), "low": padded.min(axis=1).tobytes(), "high": padded.max(axis=1).tobytes(), "sums": sums.tobytes()}


_FIELDS = ["placed", "points", "low", "high", "sums"]
_BLOCKS = pa.list_(pa.struct([(f, pa.binary()) for f in _FIELDS]))


class Part:
    """One part position of a stored chunk."""

    def __init__(self, stored: dict, d: int, block: int):
        of = lambda name, kind: np.frombuffer(stored[name], kind).astype(np.int64)
        self.placed, own = of("placed", np.int32), of("points", np.int32).reshape(-1, d)
        self.n, self.low, self.high, self.sums = len(own), of("low", np.int64).reshape(-1, d), of("high", np.int64).reshape(-1, d), of("sums", np.int64).reshape(-1, d)
        self.own, self.block = own, block
        self.points = own[np.minimum(np.arange(len(self.low) * block), self.n - 1)].reshape(-1, block, d)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, alone = nearest(self.points, self.low, self.high, entries)
        return found.reshape(-1)[: self.n], alone

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many parts each entry has, and their sums."""
        found, alone = self.nearest(entries)
        count = np.bincount(found, minlength=len(entries))
        total = np.zeros(entries.shape, np.int64)
        whole = alone >= 0
        np.add.at(total, alone[whole], self.sums[whole])
        rest = ~np.repeat(whole, self.block)[: self.n]
        np.add.at(total, found[rest], self.own[rest])
        return count, total


def _valid(df: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)


def chunks(rows: DataFrame, parts: int, chunk: int, block: int) -> DataFrame:
    """vec_id and label (lists of a chunk's rows) and its blocks by part position; ``rows`` has vec_id, label and v of one length."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def write(batch: pa.Table) -> pa.RecordBatch:
            batch = batch.combine_chunks()
            x = pc.list_flatten(batch.column("v")).to_numpy().astype(np.float64).reshape(len(batch), -1)
            if np.abs(x).max() >= LARGEST:
                raise ValueError(f"components of {LARGEST:g} and more in size are not coded")
            x = np.floor(x * SCALE).astype(np.int64).reshape(len(batch), parts, -1)
            blocks = [_blocked(np.ascontiguousarray(x[:, p]), block) for p in range(parts)]
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays([whole("vec_id"), whole("label"), pa.array([blocks], _BLOCKS)], ["vec_id", "label", "blocks"])

        for b in batches:
            at = 0
            while at < len(b):
                part = b.slice(at, min(chunk - size, len(b) - at))
                held.append(part)
                size, at = size + len(part), at + len(part)
                if size == chunk:
                    yield write(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield write(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, blocks array<struct<{', '.join(f'{f}: binary' for f in _FIELDS)}>>")


def totals(stored: DataFrame, books: np.ndarray, block: int) -> DataFrame:
    """part, entry, n and the sums of the components (s0 on) of the parts nearest to each entry, over all chunks."""
    parts, entries, d = books.shape
    names = [f"s{i}" for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
            for row in batch.column("blocks"):
                for p, own in enumerate(row):
                    n, s = Part(own.as_py(), d, block).totals(books[p])
                    count[p] += n
                    total[p] += s
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, count[part, entry], *total[part, entry].T)], ["part", "entry", "n", *names])

    found = stored.select("blocks").mapInArrow(run, ", ".join(f"{c} long" for c in ["part", "entry", "n", *names]))
    return found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *names]))


@functools.cache
def _hex() -> np.ndarray:
    return np.array([f"{i:02x}" for i in range(256)], "S2")


def coded(stored: DataFrame, books: np.ndarray, block: int) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts, _, d = books.shape
    kinds = {f.name: f.dataType.elementType.simpleString() for f in stored.schema.fields if f.name != "blocks"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column("vec_id")[i].values, batch.column("label")[i].values
                codes, error = np.zeros((len(ids), parts), np.int64), np.zeros(len(ids), np.int64)
                for p, own in enumerate(batch.column("blocks")[i]):
                    part = Part(own.as_py(), d, block)
                    found, _ = part.nearest(books[p])
                    codes[part.placed, p] = found
                    error[part.placed] += ((part.own - books[p][found]) ** 2).sum(axis=1)
                text = pa.array(_hex()[codes].view(f"S{2 * parts}").ravel()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def books_of(start: np.ndarray, stored: DataFrame, rounds: int, block: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after the rounds."""
    books = start.copy()
    for _ in range(rounds):
        for r in totals(stored, books, block).collect():  # parts x entries rows at most
            books[r.part, r.entry] = [s // r.n for s in r[3:]]
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept row; the codebooks); ``vectors`` has vec_id, label and embedding. No rows: no codebook either."""
    rows = _valid(vectors.select("vec_id", "label", F.col("embedding").alias("v")))
    first = lambda df: [r.v for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    start = first(rows)
    d = len(start[0]) if start else parts
    if any(len(v) != d for v in start):
        start = first(rows.filter(F.size("v") == d))
    if d % parts:
        raise ValueError(f"vectors of {d} components are not cut into {parts} equal parts")
    books = np.floor(np.array(start, np.float64).reshape(len(start), parts, d // parts) * SCALE).astype(np.int64).transpose(1, 0, 2)
    stored = cut(chunks(rows.filter(F.size("v") == d), parts, chunk, block))
    books = books_of(books, stored, rounds, block)
    return coded(stored, books, block), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds the sum of the errors of equal labels, nulls together."""
    codes = cut(codes)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


_RANKS = " UNION ALL ".join(f"SELECT {p} AS part, list_slice(q, {4 * p + 1}, {4 * p + 4}) AS x, id, label FROM kept" for p in range(PARTS))


def _oracle(d: int = 64) -> str:
    """The same by measuring every part against every entry."""
    width = d // PARTS
    apart = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in range(1, width + 1))
    means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, width + 1))
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.part, p.id, p.label, p.x, min(struct_pack(d := {apart}, entry := b.entry)) AS best FROM parts p JOIN b{k} b USING (part) GROUP BY 1, 2, 3, 4)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, best.entry AS entry, [{means}] AS x FROM a{k} GROUP BY 1, 2) m USING (part, entry))")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED ({_RANKS}),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, x FROM parts WHERE id IN (SELECT id FROM kept ORDER BY id LIMIT {ENTRIES})),
{", ".join(steps)},
rows AS MATERIALIZED (SELECT id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1, 2)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM rows"""


ORACLE = _oracle()
