"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are of five words (a shorter text is one shingle). A shingle's weight is its count in the
text times ln((1 + N) / (1 + df)) + 1, with df over all documents. Since every shingle
of a similar text but for a fifth of the weight stands in another text too, a
document with less than the threshold's share of its weight in shared shingles has no
near copy, and needs no samples; this loses nothing.

The others are sampled (Ioffe's scheme), ``BANDS`` bands of ``ROWS`` samples. Documents with equal
texts are one class from the start, and candidates are sought between classes. In a bucket of at most
``SMALL`` classes all pairs are candidates. A larger bucket pairs its classes with a few
``LEADERS`` of them: those that agree most with the bucket's commonest band keys, as the text that the others were
copied from does, and some arbitrary ones; and its classes are bucketed again by every two bands. Candidates are verified by
exact weighted Jaccard similarity, and verified links are joined to components. That settles most of a larger bucket; then all
its pairs that are still in different components are compared, in blocks of ``BLOCK`` classes against ``BLOCK``, so every
pair with a common band is decided.

Cases: a null text is empty; texts without words are near copies only of equal texts; a null
doc_id is kept, and is a class's id only where the class has no other; several texts under one doc_id are each
judged by themselves (texts are told apart by a 64-bit hash); repeated rows are copies of each other; a very
long text is sketched in one piece; a group's ids tie by the least; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import group_keys as gk
from .common import SLICE_BYTES, cut, grams, mix, row_key, table, texts, utf8, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
SMALL = 24
#: Leaders by agreement and arbitrary ones of a larger bucket: of one band, then of two bands.
LEADERS = ((6, 3), (0, 2))
#: Classes of a larger bucket that are compared with as many others at a time.
BLOCK = 256
#: Hash bits of a shingle in the vectors that candidates are verified with.
VECTOR_BITS = 48


def shingles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, key, count of the distinct shingles of each document, by document, then key."""
    n = len(offsets) - 1
    w = words_of(offsets, data)
    key, at = grams(w.hash, w.doc, SHINGLE)
    doc = w.doc[at]
    count = np.bincount(w.doc, minlength=n)
    short = (count > 0) & (count < SHINGLE)
    if short.any():
        first = np.searchsorted(w.doc, np.flatnonzero(short))
        total = np.zeros(len(first), np.uint64)
        for k in range(SHINGLE - 1):
            has = k < count[short]
            total = np.where(has, mix(total + w.hash[np.minimum(first + k, len(w.hash) - 1)] + np.uint64(k + 1)), total)
        key, doc = np.concatenate([key, total]), np.concatenate([doc, np.flatnonzero(short)])
    key >>= np.uint64(64 - gk.KEY_BITS)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, np.int64)
    return doc[new], key[new], np.diff(np.r_[new, len(key)])


def _parts(t: pa.Table):
    """(first row, offsets, data) of some rows at a time."""
    offsets, data = utf8(t.column("text"))
    i = 0
    while i < t.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def _frequencies(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle keys of a group and the documents that have each."""
    found = [shingles(o, d)[1] for _, o, d in _parts(t)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def samples(key: np.ndarray, weight: np.ndarray, doc_start: np.ndarray, n_samples: int) -> np.ndarray:
    """Consistent weighted samples (documents, n_samples), as 64-bit values; shingles lie by document from ``doc_start``."""
    log_weight = np.log(weight).astype(np.float32)
    sizes = np.diff(np.r_[doc_start, len(key)])
    out = np.zeros((len(doc_start), n_samples), np.uint64)
    if not len(doc_start):
        return out
    unit = np.float32(2.0**-32)
    low = np.uint64(0xFFFFFFFF)
    base = mix(key + np.uint64(0x51ED270B))
    for k in range(n_samples):
        a = mix(base + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        b = mix(a + np.uint64(0xD1B54A32D192ED03))
        c = mix(b + np.uint64(0xD1B54A32D192ED03))
        u = lambda x: (x.astype(np.float32) + np.float32(0.5)) * unit
        r = -np.log(u(a >> np.uint64(32))) - np.log(u(a & low))
        log_c = np.log(-np.log(np.minimum(u(b >> np.uint64(32)), np.float32(1 - 6e-8))) - np.log(np.minimum(u(b & low), np.float32(1 - 6e-8))))
        beta = u(c >> np.uint64(32))
        step = np.floor(log_weight / r + beta)
        value = log_c - r * (step - beta) - r
        least = np.minimum.reduceat(value, doc_start)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        of = np.searchsorted(doc_start, hit, "right") - 1
        first = hit[np.flatnonzero(np.r_[True, of[1:] != of[:-1]])]
        out[:, k] = mix(key[first] + mix(step[first].astype(np.int64).view(np.uint64)))
    return out


def vector(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted distinct keys with weights, as a palette and one index each."""
    palette, index = np.unique(weight, return_inverse=True)
    return gk.pack(np.array([len(palette)])) + palette.tobytes() + gk.pack_keys(key) + gk.pack(index)


def read_vector(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,), at = gk.unpack(blob)
    palette = np.frombuffer(blob, np.float64, int(n), at)
    key, at = gk.unpack_keys(blob, at + 8 * int(n))
    return key, palette[gk.unpack(blob, at)[0].astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


SKETCH = "a long, bands array<long>, vector binary, weight double"


def sketches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a (text key), band keys and weight vector of the text of every document that can have a near copy."""
    own = gk.grouped(docs)
    ranges, n_docs = own.ranges, own.rows

    def sending(key, t):
        return gk.send(key[0].as_py(), *(lambda k, n: (k, ranges, n))(*_frequencies(t)))

    def replying(key, t):
        groups, sizes, keys, (count,) = gk.received(t, 1)
        _, which, holders = np.unique(keys, return_inverse=True, return_counts=True)
        total = np.bincount(which, count.astype(np.int64)).astype(np.int64)
        blobs = gk.reply(groups, sizes, holders[which] > 1, total[which])
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(groups), pa.int32()), "g": pa.array(groups, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def sketching(t, replies):
        known, df = _frequencies(t)
        at, (total,) = gk.shared_columns(known, ranges, dict(zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist(), strict=True)), 1)
        df = df.astype(np.int64)
        df[at] = total.astype(np.int64)
        rows, bands, vectors, weights = [], [], [], []
        text_key = t.column("text_key").to_numpy()
        first = np.zeros(t.num_rows, bool)  # equal texts have one sketch
        first[np.unique(text_key, return_index=True)[1]] = True
        for row, offsets, data in _parts(t):
            n = len(offsets) - 1
            doc, key, count = shingles(offsets, data)
            f = df[np.searchsorted(known, key)]
            weight = count * (np.log((1 + n_docs) / (1 + f)) + 1)
            share, total_weight = np.bincount(doc, weight * (f > 1), n), np.bincount(doc, weight, n)
            chosen = (share >= (threshold - 1e-9) * total_weight) & first[row : row + n]
            here = chosen[doc]
            doc, key, weight = doc[here], key[here], weight[here]
            start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
            of = doc[start]
            drawn = samples(key, weight, start, BANDS * ROWS)
            ends = np.r_[start, len(doc)]
            band = np.zeros((len(start), BANDS), np.uint64)
            for k in range(BANDS * ROWS):
                band[:, k // ROWS] = mix(band[:, k // ROWS] + drawn[:, k] + np.uint64(k // ROWS + 1))
            place = {int(d): i for i, d in enumerate(of)}
            for d in np.flatnonzero(chosen).tolist():
                i = place.get(d)
                rows.append(row + d)
                bands.append([] if i is None else band[i].view(np.int64).tolist())
                vectors.append(vector(key[ends[i] : ends[i + 1]] >> np.uint64(gk.KEY_BITS - VECTOR_BITS), weight[ends[i] : ends[i + 1]]) if i is not None else b"")
            weights.append(total_weight[chosen])
        return pa.table({"a": text_key[np.array(rows, np.int64)], "bands": pa.array(bands, pa.list_(pa.int64())), "vector": pa.array(vectors, pa.binary()), "weight": np.concatenate(weights) if weights else np.zeros(0)})

    sent = own.docs.groupBy("g").applyInArrow(sending, gk.SENT)
    replies = sent.groupBy("bucket").applyInArrow(replying, gk.SENT)
    return own.docs.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(sketching, SKETCH)


def _leaders(large: DataFrame, agreeing: int, arbitrary: int) -> DataFrame:
    """key, leader: of each bucket of rows (key, a, bands), the classes that agree most with its commonest band keys, one of each hash part, and arbitrary ones."""
    least, part = (-F.col("a")).alias("least"), F.xxhash64("a").alias("part")
    if agreeing:
        each = large.select("key", F.posexplode("bands").alias("band", "value")).groupBy("key", "band", "value").agg(F.count("*").alias("n"))
        common = each.groupBy("key", "band").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
        common = cut(common.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("band", "value")))["value"].alias("common")))
        agree = F.size(F.filter(F.zip_with("bands", "common", lambda x, y: x == y), lambda x: x))
        scored = large.join(common, "key").select("key", F.struct(agree.alias("score"), least).alias("s"), part)
    else:
        scored = large.select("key", F.struct(F.lit(0).alias("score"), least).alias("s"), part)
    drawn = F.struct(F.xxhash64("key", "s.least").alias("h"), F.col("s.least").alias("least"))
    of = lambda n, i: F.pmod("part", F.lit(n)) == i
    best = [F.max(F.when(of(agreeing, i), F.col("s")))["least"] for i in range(agreeing)] + [F.min(F.when(of(arbitrary, i), drawn))["least"] for i in range(arbitrary)]
    found = scored.groupBy("key").agg(F.array_distinct(F.array(*best)).alias("leaders")).select("key", F.explode("leaders").alias("least"))
    return cut(found.filter("least is not null").select("key", (-F.col("least")).alias("leader")))


def _bucket_pairs(members: DataFrame, agreeing: int, arbitrary: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of rows (key, a, bands), and the classes a, bands of buckets over ``SMALL``."""
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    sized = cut(members.join(sizes, "key"))
    small, large = sized.filter(F.col("n") <= SMALL).select("key", "a"), sized.filter(F.col("n") > SMALL).drop("n")
    pairs = small.join(small.select("key", F.col("a").alias("b")), "key").filter("a < b").select("a", "b")
    led = large.select("key", "a").join(_leaders(large, agreeing, arbitrary), "key").filter("a != leader").select(F.least("a", "leader").alias("a"), F.greatest("a", "leader").alias("b"))
    return pairs.union(led).distinct(), large.select("a", "bands").dropDuplicates(["a"])


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of class representatives (a, bands)."""
    live, out = reps.filter(F.size("bands") == BANDS), None
    for level, leaders in enumerate(LEADERS, 1):
        sets = F.array(*(F.array(*(F.lit(i) for i in of)) for of in itertools.combinations(range(BANDS), level)))
        keys = F.transform(sets, lambda of: F.xxhash64(of, F.transform(of, lambda i: F.get("bands", i))))
        pairs, large = _bucket_pairs(live.select("a", "bands", F.explode(keys).alias("key")), *leaders)
        out = pairs if out is None else out.union(pairs)
        if level < len(LEADERS):
            live = cut(large)
            if live.isEmpty():
                break
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of edges (a, b): least labels spread over links and are then followed to their own labels."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        spread = labels.join(near, "a").select("a", F.least("label", "near").alias("mid"), F.col("label").alias("old"))
        far = labels.select(F.col("a").alias("mid"), F.col("label").alias("far"))
        new = cut(spread.join(far, "mid", "left").select("a", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"))
        labels = new.select("a", "label")
        if new.filter("label != old").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def _decide(t: pa.Table, band: int, threshold: float) -> list[tuple[int, int]]:
    """Rows (x, y) of a block pair (a, c, at, bands, vector, weight) that are near copies, as far as their components c are not joined yet."""
    c, at, weight = (t.column(k).to_numpy().copy() for k in ("c", "at", "weight"))
    bands = np.array(t.column("bands").to_pylist(), np.int64)[:, :band]
    known = [read_vector(v) for v in t.column("vector").to_pylist()]
    shingle, place = np.unique(np.concatenate([k for k, _ in known]), return_inverse=True)
    value, starts = np.concatenate([w for _, w in known]), np.cumsum([0, *(len(k) for k, _ in known)])
    sums, lower, n = np.add.reduceat(value, starts[:-1]), at.min(), t.num_rows
    between, dense, out = bool((at != lower).any()), np.zeros(len(shingle)), []
    for x in np.flatnonzero(at == lower).tolist():
        # By the weights alone two texts can be too far apart; and a pair that shares an earlier band is decided there.
        could = (c != c[x]) & (np.minimum(weight, weight[x]) >= (threshold - 1e-9) * np.maximum(weight, weight[x])) & (at != lower if between else np.arange(n) > x)
        could &= ~(bands == bands[x]).any(axis=1)
        if not could.any():
            continue
        own = slice(starts[x], starts[x + 1])
        dense[place[own]] = value[own]
        both = np.add.reduceat(np.minimum(dense[place], value), starts[:-1])
        dense[place[own]] = 0
        close = both / (sums[x] + sums - both)
        for y in np.flatnonzero(could & (close >= threshold - 1e-9)).tolist():
            if c[y] != c[x] and similarity(known[x], known[y]) >= threshold:
                out.append((x, y))
                c[c == c[y]] = c[x]
    return out


def remaining_links(reps: DataFrame, labels: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) between components in the buckets of more than ``SMALL`` of the representatives (a, bands, vector, weight); None if no such bucket has several components."""
    live = reps.filter(F.size("bands") == BANDS)
    classes = live.select("a", "bands").join(labels.select(F.col("node").alias("a"), "component"), "a", "left")
    members = cut(classes.select("a", F.coalesce("component", "a").alias("c"), F.posexplode("bands").alias("band", "value")))
    sizes = members.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).filter((F.col("n") > SMALL) & (F.col("least") < F.col("most")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    of = members.join(cut(sizes.select("band", "value", blocks.alias("blocks"))), ["band", "value"])
    of = cut(of.withColumn("at", F.pmod(F.xxhash64("a", F.lit(1)), F.col("blocks")).cast("int")))
    if of.isEmpty():
        return None
    each = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("a", "c", "at", "band", "value", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))

    def deciding(key, t):
        i, j = key[2].as_py(), key[3].as_py()
        if i != j and len(set(t.column("at").to_pylist())) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found, a = _decide(t, key[0].as_py(), threshold), t.column("a").to_pylist()
        return pa.table({"a": pa.array([a[x] for x, _ in found], pa.int64()), "b": pa.array([a[y] for _, y in found], pa.int64())})

    return cut(each.join(live.select("a", "bands", "vector", "weight"), "a").groupBy("band", "value", "i", "j").applyInArrow(deciding, "a long, b long"))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row_key, class_id (the least doc_id of its near copies), text_class (of its exact copies) and class_key (which every class has) of every row."""
    reps = cut(sketches(docs, threshold).dropDuplicates(["a"]))
    pairs = cut(candidates(reps.select("a", "bands")))
    one, two = reps.select("a", F.col("vector").alias("va")), reps.select(F.col("a").alias("b"), F.col("vector").alias("vb"))

    def verify(batches):
        for batch in batches:
            close = [similarity(read_vector(x), read_vector(y)) >= threshold for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    links = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long"))
    labels = components(links)
    more = remaining_links(reps, labels, threshold)
    if more is not None and not more.isEmpty():
        labels = components(links.union(more))
    own = texts(docs).select("doc_id", row_key().alias("row_key"), F.xxhash64("text").alias("node"))
    # Tables, so that joins with a very large class can be split.
    members = cut(own.join(labels, "node", "left").select("doc_id", "row_key", "node", F.coalesce("component", "node").alias("class_key")))
    least = lambda key, out: cut(members.groupBy(key).agg(F.min("doc_id").alias(out)))
    return members.join(least("class_key", "class_id"), "class_key").join(least("node", "text_class"), "node").select("doc_id", "row_key", "class_id", "text_class", "class_key")


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_class")
