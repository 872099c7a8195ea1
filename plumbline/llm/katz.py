"""Language-model scoring with a Katz backoff model of words and word pairs.

Counts are Good-Turing discounted up to ``CUTOFF``. A seen pair has P(w | h) = d_r r / c(h); an
unseen one a(h) P(w), with a(h) = (1 - sum of seen P(v | h)) / (1 - sum of P(v) over the seen v),
so that every history's probabilities, the unknown word's included, add up to one. A document is
scored recursively per token: by the pair, else through its history's backoff weight by the
word, else by the unknown word.

The counts are tables partitioned by key range (``group_keys``): groups of documents
send their words and pairs, get back the training counts of those that other groups have too,
and know the rest themselves. Each pair of the training text is then one group's to
report, for its history: that group sends the history's discounted and backed-off mass to the
history's key range, which sums a(h) and answers the groups whose held-out documents ask. All that is
summed is whole numbers (how many of a history's pairs, and of the words in them, have each discounted count), so weights are exact to
the last bits of a double. The driver gets the Good-Turing counts of counts, 16 numbers, and nothing else.

Where no discount can be had (no pair occurs once, say), a history keeps 1 / (c(h) + 1) for
unseen words, and the unknown word has 1 / (N + 1) at least, everything else scaled to fit.

Cases: a null text is empty: its only token is its end; a null doc_id counts as text ""; a very long text is one
document like any other; equal counts need no order; several texts under one doc_id are documents of their own;
repeated rows are trained on and scored each; with no training document every token has the unknown word's probability, 1;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import group_keys as gk
from .common import cut, mix, slices, table, words_of

CUTOFF = 5
FOLDS = 10
_TOP = np.uint64(64 - gk.KEY_BITS)
#: Hashes of the end token, and of the start, which is a history only.
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Kind of a row with counts of counts 1 to CUTOFF + 1, tokens, distinct; of words, then of pairs.
_STATS = -1


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS == 0 for d in doc_ids], bool)


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, word key and pair key of every token, ends included, in document order; A-Z are lower-cased."""
    w = words_of(offsets, data, lower=True)
    n = len(offsets) - 1
    doc = np.concatenate([w.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    doc, word = doc[order], np.concatenate([w.hash, np.full(n, END)])[order]
    before = np.roll(word, 1)
    before[np.r_[True, doc[1:] != doc[:-1]]] = START
    return doc, word, mix(mix(before) + word)


def _all_tokens(t: pa.Table):
    """Tokens of a group: doc (row), word, history and pair keys, the last three cut to the key size."""
    parts, row = [], 0
    for batch in t.select(["doc_id", "text"]).combine_chunks().to_batches():
        for ids, offsets, data in slices(iter([batch])):
            doc, word, pair = tokens(offsets, data)
            before = np.roll(word, 1)
            before[np.r_[True, doc[1:] != doc[:-1]]] = START
            parts.append((doc + row, word >> _TOP, before >> _TOP, pair >> _TOP))
            row += len(ids)
    if not parts:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their training counts, and each token's place among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, training, len(distinct)).astype(np.int64), place


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d_0 .. d_(CUTOFF + 1): Katz's discounts; 1 where they are not in (0, 1]."""
    d = np.ones(CUTOFF + 2)
    n = counts_of_counts.astype(float)
    if n[0] > 0:
        tail = (CUTOFF + 1) * n[CUTOFF] / n[0]
        for r in range(1, CUTOFF + 1):
            if tail < 1 and n[r - 1] > 0 and n[r] > 0:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


class Model:
    """Probabilities from counts, for the numbers of one training corpus."""

    def __init__(self, stats: np.ndarray):
        words, pairs = stats[: CUTOFF + 3], stats[CUTOFF + 3 :]
        self.n, self.v = int(words[CUTOFF + 1]), int(words[CUTOFF + 2])
        self.d_word, self.d_pair = discounts(words), discounts(pairs)
        lost = sum((1 - self.d_word[r]) * r * words[r - 1] for r in range(1, CUTOFF + 1)) / max(self.n, 1)
        self.unknown = max(lost, 1 / (self.n + 1)) if self.n else 1.0
        self.scale = (1 - self.unknown) / (1 - lost) if self.n else 0.0

    def word(self, count: np.ndarray) -> np.ndarray:
        seen = self.scale * self.d_word[np.minimum(count, CUTOFF + 1)] * count / max(self.n, 1)
        return np.where(count > 0, seen, self.unknown)

    def mass(self, count: np.ndarray) -> np.ndarray:
        """A pair's discounted count."""
        return self.d_pair[np.minimum(count, CUTOFF + 1)] * count

    @staticmethod
    def seen_scale(kept: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What a history's discounted counts are divided by: c(h), or c(h) + 1 where nothing was discounted."""
        return np.where(kept < total * (1 - 1e-9), total, total + 1)

    def kept(self, total: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Sum of a history's discounted counts, from their sum and how many there are of counts 1 to CUTOFF."""
        return total - sum((1 - self.d_pair[r]) * r * pairs[r - 1] for r in range(1, CUTOFF + 1))

    def words(self, seen: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """Sum of P(v) over words, from the sum of their counts and how many there are of counts 1 to CUTOFF."""
        return self.scale / max(self.n, 1) * (seen - sum((1 - self.d_word[r]) * r * words[r - 1] for r in range(1, CUTOFF + 1)))

    @classmethod
    def backoff(cls, kept: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        """a(h) from the discounted counts, the counts, and the sum of P(v), over a history's seen pairs; 1 for an unseen history."""
        left = 1 - kept / np.maximum(cls.seen_scale(kept, total), 1)
        return np.where(total > 0, left / np.maximum(1 - words, 1e-300), 1.0)


def _stats(count: np.ndarray) -> list[int]:
    few = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)
    return [*few[1 : CUTOFF + 2].tolist(), int(count.sum()), int((count > 0).sum())]


def _by_count(place: np.ndarray, count: np.ndarray, n: int) -> list[np.ndarray]:
    """For counts 1 to CUTOFF, how many there are at each place."""
    return [np.bincount(place[count == r], minlength=n) for r in range(1, CUTOFF + 1)]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the probability) of every row, trained on the rows that are not held out."""
    own = gk.grouped(docs)
    ranges = own.ranges
    kinds = 2  # words and pairs share the ranges; a pair's keys follow its group's words

    def prepared(t):
        doc, word, before, pair = _all_tokens(t)
        held = held_out(t.column("doc_id").to_pylist())
        training = ~held[doc]
        return doc, held, training, before, _counted(word, training), _counted(pair, training)

    def sending(key, t):
        _, _, _, _, words, pairs = prepared(t)
        g = key[0].as_py()
        return pa.concat_tables([gk.send(g * kinds + k, keys, ranges, count) for k, (keys, count, _) in enumerate((words, pairs))])

    def counting(key, t):
        """Replies of one range: (total training count, owner) of shared keys; its counts of counts."""
        out, stats = [], []
        for k in range(kinds):
            mine = t.filter(pa.array(t.column("g").to_numpy() % kinds == k))
            if not mine.num_rows:
                stats += _stats(np.zeros(0, np.int64))
                continue
            groups, sizes, keys, (count,) = gk.received(mine, 1)
            count = count.astype(np.int64)
            distinct, which, holders = np.unique(keys, return_inverse=True, return_counts=True)
            total = np.bincount(which, count, len(distinct)).astype(np.int64)
            owner = np.zeros(len(keys), bool)  # the first group that trains on the key
            trained = np.flatnonzero(count > 0)
            owner[trained[np.unique(which[trained], return_index=True)[1]]] = True
            stats += _stats(total)
            out += list(zip(groups.tolist(), gk.reply(groups, sizes, holders[which] > 1, total[which], owner), strict=True))
        rows = [*((g // kinds, g % kinds, x) for g, x in out), (_STATS, _STATS, gk.pack(np.array(stats)))]
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "g": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    def adding(batches):
        """The sums of some ranges' counts of counts."""
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([sum(gk.unpack(x)[0].astype(np.int64) for x in batch.column("blob").to_pylist()).tolist()], pa.list_(pa.int64()))], ["sums"])

    def known(t, replies):
        """Everything a group knows once it has the counts."""
        doc, held, training, before, (words, word_count, word), (pairs, pair_count, pair) = prepared(t)
        rows = list(zip(*(replies.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True))
        owner = pair_count > 0
        for kind, keys, count in ((0, words, word_count), (1, pairs, pair_count)):
            at, (total, own_it) = gk.shared_columns(keys, ranges, {b: x for b, k, x in rows if k == kind}, 2)
            count[at] = total.astype(np.int64)
            if kind:
                owner[at] = own_it.astype(bool)
        first = np.zeros(len(pairs), np.int64)
        first[pair] = np.arange(len(pair))
        # Asked of a history: its backoff weight, and its divisor where no pair here shows that it is discounted.
        count = pair_count[pair]
        own_histories, of = np.unique(before, return_inverse=True)
        shown = np.bincount(of, model.mass(count) < count, len(own_histories)) > 0
        asks = held[doc] & (count == 0) | ~shown[of]
        mine = first[owner]  # a token of each pair that this group reports
        history = np.unique(np.concatenate([before[mine], before[asks]]))
        return doc, held, before, (words, word_count, word), count, mine, asks, history

    def reporting(key, t, replies):
        _, _, before, (_, word_count, word), count, mine, asks, history = known(t, replies)
        place, n = np.searchsorted(history, before[mine]), len(history)
        of_word = word_count[word[mine]]
        sums = [np.bincount(place, c, n).astype(np.int64) for c in (count[mine], of_word)]
        return gk.send(key[0].as_py(), history, ranges, *sums, *_by_count(place, count[mine], n), *_by_count(place, of_word, n), np.isin(history, before[asks]))

    def backing(key, t):
        """Backoff numbers of the histories of one range, to those who ask."""
        groups, sizes, keys, columns = gk.received(t, 3 + 2 * CUTOFF)
        distinct, which = np.unique(keys, return_inverse=True)
        total, seen, *few = (np.bincount(which, c.astype(np.int64), len(distinct)).astype(np.int64) for c in columns[:-1])
        kept = model.kept(total, few[:CUTOFF])
        a = Model.backoff(kept, total, model.words(seen, few[CUTOFF:]))
        blobs = gk.reply(groups, sizes, columns[-1].astype(bool), a.view(np.uint64)[which], Model.seen_scale(kept, total)[which].astype(np.int64))
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(groups), pa.int32()), "g": pa.array(groups, pa.int32()), "kind": pa.array([kinds] * len(groups), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def scoring(key, t, replies):
        first_replies = replies.filter(pa.array(replies.column("kind").to_numpy() < kinds))
        doc, held, before, (words, word_count, word), count, mine, asks, history = known(t, first_replies)
        later = replies.filter(pa.array(replies.column("kind").to_numpy() == kinds))
        at, (weight, divisor) = gk.shared_columns(history, ranges, dict(zip(later.column("bucket").to_pylist(), later.column("blob").to_pylist(), strict=True)), 2)
        c_word, seen = word_count[word], count > 0
        # A word is a history as often as it is a token; the start as often as the end.
        as_word = np.where(before == START >> _TOP, END >> _TOP, before)
        place = np.minimum(np.searchsorted(words, as_word), len(words) - 1)
        below = np.where(words[place] == as_word, word_count[place], 0)
        backoff, told = np.ones(len(history)), np.zeros(len(history), np.int64)
        backoff[at], told[at] = np.ascontiguousarray(weight).view(np.float64), divisor.astype(np.int64)
        ask = np.searchsorted(history, before[asks])
        a = np.ones(len(doc))
        a[asks], below[asks] = backoff[ask], told[ask]
        p = np.where(seen, model.mass(count) / np.maximum(below, 1), a * model.word(c_word))
        n = t.num_rows
        add = lambda x: np.bincount(doc, x, n).astype(float)
        base = np.log10((c_word + 0.1) / (model.n + 0.1 * (model.v + 1)))
        return pa.table({
            "doc_id": t.column("doc_id"), "held_out": pa.array(held), "n_tokens": add(None).astype(np.int64), "n_known": add(c_word > 0).astype(np.int64),
            "train_tokens": np.full(n, model.n), "base_score": add(base), "score": add(np.log10(p)),
        })

    by, replied = "g", "bucket int, g int, kind int, blob binary"
    # Written, since the counts of counts are read before the replies are.
    counts = cut(own.docs.groupBy(by).applyInArrow(sending, gk.SENT).groupBy("bucket").applyInArrow(counting, replied))
    sums = counts.filter(F.col("kind") == _STATS).mapInArrow(adding, "sums array<long>").select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    model, replies = Model(np.array([r.n for r in sums], np.int64) if sums else np.zeros(2 * (CUTOFF + 3), np.int64)), counts.filter(F.col("kind") != _STATS)
    reports = own.docs.groupBy(by).cogroup(replies.groupBy(by)).applyInArrow(reporting, gk.SENT)
    weights = reports.groupBy("bucket").applyInArrow(backing, replied)
    return own.docs.groupBy(by).cogroup(replies.union(weights).groupBy(by)).applyInArrow(scoring, SCORES)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
