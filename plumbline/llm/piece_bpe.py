"""SentencePiece encoding and decoding by vectorised merge rounds.

``PieceBpe`` reads a SentencePiece BPE model with identity normalisation and byte
fallback. Texts are cut where no piece can cross (before a blank that follows a
non-blank, and around characters that stand in no longer piece), so equal words are
encoded once. All distinct words of some megabytes go through merge rounds together: symbols lie in one flat
array, each round finds every word's best pair by a segmented minimum over pair ranks,
merges the leftmost occurrences of that pair, and compacts; words without a pair leave.

A round merges several occurrences in a word only as far as the library would: after an
occurrence whose new neighbours could merge at the same or a better rank, the rest of the
word waits for the next round.

Cases: a null text is empty and has no ids; every character outside the vocabulary
becomes its UTF-8 bytes' pieces; control strings such as ``</s>`` in a text are ordinary
text; an empty table gives no rows; extra columns are ignored; repeated rows are each
encoded, whatever their id, which can be null; a very long text is one row, cut into words like any other. Ties, pairs
whose pieces have equal scores, merge from the left, as in the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_parts, texts

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of text encoded together, and distinct words kept from one such part to the next.
PART_BYTES, KEPT_WORDS = 1 << 19, 60_000
_NONE = np.int64(1 << 60)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceBpe:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation")
        self.n = n = len(model.pieces)
        pieces = [p.piece for p in model.pieces]
        kinds = np.array([p.type for p in model.pieces])
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        scores = np.array([p.score for p in model.pieces], np.float32)
        order = np.unique(-scores)
        rank = np.searchsorted(order, -scores).astype(np.int64)
        symbols = dict(normal)  # and characters that are no piece but stand in some
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.k = k = max(symbols.values()) + 2
        pairs = {symbols[p[:i]] * k + symbols[p[i:]]: i_p for p, i_p in normal.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[x] for x in self.keys.tolist()], np.int32)
        self.made_rank = rank[self.made]
        self.first = np.full(0x110000, -1, np.int32)  # a character's symbol
        for s, i in symbols.items():
            if len(s) == 1:
                self.first[ord(s)] = i
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == _BYTE):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        in_longer = {c for p in normal if len(p) > 1 for c in p}
        self.newline_alone = "\n" not in in_longer
        blanks = [len(p) for p in normal if set(p) == {BLANK}]
        if any(BLANK in p[1:] and set(p) != {BLANK} for p in normal) or max(blanks, default=1) != 16:
            raise ValueError("only models whose pieces have blanks at their start, or 16 blanks at most")
        newline = "\\n" if self.newline_alone else ""
        self.cutter = re.compile(f"{BLANK}{{16}}(?={BLANK})|{BLANK}*[^{BLANK}{newline}]+|{BLANK}+" + ("|\\n" if newline else ""))
        surface = [b"" if kinds[i] == _CONTROL else model.trainer_spec.unk_surface.encode() if kinds[i] == _UNKNOWN else bytes([int(p[3:5], 16)]) if kinds[i] == _BYTE else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(s) for s in surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.control, self.is_byte = kinds == _CONTROL, kinds == _BYTE
        self.blank_first = np.array([p.startswith(BLANK) for p in pieces]) & (kinds == _NORMAL)
        self.slots: dict[str, int] = {}
        self.at, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    # -- encoding

    def cut(self, text: str) -> list[str]:
        """Parts of the text with its dummy prefix, between which nothing merges."""
        if self.newline_alone and BLANK not in text:
            parts = text.replace("\n", " \n").split(" ")
            if "" not in parts:
                return [p if p[0] == "\n" else BLANK + p for p in parts]
        return self.cutter.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (or _NONE) and made pieces of symbol pairs."""
        key = a * self.k + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[i] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.made_rank[i], _NONE), self.made[i]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (n + 1) and ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol, word = self.first[chars].astype(np.int64), np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank, made = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int32)
            rank[:-1], made[:-1] = self._look(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[head, len(symbol)])
            least = np.minimum.reduceat(rank, head)
            alive = np.repeat(least < _NONE, size)
            if not alive.all():
                rest = ~alive
                done.append((word[rest], symbol[rest], chars[rest]))
            best = alive & (rank == np.repeat(least, size))
            at = np.flatnonzero(best)
            if len(at):
                new_run = np.r_[True, np.diff(at) > 1]  # of overlapping pairs, the first, third, ...
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                at = at[self._allowed(symbol, word, rank, made, at)]
                symbol = symbol.copy()
                symbol[at] = made[at]
                alive[at + 1] = False
            symbol, word, chars = symbol[alive], word[alive], chars[alive]
        if not done:
            return np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int32)
        word, symbol, chars = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol, chars = word[order], symbol[order], chars[order]
        unknown = np.flatnonzero((symbol < 0) | (symbol >= self.n))
        counts = np.ones(len(symbol), np.int64)
        if len(unknown):
            raw = [chr(c).encode() for c in chars[unknown].tolist()]
            counts[unknown] = [len(x) for x in raw]
            ids = np.repeat(symbol, counts).astype(np.int32)
            at = (np.cumsum(counts) - counts)[unknown]
            ids[ranges(at, counts[unknown])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            ids = symbol.astype(np.int32)
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word, counts, len(words)).astype(np.int64), out=offsets[1:])
        return offsets, ids

    def _allowed(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the pairs at ``at`` may merge in this round: in each word up to the first whose merge makes a pair of the same or a better rank."""
        several = np.zeros(len(at), bool)
        several[1:] |= word[at[1:]] == word[at[:-1]]
        several[:-1] |= several[1:]
        out = np.ones(len(at), bool)
        few = np.flatnonzero(several)
        if not len(few):
            return out
        i, r, own = at[few], rank[at[few]], made[at[few]].astype(np.int64)
        w, last = word[i], len(symbol) - 1
        after = symbol.copy()
        after[at] = made[at]  # what a neighbour is once it has merged
        left, left2, right = np.maximum(i - 1, 0), np.maximum(i - 2, 0), np.minimum(i + 2, last)
        risky = np.zeros(len(few), bool)
        for near, a, b in ((left, symbol[left], own), (left2, after[left2], own), (right, own, symbol[right]), (right, own, after[right])):
            risky |= (word[near] == w) & (near != i) & (self._look(a, b)[0] <= r)
        order = np.arange(len(few))
        first_of_word = np.r_[True, w[1:] != w[:-1]]
        start = np.maximum.accumulate(np.where(first_of_word, order, 0))
        seen = np.cumsum(risky) - risky  # risky ones before
        out[few] = seen == seen[start]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (n + 1) and ids of texts."""
        cuts = [self.cut(t) for t in texts]
        if len(self.slots) > KEPT_WORDS:
            self.slots, self.at, self.pool = {}, np.zeros(1, np.int64), np.zeros(0, np.int32)
        fresh = {w for c in cuts for w in c}.difference(self.slots)
        if fresh:
            new = list(fresh)
            offsets, ids = self.encode_words(new)
            n = len(self.slots)
            self.slots.update(zip(new, range(n, n + len(new)), strict=True))
            self.at, self.pool = np.concatenate([self.at, offsets[1:] + self.at[-1]]), np.concatenate([self.pool, ids])
        words = np.fromiter(map(len, cuts), np.int64, len(cuts))
        slot = np.fromiter((self.slots[w] for c in cuts for w in c), np.int64, words.sum())
        lengths = self.at[slot + 1] - self.at[slot]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ends[np.concatenate([[0], np.cumsum(words)])], self.pool[ranges(self.at[slot], lengths)]

    # -- decoding

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of id lists: pieces' surfaces, blanks as spaces, without the dummy prefix."""
        lengths = self.lengths[ids]
        data = self.surface[ranges(self.starts[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            first = a
            while first < b and self.control[ids[first]]:
                first += 1
            skip = int(first < b and self.blank_first[ids[first]])
            out.append(data[ends[a] + skip : ends[b]].tobytes().decode("utf-8", "replace"))
        return out


@functools.cache
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, ids of every row."""
    path = public_tokenizers.path(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in text_parts(batches, PART_BYTES):
            offsets, ids = model(path).encode(words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, ids, decoded of rows with ids."""
    path = public_tokenizers.path(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                lists = part.column("ids")
                offsets, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model(path).decode(offsets - offsets[0], ids[offsets[0] : offsets[-1]]), pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """n_tokens and digests beside the ids."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decode(encode(table(spark, sf_dir, "documents")))).drop("ids")
