"""Quality rules: base counts of words, symbols and repeats, and bands of tokeniser fertility.

For every whole text: the base counts, and with each of two public vocabularies (pieces with byte
fallback, and byte-level merges for many languages) the characters per token, the share of tokens that are
bytes and no characters, and the entropy of its tokens over the greatest they
could have. Bands per language (or per script where no language is given) come from exact histograms
of these measures over all documents that pass the base: quartiles, widened by ``WIDTH``
interquartile ranges, and at least by the measure's own least distance. Measures of short texts vary more: a document of n tokens
has 1 + ``SHORT`` / n times the distance. A document outside a band of either vocabulary is rejected.

Cases: a null or empty text has no words and fails the base; a null doc_id stays null;
a null language falls to the main script of the text (ties: the first in ``SCRIPTS``), then to "none"; repeated rows
each count; a language with one document keeps it; an empty table gives no rows; a very long text is measured in one
piece, but for runs of over ``RUN`` blanks, which the second vocabulary gets in parts;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, grams, mix, span_hash, table, text_parts, utf8, words_of
from .piece_bpe import MODEL, model

MIN_WORDS, REPEAT_SHARE = 50, 50
WIDTH, SHORT = 3.0, 200
#: Bins a unit of each measure, least distance of a band's edge from its quartile, and which edges reject.
_OF = {"chars_per_token": (100, 0.2, True, True), "byte_share": (1000, 0.1, False, True), "entropy_share": (1000, 0.15, True, False)}
MEASURES = {**_OF, **{f"{m}_multi": x for m, x in _OF.items()}}
SECOND, RUN = "byte_bpe_multi_50k.tiktoken", 1000
#: Groups whose bands are broadcast; beyond it, they are joined by shuffle.
BROADCAST_GROUPS = 10_000
#: Stretches of text without a longer run of blanks than RUN.
_BLANKS = re.compile(rf"\s{{{RUN}}}")
_LONG_RUN = re.compile(rf"(?s)\s{{{RUN}}}|(?:(?!\s{{{RUN}}}).)+")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First code points of coarse scripts; the last row ends the table.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "other"), (0x3040, "cjk"), (0xAC00, "hangul"), (0xD7B0, "other")]


def base_counts(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    w = words_of(offsets, data)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    add = lambda doc, weights=None: np.bincount(doc, weights, n).astype(np.int64)
    # Lines that have a word: from one line break or document start to the next.
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    broken = data[ends - 1] == 10
    ends = ends - broken
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    line = mix(span_hash(w.prefix, starts, ends) + mix(line_doc.astype(np.uint64)))
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    gram, at = grams(w.hash, w.doc, 3)
    _, which, count = np.unique(mix(gram + mix(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    repeated = np.zeros(len(w.doc), bool)
    for k in range(3):
        repeated[at + k] = True
    return {"n_words": add(w.doc), "word_chars": add(w.doc, chars[w.end] - chars[w.start]), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": add(line_doc[again]), "n_repeat_words": add(w.doc[repeated]), "n_chars": chars[offsets[1:]] - chars[offsets[:-1]]}


def token_measures(offsets: np.ndarray, ids: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy in bits of each document."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    value, count = np.unique((doc << 32) + ids, return_counts=True)
    of = value >> 32
    p = count / n[of]
    return n, np.bincount(doc, is_byte[ids], len(n)), np.bincount(of, -p * np.log2(p), len(n))


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = np.searchsorted([s for s, _ in SCRIPTS], points, "right") - 1
    found = found[(found > 0) | (found == 0) & ((points >= 0x61) & (points <= 0x7A) | (points <= 0x5A) | (points >= 0xC0))]
    return SCRIPTS[int(np.bincount(found).argmax())][1] if len(found) else "none"


class ByteMerges:
    """A byte-level vocabulary of ranks; ``is_byte``: tokens that are no whole characters."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.n = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(self.n, bool)
        for token, i in ranks.items():
            self.is_byte[i] = not token.decode("utf-8", "ignore")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (n + 1) and ids."""
        of = self.encoding.encode_to_numpy
        ids = [np.concatenate([of(x, disallowed_special=()) for x in parts]) if _BLANKS.search(t) and (parts := _LONG_RUN.findall(t)) else of(t, disallowed_special=()) for t in texts]
        return np.cumsum([0, *map(len, ids)]), np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)


@functools.cache
def byte_merges(path: str) -> ByteMerges:
    return ByteMerges(path)


def measures(docs: DataFrame, name: str = MODEL, second: str = SECOND) -> DataFrame:
    """doc_id, band_group, base counts and fertility of every row."""
    path, path_2 = public_tokenizers.path(name), public_tokenizers.path(second)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars"]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = model(path), byte_merges(path_2)
        for part, words in text_parts(batches):
            offsets, data = utf8(part.column("text"))
            base, n_tokens, found = base_counts(offsets - offsets[0], data[offsets[0] : offsets[-1]]), None, []
            for v in vocabularies:
                n, n_bytes, entropy = token_measures(*v.encode(words), v.is_byte)
                n_tokens, many = n if n_tokens is None else n_tokens, np.maximum(n, 1)
                found += [base["n_chars"] / many, n_bytes / many, entropy / np.log2(np.minimum(np.maximum(n, 2), v.n))]
            group = [g if g is not None else "script:" + script_of(t) for g, t in zip(part.column("lang").to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(group, pa.string()), *(pa.array(base[c]) for c in counts), pa.array(n_tokens.astype(np.int64)), *map(pa.array, found)], ["doc_id", "band_group", *counts, "n_tokens", *MEASURES])

    schema = ", ".join(["doc_id long", "band_group string", *(f"{c} long" for c in counts), "n_tokens long", *(f"{m} double" for m in MEASURES)])
    return own.mapInArrow(run, schema)


def bands(measured: DataFrame) -> DataFrame:
    """band_group and, for each measure, its quartiles and how far beyond them a value may lie."""
    by = Window.partitionBy("band_group", "measure").orderBy("bin")
    long = measured.select("band_group", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * bins).alias("bin")) for m, (bins, *_) in MEASURES.items()))).alias("x")).select("band_group", "x.measure", "x.bin")
    counted = long.groupBy("band_group", "measure", "bin").agg(F.count("*").alias("n"))
    run = counted.withColumns({"upto": F.sum("n").over(by), "all": F.sum("n").over(Window.partitionBy("band_group", "measure"))})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    quartiles = run.groupBy("band_group", "measure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    edges = []
    for m, (bins, least, _, _) in MEASURES.items():
        q1, q3 = F.col("q1") / bins, (F.col("q3") + 1) / bins
        own = lambda c: F.max(F.when(F.col("measure") == m, c))  # noqa: E731, B023
        edges += [own(q1).alias(f"{m}_q1"), own(q3).alias(f"{m}_q3"), own(F.greatest(WIDTH * (q3 - q1), F.lit(least))).alias(f"{m}_apart")]
    return quartiles.groupBy("band_group").agg(*edges)


def judge(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """All measures of every row, base_failed, out_of_band (measures outside their band) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    measured = cut(measures(docs, name).withColumn("base_failed", failed))
    edges = cut(bands(measured.filter(~F.col("base_failed"))))
    if edges.count() <= BROADCAST_GROUPS:
        edges = F.broadcast(edges)
    both = measured.join(edges, "band_group", "left")
    far = 1 + SHORT / F.greatest("n_tokens", F.lit(1))
    below = {m: F.col(m) < F.col(f"{m}_q1") - F.col(f"{m}_apart") * far for m, (_, _, low, _) in MEASURES.items() if low}
    above = {m: F.col(m) > F.col(f"{m}_q3") + F.col(f"{m}_apart") * far for m, (_, _, _, high) in MEASURES.items() if high}
    outside = F.filter(F.array(*(F.when(below.get(m, F.lit(False)) | above.get(m, F.lit(False)), F.lit(m)) for m in MEASURES)), lambda x: x.isNotNull())
    both = both.withColumn("out_of_band", outside)
    return both.select(*measured.columns, "out_of_band", (~F.col("base_failed") & (F.size("out_of_band") == 0)).alias("kept"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *MEASURES, "out_of_band")
