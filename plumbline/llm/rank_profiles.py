"""Language identification by rank-order profiles: a text's most frequent n-grams against each language's, by out-of-place distance.

Texts are lower-cased character by character and cut into runs of letters; n-grams of one to three characters are taken of each
run with a blank at either end (no blank alone). A language's profile is its ``PROFILE`` most frequent n-grams over all
training texts, and a text's own are the same of the text alone; equally frequent ones stand by their characters. An n-gram of the text is out of
place by the difference of its two ranks, and by ``PROFILE`` where the language does not have it. The language with the least
sum is the answer (ties: the first by name), and the score is one less that sum's share of the greatest possible.

Training counts are summed in slices, by Spark's partial sums and then per n-gram, whatever share of the rows a language has; the profiles
are at most ``PROFILE`` rows for each of at most ``MOST_LANGUAGES`` labels (codes, checked by a count; more raise) and
go with the tasks that score.

Cases: a text that is null, or has no letter, is ``und`` with score 0, as is every text where no training row has a language; a null
lang is never learned from, and an empty one is a value like others; a null doc_id is hashed as an empty string; repeated rows count each; very long texts are whole, in a slice of
their own; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, cut, table, text_parts

PROFILE, FOLDS = 400, 5
MOST_LANGUAGES = 2000
#: An n-gram is three code points of 21 bits, the later ones 0 where it is shorter.
_BITS, _BLANK = 21, 0x20


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower case (itself, where that is not one letter)."""
    points = [chr(i) for i in range(0x110000)]
    lower = (x.lower() for x in points)
    return np.fromiter((x.isalpha() for x in points), bool, 0x110000), np.fromiter((ord(y) if len(y) == 1 else ord(x) for x, y in zip(points, lower, strict=True)), np.uint32, 0x110000)


def ngrams(texts: list[str], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, n-gram, how often it stands there) in the order of texts and n-grams; of groups of texts, where ``group`` numbers them."""
    is_letter, lower = _letters()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.flatnonzero(is_letter[points])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = doc[at]
    first = np.r_[True, (np.diff(at) > 1) | (np.diff(doc) > 0)]
    # Runs of letters with a blank before each and one at the end; letters by their place in the slice's alphabet, so that keys are small.
    letters = lower[points[at]]
    number = np.zeros(0x110000, np.int32)
    number[letters] = 1
    alphabet = np.flatnonzero(number)
    number[alphabet] = np.arange(2, len(alphabet) + 2)
    alphabet = np.r_[0, _BLANK, alphabet]
    doc = doc if group is None else group[doc]
    place = np.arange(len(at)) + np.cumsum(first)
    run, owner = np.ones(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
    run[place], owner[place] = number[letters], doc
    owner[place[first] - 1] = doc[first]
    m, letter = len(alphabet), run > 1
    one = (run * m * m + owner * m**3)[letter]
    two = ((run[:-1] * m + run[1:]) * m + owner[:-1] * m**3)[:-1]
    three = ((run[:-2] * m + run[1:-1]) * m + run[2:] + owner[:-2] * m**3)[letter[1:-1]]
    last = (run[-2] * m + 1) * m + owner[-2] * m**3  # the last letter and the blank at the end
    key, n = np.unique(np.concatenate([one, two, [last], three]), return_counts=True)
    key, own = key % m**3, key // m**3
    return own, (alphabet[key // (m * m)] << 2 * _BITS) | (alphabet[key // m % m] << _BITS) | alphabet[key % m], n


def gram_text(gram: int) -> str:
    """The characters of an n-gram."""
    return "".join(chr(c) for c in (gram >> 2 * _BITS, gram >> _BITS & ((1 << _BITS) - 1), gram & ((1 << _BITS) - 1)) if c)


def _held_out(docs: DataFrame):
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % FOLDS == 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches):
            coded = part.column("lang").dictionary_encode()
            lang, gram, n = ngrams(texts, coded.indices.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(lang)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0) of the most frequent n-grams of each language."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    return gram_counts(known).withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """The ranks of all languages' n-grams as one table of the n-grams."""

    def __init__(self, rows: list, size: int):
        self.size, self.langs = size, sorted({r.lang for r in rows})
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), size, np.int64)  # the last row is of n-grams that no language has
        self.has = np.zeros(self.ranks.shape, bool)
        at = np.searchsorted(self.grams, [r.gram for r in rows]), [self.langs.index(r.lang) for r in rows]
        self.ranks[at], self.has[at] = [r.rank for r in rows], True

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's out-of-place distance to every language, and how many n-grams were ranked."""
        own, gram, n = ngrams(texts)
        far = np.zeros((len(texts), len(self.langs)), np.int64)
        if not len(own):
            return far, np.zeros(len(texts), np.int64)
        order = np.argsort(own * (n.max() + 1) + (n.max() - n), kind="stable")
        own, gram = own[order], gram[order]
        starts = np.searchsorted(own, np.arange(len(texts)))
        rank = np.arange(len(own)) - starts[own]
        top = rank < self.size
        own, gram, rank = own[top], gram[top], rank[top]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        apart = np.where(self.has[at], np.abs(self.ranks[at] - rank[:, None]), self.size)
        ranked = np.bincount(own, minlength=len(texts))
        some = np.flatnonzero(ranked)
        far[some] = np.add.reduceat(apart, np.searchsorted(own, some), axis=0)
        return far, ranked


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    found = cut(profiles(docs.filter(~_held_out(docs)), size))
    if found.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    known = Profiles(found.collect(), size)  # MOST_LANGUAGES x size rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches):
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if known.langs:
                far, ranked = known.distances(texts)
                best, any_letter = far.argmin(axis=1), ranked > 0
                lang = [known.langs[b] if a else "und" for b, a in zip(best.tolist(), any_letter.tolist(), strict=True)]
                score = np.where(any_letter, 1 - far.min(axis=1) / (known.size * np.maximum(ranked, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", _held_out(docs).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op11_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: The same by counting n-grams as strings, whose order is that of their code points.
ORACLE = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(text) AS text, lang, {crc32_sql("doc_id::VARCHAR")} % {FOLDS} = 0 AS held_out FROM documents),
runs AS (SELECT r, ' ' || run || ' ' AS run, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS run FROM docs) GROUP BY 1, 2),
pieces AS (SELECT r, n, run, k, unnest(range(1, length(run) - k + 2)) AS i FROM runs, (VALUES (1), (2), (3)) t(k) WHERE length(run) >= k),
grams AS MATERIALIZED (SELECT r, substring(run, i, k) AS gram, sum(n) AS n FROM pieces WHERE substring(run, i, k) <> ' ' GROUP BY 1, 2),
counted AS (SELECT lang, gram, sum(n) AS n FROM grams JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
profiles AS MATERIALIZED (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank FROM counted QUALIFY rank < {PROFILE}),
own AS MATERIALIZED (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS rank FROM grams QUALIFY rank < {PROFILE}),
ranked AS (SELECT r, count(*) AS n FROM own GROUP BY 1),
near AS (SELECT r, lang, sum({PROFILE} - abs(p.rank - o.rank)) AS near FROM own o JOIN profiles p USING (gram) GROUP BY 1, 2),
apart AS (SELECT r, lang, {PROFILE} * n - coalesce(near, 0) AS far, {PROFILE} * n AS most FROM ranked CROSS JOIN (SELECT DISTINCT lang FROM profiles) LEFT JOIN near USING (r, lang)),
best AS (SELECT r, lang, far, most FROM apart QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, CASE WHEN b.r IS NULL THEN 0.0::DOUBLE ELSE 1 - far::DOUBLE / most::DOUBLE END AS score FROM docs LEFT JOIN best b USING (r)"""
