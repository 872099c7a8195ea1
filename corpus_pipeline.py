"""The corpus pipeline: documents through quality rules, near-dedup, exact-substring dedup, decontamination and token encoding.

Each stage takes (spark, docs, sf_dir) and returns all that stays, with the columns of
``docs``; the last returns ids. ``run`` applies them in order, each one's result
written to the shared folder and read again as the next one's input.

Rows are told apart by id and text (``row_key``), so each of several texts under one id, or
without an id, is judged by itself, and equal rows alike. A null text is an empty text; an empty
table stays empty; a very long text is one row like any other; other columns, whatever their names, pass through, but
``n_chars``, where there is one, follows the text when a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, fertility, piece_bpe, substring_ranks, weighted_minhash
from plumbline.llm.common import cut, row_key, table

#: Bytes of a repeated string that the substring stage removes: of the passages of 50 words, few are shorter.
REPEAT_BYTES = 250
_KEY = "row key of the pipeline"


def _keyed(docs: DataFrame) -> DataFrame:
    """Text, and language where there is one, under row keys in place of ids."""
    return docs.select(row_key().alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else []))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose keys ``gone`` doesn't list as doc_id."""
    return docs.withColumn(_KEY, row_key()).join(gone.select(F.col("doc_id").alias(_KEY)).distinct(), _KEY, "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the fertility bands reject go."""
    return _without(docs, fertility.judge(_keyed(docs)).filter(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that with the least id (any id before none), then the least row key."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(_KEY))
    stays = weighted_minhash.near_copies(docs).withColumn(_KEY, F.col("row_key")).groupBy("class_key").agg(F.min(order)[_KEY].alias(_KEY)).select(_KEY)
    return docs.withColumn(_KEY, row_key()).join(stays, _KEY, "left_semi").dropDuplicates([_KEY]).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under repeated strings of ``REPEAT_BYTES`` bytes go, and with them characters that they cut in two."""
    kept = substring_ranks.remove_repeats(docs, REPEAT_BYTES, tuple(c for c in docs.columns if c != "text"), whole_characters=True)
    own = {c: F.col(f"carried.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept").cast("string")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("removed") == 0, own["n_chars"]).otherwise(F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(own[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.matches(_keyed(docs), table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to."""
    return piece_bpe.digests(piece_bpe.decode(piece_bpe.encode(docs)))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: Fertility, samples, substrings, edit matching and merges are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
