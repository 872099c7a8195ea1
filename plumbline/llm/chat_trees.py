"""Chat formatting over reply trees, in DataFrame operations only.

``reply_paths`` turns messages with parent links into root-to-leaf paths: repeated
self-joins double the distance of every message's ancestor link, so a tree of depth
d takes log2(d) joins; leaves are ranked by the score summed along their path, and
the chosen leaves' paths are unfolded through the same links, from far to near.
``format_paths`` writes each path as one conversation and ``read_back`` reverses it.

Cases: a null text, role or conversation is an empty text, an empty role or a
conversation of its own; a parent that does not exist makes its child a root; equal
scores fall to the longer path, then the smaller leaf; messages on a cycle hang from
no root and are in no path; repeated rows are messages of their own; an empty table
gives no rows. Extra columns are ignored. A text of any length is one cell, of its message
and of each conversation that it is in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Control strings of the template and of common others; each is escaped inside texts and roles.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL_RE = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text):
    """Doubles backslashes, then puts one after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL_RE, r"\\")


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(turns: DataFrame) -> DataFrame:
    """Messages of plain turn lists: each turn answers the one before it (ties: by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("msg_id"), "role", "text", F.lit(1.0).alias("score")).withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, path_rank, path_score, depth (0 at the root), role, text of the ``top`` best paths of each conversation."""
    m = cut(
        messages.select(
            F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"), "conv_id", "msg_id", "parent_id",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        )
    )
    nodes = m.select("conv", "msg_id", "parent_id", "score")
    known = nodes.select("conv", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    link = cut(nodes.join(known, ["conv", "parent_id"], "left").select("conv", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("sum")))
    live, ended = link.filter("up is not null"), link.filter("up is null")
    links = [live]
    # A link leads 2**k messages up; n and sum are over the messages passed, the own one included. Ended ones wait.
    most = link.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(links) - 1)) < most and not live.isEmpty():
        far = live.union(ended).select("conv", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("sum").alias("sum2"))
        link = cut(live.join(far, ["conv", "up"]).select("conv", "msg_id", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("sum") + F.col("sum2")).alias("sum")))
        live, ended = link.filter("up is not null"), ended.union(link.filter("up is null"))
        links.append(live)
    parents = links[0].select("conv", F.col("up").alias("msg_id")).distinct()
    best = Window.partitionBy("conv").orderBy(F.desc("sum"), F.desc("n"), "msg_id")
    leaves = ended.join(parents, ["conv", "msg_id"], "left_anti")
    leaves = leaves.withColumn("path_rank", F.row_number().over(best)).filter(F.col("path_rank") <= top)
    path = leaves.select("conv", "path_rank", F.col("sum").alias("path_score"), F.col("n").alias("length"), "msg_id", F.lit(0).cast("long").alias("from_leaf"))
    for k in range(len(links) - 1, -1, -1):
        hop = links[k].select("conv", "msg_id", "up")
        path = path.join(hop, ["conv", "msg_id"], "left")
        path = path.select(
            "conv", "path_rank", "path_score", "length",
            F.explode(F.when(F.col("up").isNull(), F.array(F.struct("msg_id", "from_leaf"))).otherwise(F.array(F.struct("msg_id", "from_leaf"), F.struct(F.col("up").alias("msg_id"), (F.col("from_leaf") + (1 << k)).alias("from_leaf"))))).alias("at"),
        ).select("conv", "path_rank", "path_score", "length", "at.msg_id", "at.from_leaf")
    return path.join(m.drop("score", "parent_id"), ["conv", "msg_id"]).select("conv", "conv_id", "path_rank", "path_score", (F.col("length") - 1 - F.col("from_leaf")).alias("depth"), "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """conv_id, path_rank, path_score, formatted, loss: array of (start, length), in code points of ``formatted``, of the assistant texts."""
    turn = paths.withColumns({"head": F.concat(F.lit("<|im_start|>"), escape(F.col("role")), F.lit("<|im_sep|>")), "body": escape(F.col("text"))}).withColumn("written", F.concat("head", "body", F.lit("<|im_end|>\n")))
    before = Window.partitionBy("conv", "path_rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("start", F.coalesce(F.sum(F.length("written")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turns = turn.groupBy("conv", "path_rank").agg(F.first("conv_id").alias("conv_id"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("depth", "written", span.alias("span")))).alias("turns"))
    return turns.select("conv_id", "path_rank", "path_score", F.array_join(F.col("turns.written"), "").alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text, from the written conversations alone."""
    turn_re = r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n"
    return formatted.select(
        "conv_id", "path_rank", "formatted",
        F.arrays_zip(F.transform(F.regexp_extract_all("formatted", F.lit(turn_re), F.lit(1)), unescape).alias("role"), F.transform(F.regexp_extract_all("formatted", F.lit(turn_re), F.lit(2)), unescape).alias("text")).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "").alias("loss_text"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = read_back(format_paths(reply_paths(linear_tree(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(text, chr(92), chr(92) || chr(92))) + (length(text) - length(replace(text, '<|im_start|>', ''))) // 12
    + (length(text) - length(replace(text, '<|im_sep|>', ''))) // 10 + (length(text) - length(replace(text, '<|im_end|>', ''))) // 10
    + (length(text) - length(replace(text, '<|endoftext|>', ''))) // 13 + (length(text) - length(replace(text, '<s>', ''))) // 3
    + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7
    + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(12 + length(role) + 10 + escaped + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
