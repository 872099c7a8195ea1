"""States of affine recurrences S <- keep S + add over ordered rows, as a scan that is split over tasks.

Steps compose: after (k1, a1) comes (k2, a2) is (k1 k2, a1 k2 + a2). A block of ``BLOCK`` rows is folded from zero, which gives each row's
state and how much of what stood before the block is left in it; the blocks' own (keep, add) are a shorter series of the same kind, scanned the same way, and
what they carry goes back to their rows. So work is linear in the rows, a row of arrays holds ``BLOCK`` steps, and a series of any length is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import observed

BLOCK = 256


def blocks(df: DataFrame, keys: list[str], order: str, columns: list[str], block: int | None = None) -> DataFrame:
    """keys, block (its number), s: array of (order, columns) of at most ``block`` rows each, in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    placed = df.select(*keys, order, *columns).withColumn("block", F.floor(place / (block or BLOCK)))
    return placed.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("s"))


def folded(steps: Column, keep, add) -> Column:
    """An array with, for each step, the state from zero and the part of an earlier state that is left; of at most ``BLOCK`` steps."""
    start = F.struct(F.lit(0.0).alias("state"), F.lit(1.0).alias("left"), F.array().cast("array<struct<state:double,left:double>>").alias("out"))

    def step(acc, x):
        state, left = acc["state"] * keep(x) + add(x), acc["left"] * keep(x)
        return F.struct(state.alias("state"), left.alias("left"), F.array_append(acc["out"], F.struct(state.alias("state"), left.alias("left"))).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def carried(ends: DataFrame, keys: list[str], terms: int, block: int | None = None) -> DataFrame:
    """keys, block, c0, c1, ...: the states before each block, from the blocks' own keep and add (k0, a0, k1, a1, ...); none before the first."""
    after = affine(ends.withColumnRenamed("block", "at"), keys, "at", terms, block)
    return after.select(*keys, (F.col("at") + 1).alias("block"), *(F.col(f"s{i}").alias(f"c{i}") for i in range(terms)))


def affine(df: DataFrame, keys: list[str], order: str, terms: int = 1, block: int | None = None) -> DataFrame:
    """keys, order, s0, s1, ...: the states of ``terms`` recurrences side by side; ``df`` has their keep and add (k0, a0, k1, a1, ...)."""
    named = [f"{x}{i}" for i in range(terms) for x in "ka"]
    field = lambda name: lambda x: x[name]
    inner = [folded(F.col("s"), field(f"k{i}"), field(f"a{i}")).alias(f"f{i}") for i in range(terms)]
    rows, seen = observed(blocks(df, keys, order, named, block).select(*keys, "block", F.col(f"s.{order}").alias(order), *inner), last=F.max("block"))
    if not seen["last"]:
        whole = rows.withColumns({f"c{i}": F.lit(0.0) for i in range(terms)})
    else:
        last = lambda i: F.element_at(f"f{i}", -1)
        ends = rows.select(*keys, "block", *(c for i in range(terms) for c in (last(i)["left"].alias(f"k{i}"), last(i)["state"].alias(f"a{i}"))))
        before = carried(ends, keys, terms, block)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "block"]]
        whole = rows.join(before.withColumnsRenamed({k: f"_{k}" for k in [*keys, "block"]}), same, "left")
    from_ = lambda c: lambda x: x["state"] + x["left"] * F.coalesce(F.col(c), F.lit(0.0))
    states = [F.transform(f"f{i}", from_(f"c{i}")).alias(f"s{i}") for i in range(terms)]
    each = whole.select(*keys, F.explode(F.arrays_zip(F.col(order), *states)).alias("x"))
    return each.select(*keys, f"x.{order}", *(f"x.s{i}" for i in range(terms)))
