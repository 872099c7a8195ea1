"""Exact percentiles over sums of two sets: what every pairing of two ensembles gives, without forming a pair.

A row holds two arrays and stands for all sums of a value of either. How many of its sums are at most x takes a binary search in one sorted
array for each value of the other, so the rank of any x in a group is a sum over the group's rows. Each pass splits the intervals that hold the wanted
ranks into ``BINS`` and counts at their edges: tasks add up the counts of their rows, Spark those of the tasks. An interval with ``FEW`` sums or less is
listed at last; one that has shrunk to a single number is that number, however many sums equal it. The first pass
splits by value and the later ones by the numbers there are, so there are nine at most. What is shuffled is ``BINS`` counts for each group, wanted rank and task.

Rows whose arrays are linear in coefficients need not be tables either: ``Linear`` holds the coefficients once and the points that they are taken
at, and each pass forms the arrays in its tasks, so what is written grows with the coefficients and not with coefficients times points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import observed, stored
from .summary import PERCENTILES

BINS, FEW = 256, 4096
#: Rows of a stored file, so that the passes have tasks enough.
ROWS = 64
#: Pairs of a value and an edge that are searched at once, numbers of the groups that a task adds up at once, and groups whose state is broadcast.
SEARCH, HELD, BROADCAST = 1 << 21, 1 << 23, 10_000
#: Points that a row of coefficients is taken at, at once, and groups whose edges a task keeps.
POINTS, KEPT = 512, 512
_LEAST = np.iinfo(np.int64).min


def _numbered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, neighbours next to each other."""
    i = np.asarray(x, np.float64).view(np.int64)
    return np.where(i >= 0, i, _LEAST - i)


def _edges(lo: np.ndarray, hi: np.ndarray, by_value: bool) -> np.ndarray:
    """``BINS`` ascending edges in (lo, hi], the last of them hi, for each interval."""
    part = np.arange(1, BINS + 1, dtype=np.uint64)
    if by_value:
        out = np.maximum(np.minimum(lo[:, None] + (hi - lo)[:, None] * (part / BINS), hi[:, None]), lo[:, None])
    else:
        start = _numbered(lo).view(np.uint64)
        apart = _numbered(hi).view(np.uint64) - start
        whole, rest = np.divmod(apart, np.uint64(BINS))
        i = (start[:, None] + whole[:, None] * part + rest[:, None] * part // np.uint64(BINS)).view(np.int64)
        out = np.where(i >= 0, i, _LEAST - i).view(np.float64)
    out[:, -1] = hi
    return out


def _places(a: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each a and x, how many of the sorted c have a + c <= x, as the sums are rounded."""
    at = np.searchsorted(c, x[None, :] - a[:, None], "right")
    n = len(c)
    while True:  # x - a is rounded, too: a step or two to where the sums themselves cross x
        up = (at < n) & (a[:, None] + c[np.minimum(at, n - 1)] <= x)
        down = ~up & (at > 0) & (a[:, None] + c[np.maximum(at - 1, 0)] > x)
        if not (up.any() or down.any()):
            return at
        at = at + up - down


def _sides(a: np.ndarray, c: np.ndarray, edges: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shorter side in parts, and the longer one sorted."""
    a, c = (a, np.sort(c)) if len(a) <= len(c) else (c, np.sort(a))
    step = max(1, SEARCH // max(1, edges))
    for i in range(0, len(a), step):
        yield a[i : i + step], c


def counts_upto(a: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many sums of a and c are at most each x."""
    return sum((_places(part, long, x).sum(axis=0) for part, long in _sides(a, c, len(x))), np.zeros(len(x), np.int64))


def listed_each(a: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """The sums in each (lo, hi]; the longer side is sorted once for all of them."""
    out = [[np.zeros(0)] for _ in lo]
    for part, long in _sides(a, c, 2 * len(lo)):
        places = _places(part, long, np.concatenate([lo, hi]))
        for i, found in enumerate(out):
            first = places[:, i]
            n = places[:, len(lo) + i] - first
            own = np.repeat(np.arange(len(part)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(part[own] + long[first[own] + within])
    return [np.concatenate(found) for found in out]


def listed(a: np.ndarray, c: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The sums in (lo, hi]."""
    return listed_each(a, c, np.array([lo]), np.array([hi]))[0]


@dataclass(frozen=True)
class Linear:
    """Rows of two arrays that are linear in coefficients, without the arrays.

    ``sides`` has ``at``, and arrays of structs ``obs`` (target and coefficients) and ``ctl`` (coefficients): of each ``at``, all pairs of its blocks. Every point is
    one row for each of those, whose arrays hold sum(x * coefficient) over its ``terms`` (name, x), or with ``measured`` (a map of targets to
    numbers) what is left of the targets' numbers, and minus that sum of ``ctl``. A coefficient may be an array, and x is one as long then.
    """

    points: DataFrame  # at, terms, measured, and columns of its own
    sides: DataFrame
    at: list[str]

    def over(self, change: Callable[[DataFrame], DataFrame]) -> Linear:
        """With other points or further columns; terms and measured are kept."""
        return replace(self, points=change(self.points))


def grouped(sums: Linear, columns: list[str], points: DataFrame | None = None, most: int = 0) -> DataFrame:
    """at, points: arrays of the columns and what forms the sums, of ``most`` points of one ``at``."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // POINTS) or 1))
    held = (sums.points if points is None else points).withColumn("_part", part)
    return held.groupBy(*sums.at, "_part").agg(F.collect_list(F.struct(*columns, "terms", "measured")).alias("points")).drop("_part")


def _facing(sums: Linear, columns: list[str], size, points: DataFrame | None = None) -> DataFrame:
    """points, obs, ctl: each row of the sides with its points."""
    own = grouped(sums, columns, points, size.most or 0)
    return sums.sides.join(F.broadcast(own) if (size.all or 0) <= BROADCAST else own, sums.at).select("points", "obs", "ctl")


def _combined(side: dict[str, np.ndarray], terms: list[dict]) -> np.ndarray:
    out, part = None, None
    for term in terms:
        own, x = side[term["name"]], term["x"]
        # Added up in order, not by a matrix product, so that each pass forms the very same numbers.
        for row, factor in zip(own, x or [None] * len(own), strict=True) if own.ndim == 2 else ((own, x),):
            factor = np.nan if factor is None else factor
            if out is None:
                out, part = row * factor, np.empty(len(row))
            else:
                out += np.multiply(row, factor, out=part)
    return out


def _numbers(x: pa.Array) -> np.ndarray:
    """Numbers, or of arrays of them, which are equally long, a row for each place."""
    if not pa.types.is_list(x.type):
        return x.to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T) if len(x) else np.zeros((0, 0))


def _lacks(x) -> bool:
    return x is None or isinstance(x, list) and any(v is None for v in x)


def _coefficients(side: pa.Array, i: int) -> dict[str, pa.Array]:
    start, end = side.offsets[i].as_py(), side.offsets[i + 1].as_py()
    return {f.name: side.values.field(j).slice(start, end - start) for j, f in enumerate(side.type.value_type)}


def _formed(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, bool]]:
    """The point, its two arrays and whether a number in them is missing, of every point of every row."""
    for i, points in enumerate(batch.column("points").to_pylist()):
        obs, ctl = (_coefficients(batch.column(c), i) for c in ("obs", "ctl"))
        targets = obs.pop("target").to_pylist()
        gone = {k for side in (obs, ctl) for k, x in side.items() if x.null_count}
        obs, ctl = ({k: _numbers(x) for k, x in side.items()} for side in (obs, ctl))
        if not all(len(x) for side in (obs, ctl) for x in side.values()):
            continue
        for p in points:
            a, c = _combined(obs, p["terms"]), _combined(ctl, p["terms"])
            if p["measured"] is not None:
                of = dict(p["measured"])
                has = np.array([t in of for t in targets], bool)
                a, c = np.array([of[t] for t in targets if t in of], float) - a[has], -c
            if len(a) and len(c):
                yield p, a, c, any(_lacks(t["x"]) or t["name"] in gone for t in p["terms"])


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


_BOUNDS = {"n": "long", "lo": "double", "hi": "double", "total": "double", "missing": "boolean", "nan": "boolean"}


def bounds(faced: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """keys (``kinds`` has their types), n, lo, hi, total, missing, nan: number, bounds and sum of all sums of each key's points, and whether any is missing or NaN; of rows with points, obs and ctl."""
    keys = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list] = {}
            for p, a, c, missing in _formed(batch):
                nan = bool(np.isnan(a).any() or np.isnan(c).any())
                new = [len(a) * len(c), a.min() + c.min(), a.max() + c.max(), a.sum() * len(c) + c.sum() * len(a), missing, nan and not missing]
                key = tuple(p[k] for k in keys)
                old = held.setdefault(key, new)
                if old is not new:
                    held[key] = [old[0] + new[0], min(old[1], new[1]), max(old[2], new[2]), old[3] + new[3], old[4] or new[4], old[5] or new[5]]
            types = [*({f.name: f.type for f in batch.column("points").type.value_type}[k] for k in keys), pa.int64(), *[pa.float64()] * 3, *[pa.bool_()] * 2]
            columns = zip(*((*k, *v) for k, v in held.items()), strict=True) if held else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [*keys, *_BOUNDS])

    parts = faced.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in {**kinds, **_BOUNDS}.items()))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.max("missing").alias("missing"), F.max("nan").alias("nan"))


def _sized(sums: Linear):
    """most, all: points of one ``at``, and of all."""
    return sums.points.groupBy(*sums.at).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()


_STATE = {"ranks": "array<long>", "lo": "array<double>", "hi": "array<double>", "below": "array<long>", "inside": "array<long>", "done": "array<boolean>"}


def _typed(df: DataFrame, names: list[str]) -> str:
    kinds = _kinds(df)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str], groups: int) -> DataFrame:
    named = state.select(*(F.col(k).alias(f"_{k}") for k in keys), *_STATE)
    named = F.broadcast(named) if groups <= BROADCAST else named
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def _added(rows: DataFrame | Linear, state: DataFrame, keys: list[str], of, kind: str, groups: int, size=None) -> DataFrame:
    """keys, state and ``found``: for each group of a task, the concatenation or sum over its rows of ``of(a, c, state)``."""
    named, linear = [*keys, *_STATE], isinstance(rows, Linear)
    if linear:
        kinds = {**_kinds(rows.points), **_STATE}
        both = _facing(rows, named, size, _with_state(rows.points, state, keys, groups))
    else:
        kinds = {**_kinds(rows), **_STATE}
        both = _with_state(rows, state, keys, groups).select(*named, "a", "c")

    def each(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        if linear:
            for p, a, c, _ in _formed(batch):
                yield tuple(p[n] for n in named), a, c
            return
        heads = zip(*(batch.column(n).to_pylist() for n in named), strict=True)
        for i, head in enumerate(heads):
            yield head, batch.column("a")[i].values.to_numpy(), batch.column("c")[i].values.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def write() -> pa.RecordBatch:
            columns = [pa.array([own[0][i] for own in held.values()], types[n]) for i, n in enumerate(named)]
            found = pa.array([(own[1] if kind == "long" else np.concatenate(own[1])).tolist() for own in held.values()], pa.list_(pa.float64() if kind == "double" else pa.int64()))
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, found], [*named, "found"])

        numbers = 0
        for batch in batches:
            types = {f.name: f.type for f in (batch.column("points").type.value_type if linear else batch.schema)}
            for head, a, c in each(batch):
                key = head[: len(keys)]
                own = of(a, c, *(np.array(x) for x in head[len(keys) :]))
                if key not in held:
                    held[key] = [head, own if kind == "long" else [own]]
                    numbers += len(own)
                elif kind == "long":
                    held[key][1] = held[key][1] + own
                else:
                    held[key][1].append(own)
                    numbers += len(own)
                if numbers >= HELD:
                    yield write()
                    numbers = 0
        if held:
            yield write()

    return both.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in named), f"found array<{kind}>"]))


def _narrowed(parts: DataFrame, keys: list[str], by_value: bool) -> DataFrame:
    """The state after a pass: each interval becomes the bin of its rank."""

    def run(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        ranks, lo, hi, below, inside, done = (np.array(first[c]) for c in _STATE)
        upto = sum(x.values.to_numpy() for x in group.column("found")).reshape(-1, BINS)
        edges = _edges(lo[~done], hi[~done], by_value)
        at = (upto > ranks[~done][:, None]).argmax(axis=1)
        row = np.arange(len(at))
        before = np.where(at > 0, upto[row, at - 1], below[~done])
        lo[~done], hi[~done] = np.where(at > 0, edges[row, at - 1], lo[~done]), edges[row, at]
        below[~done], inside[~done] = before, upto[row, at] - before
        done = (inside <= FEW) | (np.nextafter(lo, np.inf) >= hi)
        out = {**{k: [first[k]] for k in keys}, **dict(zip(_STATE, ([x.tolist()] for x in (ranks, lo, hi, below, inside, done)), strict=True))}
        return pa.table(out, schema=pa.schema([group.schema.field(c) for c in [*keys, *_STATE]]))

    return parts.groupBy(*keys).applyInArrow(run, _typed(parts, [*keys, *_STATE]))


def _values(rows: DataFrame | Linear, state: DataFrame, keys: list[str], groups: int, size=None) -> DataFrame:
    """keys, ranks, found: the values of the ranks."""

    def list_(a, c, ranks, lo, hi, below, inside, done):
        # A list of pairs (rank's place, value) as one array, so that tasks' lists can stand behind one another.
        wide = np.flatnonzero(np.nextafter(lo, np.inf) < hi)
        each = zip(wide.tolist(), listed_each(a, c, lo[wide], hi[wide]) if len(wide) else [], strict=True)
        return np.concatenate([np.zeros(0), *(np.column_stack([np.full(len(v), i), v]).ravel() for i, v in each)])

    def run(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        pairs = np.concatenate([x.values.to_numpy() for x in group.column("found")]).reshape(-1, 2)
        values = []
        for i, (rank, hi, below) in enumerate(zip(first["ranks"], first["hi"], first["below"], strict=True)):
            own = pairs[pairs[:, 0] == i, 1]
            values.append(float(np.partition(own, rank - below)[rank - below]) if len(own) else hi)
        return pa.table({**{k: [first[k]] for k in keys}, "ranks": [first["ranks"]], "found": [values]}, schema=pa.schema([*(group.schema.field(c) for c in [*keys, "ranks", "found"])]))

    parts = _added(rows, state, keys, list_, "double", groups, size)
    return parts.groupBy(*keys).applyInArrow(run, _typed(parts, [*keys, "ranks", "found"]))


def percentiles(sums: DataFrame | Linear, keys: list[str], qs: list[float] = PERCENTILES, size: str | None = None) -> DataFrame:
    """keys, percentile, value over all sums of ``a`` and ``c`` (arrays of doubles) of each key's rows: interpolated; NaN if any value is NaN, null if any is missing. As ``summary.percentiles``.

    ``size``: a further column with the number of the key's sums.
    """
    if isinstance(sums, Linear):
        whole, sized = sums, _sized(sums)
        known = bounds(_facing(sums, keys, sized), {k: _kinds(sums.points)[k] for k in keys}).drop("total")
    else:
        whole, sized = stored(sums.filter((F.size("a") > 0) & (F.size("c") > 0)).select(*keys, "a", "c"), ROWS), None
        missing = lambda x: F.exists(x, lambda v: v.isNull())
        nan = F.isnan(F.array_max("a")) | F.isnan(F.array_max("c"))  # NaN orders last
        known = whole.groupBy(*keys).agg(
            F.sum(F.size("a").cast("long") * F.size("c")).alias("n"), F.min(F.array_min("a") + F.array_min("c")).alias("lo"), F.max(F.array_max("a") + F.array_max("c")).alias("hi"),
            F.max(missing("a") | missing("c")).alias("missing"), F.max(F.coalesce(nan, F.lit(False))).alias("nan"))
    bounded, seen = observed(known, odd=F.count_if(F.col("missing") | F.col("nan")))
    odd = F.col("missing") | F.col("nan")
    at = {q: (F.col("n") - 1) * (q / 100) for q in qs}
    ranks = F.array_sort(F.array_distinct(F.array(*(f(p).cast("long") for p in at.values() for f in (F.floor, F.ceil)))))
    alike = lambda x: F.transform("ranks", lambda _: x)
    spread = F.abs("lo") + F.abs("hi")
    start = bounded.filter(~odd).withColumn("ranks", ranks).select(
        *keys, "ranks", alike(F.col("lo") - spread * 1e-15 - F.lit(1e-300)).alias("lo"), alike(F.col("hi")).alias("hi"), alike(F.lit(0).cast("long")).alias("below"), alike(F.col("n")).alias("inside"), alike(F.col("n") <= FEW).alias("done"))
    is_open = F.exists("done", lambda d: ~d)
    counted = {"groups": F.count("*"), "open": F.count_if(is_open)}
    (state, now), sound = observed(start, **counted), whole
    if seen["odd"] and sized is None:
        sound = whole.join(F.broadcast(bounded.filter(~odd).select(*(F.col(k).alias(f"_{k}") for k in keys))), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
    by_value = True
    while now["open"]:
        known_edges: dict[tuple, tuple] = {}

        def count(a, c, ranks, lo, hi, below, inside, done, by_value=by_value, known_edges=known_edges):
            key = (lo.tobytes(), hi.tobytes(), done.tobytes())
            if key not in known_edges:  # once for all rows of a group
                if len(known_edges) >= KEPT:
                    known_edges.clear()
                edges, of = np.unique(_edges(lo[~done], hi[~done], by_value), return_inverse=True)
                known_edges[key] = edges, of.ravel()
            edges, of = known_edges[key]
            return counts_upto(a, c, edges)[of]

        narrowed = _narrowed(_added(sound, state.filter(is_open), keys, count, "long", now["open"], sized), keys, by_value)
        (state, now), by_value = observed(narrowed.unionByName(state.filter(~is_open)), **counted), False
    value_of = _values(sound, state, keys, now["groups"], sized).select(*(F.col(k).alias(f"_{k}") for k in keys), F.map_from_arrays("ranks", "found").alias("of"))
    both = bounded.filter(~odd).join(value_of, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    value = lambda p: F.col("of")[F.floor(p).cast("long")] + (F.col("of")[F.ceil(p).cast("long")] - F.col("of")[F.floor(p).cast("long")]) * (p - F.floor(p))
    more = [F.col("n").alias(size)] if size else []
    found = both.select(*keys, *more, F.explode(F.array(*(F.struct(F.lit(float(q)).alias("percentile"), value(p).alias("value")) for q, p in at.items()))).alias("x")).select(*keys, "x.percentile", "x.value", *([size] if size else []))
    nothing = F.when(F.col("missing"), F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    return found.union(bounded.filter(odd).select(*keys, F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("percentile"), nothing.alias("value"), *more))
