"""Sequential decisions along a key's sorted intervals, spread over blocks.

Which intervals are kept where they overlap, and which files begin a chunk, depends on the decision before: a fold. It is
split like this. Rows are ranged by key and time; a range's rows of a key are a block. Each block says, without
knowing what came before, what it would hand on for whatever is handed to it (a step function of one number, with
few steps where the past is soon forgotten). One walk over these functions, block by block, gives what is really handed to
each block; then all blocks are decided at once. No block holds more than its range, and the walk reads steps, not rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import placed, written

#: What a block hands on where nothing in it matters.
SAME = None
#: Stands for an end that is null: before all others.
NO_END = -(2**63)


class Steps:
    """A step function on [0, size), of values or ``SAME``; a stretch is set at a time."""

    def __init__(self, size: int):
        self.size, self.at, self.value = size, [0], [SAME]

    def __getitem__(self, x: int):
        return self.value[bisect_right(self.at, x) - 1]

    def put(self, low: int, high: int, value) -> None:
        """Sets [low, high); where ``high`` lies beyond the end, the rest is set from 0 on."""
        if high - low >= self.size:
            self.at, self.value = [0], [value]
            return
        low, high = low % self.size, low % self.size + high - low
        if high > self.size:
            self.put(0, high - self.size, value)
            high = self.size
        if low >= high:
            return
        after = self[high] if high < self.size else None
        a, b = bisect_left(self.at, low), bisect_right(self.at, high)
        ends = [high] if high < self.size and (b == a or self.at[b - 1] != high) else []
        if high < self.size and not ends:
            b -= 1
        self.at[a:b], self.value[a:b] = [low, *ends], [value, *([after] if ends else [])]


def _blocks(batches):
    """(border row, begins, ends, ids) of each block; its border row comes before its rows."""
    border, held = None, []
    whole = lambda: (np.concatenate([np.empty(0, dtype=np.int64), *(h[k] for h in held)]) for k in range(3))
    for batch in batches:
        starts = np.flatnonzero(batch.column("kind").to_numpy(zero_copy_only=False) == 0).tolist()
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin_us", "end_us", "id")]
        begun = set(starts)
        for a, b in pairwise([0, *starts, batch.num_rows]):
            if a == b:
                continue
            if a in begun:
                if border is not None:
                    yield border, *whole()
                border, held = {c: batch.column(c)[a].as_py() for c in batch.schema.names} | {"type": batch.schema.field("_key").type}, []
            held.append([c[a + (a in begun) : b] for c in columns])
    if border is not None:
        yield border, *whole()


def _over_blocks(rows: DataFrame, borders: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs ``kernel(border, begins, ends, ids)``, which yields tuples of whole numbers, on each block of ``rows`` (_key, _part, _at, begin_us, end_us, id).
    ``borders``: _key, _part, and numbers of a block."""
    own = [c for c in borders.columns if c not in ("_key", "_part")]
    nothing = [F.lit(None).cast("long").alias(c) for c in own]
    first = borders.select("_key", "_part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("_at"), *[F.lit(0).cast("long").alias(c) for c in ("begin_us", "end_us", "id")], *[F.col(c).cast("long") for c in own])
    rest = rows.select("_key", "_part", F.lit(1).alias("kind"), "_at", "begin_us", "end_us", "id", *nothing)
    dealt = first.unionByName(rest).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "kind", "_at")
    names = ["_key", "_part", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches):
        import pyarrow as pa

        for border, *arrays in _blocks(batches):
            rows = list(kernel(border, *arrays))
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 2)
            yield pa.RecordBatch.from_arrays([pa.array([border["_key"]] * len(rows), border["type"]), pa.array([border["_part"]] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], names=names)

    return dealt.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, _part int, {schema}")


def _walk(steps: DataFrame, borders: DataFrame, decide) -> DataFrame:
    """(_key, _part, handed): what each block is handed. ``steps``: _key, _part, low, value, in the order of ``low``; ``decide(handed, lows, values,
    border)`` is what the block hands on. Blocks come by in order, one at a time."""
    own = [c for c in borders.columns if c not in ("_key", "_part")]
    first = borders.select("_key", "_part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("value"), *[F.col(c).cast("long") for c in own])
    rest = steps.select("_key", "_part", F.lit(1).alias("kind"), "low", "value", *[F.lit(None).cast("long").alias(c) for c in own])
    ready = first.unionByName(rest).repartition("_key").sortWithinPartitions("_key", "_part", "kind", F.col("low").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        border, lows, values, handed, out = None, [], [], None, []

        def close() -> None:
            nonlocal handed
            out.append((border["_key"], border["_part"], handed))
            handed = decide(handed, lows, values, border)

        def given(kind):
            keys, parts, states = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(parts, pa.int32()), pa.array(states, pa.int64())], names=["_key", "_part", "handed"])

        for batch in batches:
            kind = batch.schema.field("_key").type
            for row in batch.to_pylist():
                if row["kind"]:
                    lows.append(row["low"])
                    values.append(row["value"])
                    continue
                if border is not None:
                    close()
                    handed = handed if border["_key"] == row["_key"] else None
                border, lows, values = row, [], []
            if out:
                yield given(kind)
        if border is not None:
            close()
            yield given(kind)

    return ready.mapInArrow(run, f"_key {steps.schema['_key'].dataType.simpleString()}, _part int, handed long")


def _with_following(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``following``: the ``value`` of the key's next row, in the block or the first of a later one."""
    firsts = rows.groupBy("_key", "_part").agg(F.min_by(value, "begin_us").alias("_first"))
    nexts = firsts.select("_key", "_part", F.lead("_first").over(W.partitionBy("_key").orderBy("_part")).alias("_next"))
    own = F.lead(value).over(W.partitionBy("_key", "_part").orderBy("begin_us"))
    return rows.withColumn("_own", own).join(nexts, ["_key", "_part"]).withColumn("following", F.coalesce("_own", "_next")).drop("_own", "_next", "_part")


def _sorted(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    return placed(df.select(F.col(key).alias("_key"), "begin_us", "end_us", "id"), ["_key", *order])


# --- intervals without overlaps ----------------------------------------------------------------


def _targets(begins: np.ndarray, ends: np.ndarray, after: int | None) -> np.ndarray:
    """Each record's successor: the last one that begins before it ends, or, where that is none behind it, the next one (a record of no
    length does not begin before it ends, so that the last one lies before it). -1 where the block can't say: the successor lies behind it."""
    n = len(begins)
    at = np.arange(n)
    last = np.searchsorted(begins, ends, side="left") - 1
    to = np.where(last > at, last, at + 1)
    to[(to >= n) | (after is not None and ends > (after or 0))] = -1
    return to


def _overlap_steps(border: dict, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray):
    """What is handed on is the end of the last chosen record. Steps begin behind the begins of the records that a record of an earlier
    block may reach; the first step (no low) is for what reaches none."""
    n = len(begins)
    to = _targets(begins, ends, border["after_us"])
    final = np.where(to < 0, np.arange(n), to)
    while not np.array_equal(final[final], final):
        final = final[final]
    handed = ends[final]
    yield None, int(handed[0])
    reach = border["before_us"]
    for k in range(int(np.searchsorted(begins, reach, side="left")) if reach is not None else 0):
        yield int(begins[k]), int(handed[k])


def _handed_end(handed, lows, values, border):
    if handed is not None and border["after_us"] is not None and handed > border["after_us"]:
        return handed  # the successor lies behind this block
    k = 0 if handed is None else bisect_left(lows, handed, lo=1) - 1
    return values[k]


def _chosen(border: dict, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray):
    handed, after = border["handed"], border["after_us"]
    if handed is not None and after is not None and handed > after:
        return
    at = 0 if handed is None else max(0, int(np.searchsorted(begins, handed, side="left")) - 1)
    to = _targets(begins, ends, after)
    while at >= 0:
        yield int(begins[at]), int(ends[at]), int(ids[at])
        at = int(to[at])


def furthest_chain(df: DataFrame, key: str) -> DataFrame:
    """(key, id, begin_us, end_us) of the intervals that stay where intervals overlap: from the first one of a run on, always the one
    that reaches furthest of those that begin before the one in hand ends, which is cut where that one begins.

    Only records can be chosen: intervals that end after all that come before them (by begin, longer first, id), or that none before
    reaches into, which also holds for those of no length where another one ends. Of records that overlap, begins and ends both rise, so that
    the furthest-reaching one is the last that begins in time. An interval whose end is null overlaps nothing behind it.
    """
    ended = df.withColumn("end_us", F.coalesce(F.col("end_us"), F.lit(NO_END)))
    held = _sorted(ended, key, ["begin_us", F.desc("end_us"), "id"])
    parts = W.partitionBy("_key").orderBy("_part")
    carry = held.groupBy("_key", "_part").agg(F.max("end_us").alias("_most")).select("_key", "_part", F.max("_most").over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    inside = W.partitionBy("_key", "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.max("end_us").over(inside), F.col("_carry"))
    records = written(held.join(carry, ["_key", "_part"]).withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("end_us") > F.col("_reach")) | (F.col("begin_us") >= F.col("_reach"))).drop("_carry", "_reach"), "records")
    ends = records.groupBy("_key", "_part").agg(F.min("begin_us").alias("_first"), F.max("end_us").alias("_last"))
    borders = written(ends.select("_key", "_part", F.lead("_first").over(parts).alias("after_us"), F.lag("_last").over(parts).alias("before_us")), "borders")
    steps = _over_blocks(records, borders, _overlap_steps, "low long, value long")
    handed = _walk(steps, borders, _handed_end)
    chosen = written(_over_blocks(records, borders.join(handed, ["_key", "_part"]), _chosen, "begin_us long, end_us long, id long"), "chosen")
    end = F.when(F.col("end_us") > NO_END, F.least("end_us", "following"))
    return _with_following(chosen, "begin_us").select(F.col("_key").alias(key), "id", "begin_us", end.alias("end_us"))


# --- chunks anchored at files ------------------------------------------------------------------


def _arcs(border: dict, begins: np.ndarray, ends: np.ndarray, duration: int, hop: int):
    """Files that may begin a chunk: index, and begin and length of the residues (modulo the hop) of anchors for which they do. A chunk's last
    window ends ``duration - hop`` and the rest of a hop behind its last file."""
    before = np.concatenate([[border["before_us"] if border["before_us"] is not None else 0], ends[:-1]])
    free = begins - before - (duration - hop)
    for k in np.flatnonzero(free > 0).tolist():
        if k or border["before_us"] is not None:
            yield k, int(before[k] % hop), int(min(free[k], hop))


def _anchored_steps(duration: int, hop: int):
    def kernel(border, begins, ends, ids):
        steps = Steps(hop)
        for k, low, length in reversed(list(_arcs(border, begins, ends, duration, hop))):
            own = int(begins[k] % hop)
            handed = steps[own]
            steps.put(low, low + length, own if handed is SAME else handed)
        own = int(begins[0] % hop)
        yield None, own if steps[own] is SAME else steps[own]  # where the block's first file is the key's first
        yield from zip(steps.at, steps.value)

    return kernel


def _handed_residue(handed, lows, values, border):
    if handed is None:
        return values[0]
    found = values[bisect_right(lows, handed, lo=1) - 1]
    return handed if found is SAME else found


def _anchors(duration: int, hop: int):
    def kernel(border, begins, ends, ids):
        residue = border["handed"]
        if residue is None:
            residue = int(begins[0] % hop)
            yield int(begins[0]), None
        for k, low, length in _arcs(border, begins, ends, duration, hop):
            if (residue - low) % hop < length:
                residue = int(begins[k] % hop)
                yield int(begins[k]), int(ends[k - 1]) if k else border["before_us"]

    return kernel


def anchored_chunks(df: DataFrame, key: str, duration_us: int, hop_us: int) -> DataFrame:
    """(key, begin_us, end_us) of runs of files: a file joins the run if it begins no later than the last window (of ``duration_us``, every
    ``hop_us`` from the run's begin) that starts before the end of the file before it ends; else it begins a run."""
    held = _sorted(df, key, ["begin_us", "end_us", "id"])
    parts = W.partitionBy("_key").orderBy("_part")
    last = held.groupBy("_key", "_part").agg(F.max_by("end_us", "_at").alias("_last"))
    borders = written(last.select("_key", "_part", F.lag("_last").over(parts).alias("before_us")), "borders")
    handed = _walk(_over_blocks(held, borders, _anchored_steps(duration_us, hop_us), "low long, value long"), borders, _handed_residue)
    anchors = written(_over_blocks(held, borders.join(handed, ["_key", "_part"]), _anchors(duration_us, hop_us), "begin_us long, closed_us long"), "anchors")
    # the file before a run closes the one before it; the last run is closed by the key's last file
    ends = last.groupBy("_key").agg(F.max_by("_last", "_part").alias("_end"))
    return _with_following(anchors, "closed_us").join(ends, "_key").select(F.col("_key").alias(key), "begin_us", F.coalesce("following", "_end").alias("end_us"))
