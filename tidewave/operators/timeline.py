"""Interval algebra on half-open intervals ``[begin_us, end_us)`` in BIGINT microseconds.

Sharing a border is no overlap, and intervals of no length overlap only what strictly encloses them.
Every function is a DataFrame transformation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import written

DAY_US = 86_400_000_000


def overlaps(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    return (a_begin < b_end) & (a_end > b_begin)


def _levels(df: DataFrame, width_us: int) -> DataFrame:
    """Adds ``_level``, the least one whose buckets (``width_us`` times a power of two) are as long as the interval."""
    span = F.col("end_us") - F.col("begin_us")
    return df.withColumn("_level", F.when(span > width_us, F.ceil(F.log2(span / width_us))).otherwise(0).cast("int"))


def _buckets(df: DataFrame, other: DataFrame, width_us: int, side: str) -> DataFrame:
    """Rows of ``df`` by the buckets in which they may meet rows of ``other``: at their own level, and at the longer ones that occur there. An interval
    lies in two buckets of a level at most (three, if rounding put it a level too low)."""
    # at most as many rows as a duration has bits
    present = F.broadcast(_levels(other, width_us).select(F.col("_level").alias("_at")).distinct())
    own = _levels(df, width_us)
    own = own.withColumn("_other", F.lit(False)).withColumn("_at", F.col("_level")).unionByName(own.withColumn("_other", F.lit(True)).join(present, F.col("_level") < F.col("_at")))
    size = F.expr("shiftleft(1L, _at)") * F.lit(width_us)
    first = F.floor(F.col("begin_us") / size)
    last = F.greatest(first, F.floor((F.col("end_us") - 1) / size))
    return own.withColumn(f"_first_{side}", first).withColumn("_bucket", F.explode(F.sequence(first, last))).withColumnsRenamed({"_other": f"_longer_{side}"}).drop("_level")


def _meet() -> Column:
    """Rows of a level and bucket, one of which has this level itself."""
    return (F.col("x._at") == F.col("y._at")) & (F.col("x._bucket") == F.col("y._bucket")) & ~(F.col("x._longer_x") & F.col("y._longer_y"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width_us: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals with equal ``keys``; columns of the sides get the prefixes l_ and r_.

    Each interval lies in buckets of about its own length, from ``width_us`` (about the 95th percentile of the durations) upwards by
    powers of two, and the shorter of a pair is looked up in the longer one's; so a long interval costs a few rows, not one for each short
    bucket, and the join is an equi-join that Spark can hash, sort or split by skew. A pair that shares
    two buckets counts in the later of the two first ones. ``how``: inner, left_semi or left_anti.
    The semi and anti forms need a column ``id`` on the left, which with the keys names its rows.
    """
    own = ("_at", "_bucket")
    lhs, rhs = _buckets(left, right, width_us, "x"), _buckets(right, left, width_us, "y")
    lhs = lhs.select([F.col(c).alias(c if c in (*own, "_first_x", "_longer_x") else f"l_{c}") for c in lhs.columns]).alias("x")
    rhs = rhs.select([F.col(c).alias(c if c in (*own, "_first_y", "_longer_y") else f"r_{c}") for c in rhs.columns]).alias("y")
    on = _meet()
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    on = on & overlaps(F.col("l_begin_us"), F.col("l_end_us"), F.col("r_begin_us"), F.col("r_end_us"))
    if how == "inner":
        on = on & (F.col("x._bucket") == F.greatest("_first_x", "_first_y"))
        return lhs.join(rhs, on).drop(*own, "_first_x", "_first_y", "_longer_x", "_longer_y")
    names = [*keys, *([] if "id" in keys else ["id"])]
    hit = lhs.join(rhs, on, "left_semi").select(*[F.col(f"l_{c}").alias(c) for c in names]).distinct()
    return left.join(hit, names, how)


def clip(begin: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return F.greatest(begin, low), F.least(end, high)


def running_max_before(df: DataFrame, key: str, value: str, name: str, width_us: int = DAY_US) -> DataFrame:
    """The largest ``value`` of all rows of the key that come earlier by (begin, longer first, id).

    In two levels, so that a key with very many rows is spread over its buckets of time: the maximum
    of each bucket, carried over the buckets, and then row by row inside a bucket.
    """
    by = df.withColumn("_bucket", F.floor(F.col("begin_us") / width_us))
    each = by.groupBy(key, "_bucket").agg(F.max(value).alias("_most"))
    carried = each.withColumn("_carry", F.max("_most").over(W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_most")
    order = W.partitionBy(key, "_bucket").orderBy("begin_us", F.col("end_us").desc(), "id").rowsBetween(W.unboundedPreceding, -1)
    return by.join(carried, [key, "_bucket"]).withColumn(name, F.greatest(F.max(value).over(order), F.col("_carry"))).drop("_bucket", "_carry")


def with_islands(df: DataFrame, key: str, slack_us: int = 0, width_us: int = DAY_US) -> DataFrame:
    """Adds ``island``: the begin of the first interval of each run whose intervals hang together
    (gaps below ``slack_us`` do not part a run)."""
    reached = running_max_before(df, key, "end_us", "_reach", width_us)
    start = F.when(F.col("_reach").isNull() | (F.col("begin_us") >= F.col("_reach") + slack_us), F.col("begin_us"))
    marked = reached.withColumn("_start", start)
    done = running_max_before(marked, key, "_start", "_before", width_us)
    return done.withColumn("island", F.coalesce("_start", "_before")).drop("_reach", "_start", "_before")


def coverage_islands(df: DataFrame, key: str) -> DataFrame:
    """One row per island: bounds, members and summed duration."""
    return with_islands(df, key).groupBy(key, "island").agg(
        F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("begin_us")).alias("busy_us")
    ).drop("island")


def remove_overlaps(df: DataFrame, key: str) -> DataFrame:
    """(key, id, begin_us, end_us) without overlaps: of intervals that overlap the one in hand the one
    that reaches furthest is kept and the one in hand ends where it begins; intervals that end no later are
    dropped. Blocks of sorted rows are decided side by side, however long a run of overlapping intervals is."""
    from .chains import furthest_chain

    return furthest_chain(df, key)


def next_after(df: DataFrame, key: str, value: str, name: str, width_us: int = DAY_US) -> DataFrame:
    """Adds the ``value`` of the key's next row by (begin, end): inside a stretch of time by the row that follows, and at its end by
    the first row of the next stretch, so that a key with very many rows is spread over its stretches."""
    by = df.withColumn("_bucket", F.floor(F.col("begin_us") / width_us))
    first = by.groupBy(key, "_bucket").agg(F.min(F.struct("begin_us", "end_us", F.col(value).alias("_v")))["_v"].alias("_first"))
    carried = first.select(key, "_bucket", F.lead("_first").over(W.partitionBy(key).orderBy("_bucket")).alias("_carry"))
    order = W.partitionBy(key, "_bucket").orderBy("begin_us", "end_us")
    return by.withColumn(name, F.lead(value).over(order)).join(carried, [key, "_bucket"]).withColumn(name, F.coalesce(name, "_carry")).drop("_bucket", "_carry")


def fill_gaps(df: DataFrame, key: str, **values) -> DataFrame:
    """The gaps between neighbours of overlap-free intervals: (key, id, begin_us, end_us) with id null; ``values`` are
    further columns of the gaps."""
    gaps = next_after(df, key, "begin_us", "next_us").where("next_us > end_us")
    more = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()]
    return gaps.select(key, F.lit(None).cast("long").alias("id"), F.col("end_us").alias("begin_us"), F.col("next_us").alias("end_us"), *more)


def trim(df: DataFrame, begin_us: int, end_us: int) -> DataFrame:
    """Items that reach ``begin_us`` or beyond and begin before ``end_us``, clipped to both."""
    kept = df.where((F.col("end_us") >= begin_us) & (F.col("begin_us") < end_us))
    return kept.withColumn("begin_us", F.greatest("begin_us", F.lit(begin_us))).withColumn("end_us", F.least("end_us", F.lit(end_us)))


def populated(windows: DataFrame, items: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Each window with the duration that overlap-free items cover in it and the covered share.

    Windows without an item keep a share of 0: the outer side of the bucketed join keeps them, and one
    aggregation puts the buckets of a window together.
    """
    names = [*keys, "begin_us", "end_us"]
    lhs = _buckets(windows.select(names), items.select(names), width_us, "x").alias("x")
    rhs = _buckets(items.select(names), windows.select(names), width_us, "y").alias("y")
    on = _meet() & (F.col("x._bucket") == F.greatest("_first_x", "_first_y"))
    for k in keys:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    on = on & overlaps(F.col("x.begin_us"), F.col("x.end_us"), F.col("y.begin_us"), F.col("y.end_us"))
    begin, end = clip(F.col("y.begin_us"), F.col("y.end_us"), F.col("x.begin_us"), F.col("x.end_us"))
    covered = lhs.join(rhs, on, "left").groupBy([F.col(f"x.{c}").alias(c) for c in names]).agg(F.coalesce(F.sum(F.when(F.col("y.begin_us").isNotNull(), end - begin)), F.lit(0)).alias("populated_us"), F.count("y.begin_us").alias("n_items"))
    return covered.withColumn("ratio", F.round(F.col("populated_us") / (F.col("end_us") - F.col("begin_us")), 6))


def asof_backward(left: DataFrame, right: DataFrame, key: str, value: str, width_us: int = DAY_US) -> DataFrame:
    """For each left row (id, at_us) the ``value`` of the last right row (at_us) of the key at or before it.

    A union and a running last value, without an inequality join: inside stretches of time, and carried from
    stretch to stretch, so that a key with very many rows is spread over its stretches.
    """
    a = left.select(key, F.col("at_us"), F.col("id"), F.lit(1).alias("side"), F.lit(None).cast("long").alias(value))
    b = right.select(key, F.col("at_us"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("side"), F.col(value))
    every = a.unionByName(b).withColumn("_bucket", F.floor(F.col("at_us") / width_us))
    last = every.groupBy(key, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("at_us", value))).alias("_last"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(key, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    order = W.partitionBy(key, "_bucket").orderBy("at_us", "side", value).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = every.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("side = 1").join(carried, [key, "_bucket"])
    return seen.select(key, "id", "at_us", F.coalesce(value, "_carry").alias(value))


def nearest(left: DataFrame, right: DataFrame, key: str, value: str, width_us: int = DAY_US) -> DataFrame:
    """For each left row (id, at_us) the ``value`` and ``found_us`` of the right row (at_us) of the key that is nearest in time; the earlier one of two as
    near, and of several at one time the one with the largest value.

    A union that is written once; last values from before and first ones from behind in one pass inside stretches of time, and carried
    from stretch to stretch both ways, so that a key with very many rows is spread over its stretches.
    """
    a = left.select(key, F.col("at_us"), F.col("id"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    b = right.where(F.col(value).isNotNull()).groupBy(key, "at_us").agg(F.max(value).alias(value)).select(key, "at_us", F.lit(None).cast(left.schema["id"].dataType).alias("id"), value, F.lit(0).alias("side"))
    every = written(a.unionByName(b).withColumn("_bucket", F.floor(F.col("at_us") / width_us)), "nearest")
    point = F.when(F.col("side") == 0, F.struct("at_us", value))
    ends = every.groupBy(key, "_bucket").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    stretches = W.partitionBy(key).orderBy("_bucket")
    carried = ends.select(key, "_bucket", F.last("_last", ignorenulls=True).over(stretches.rowsBetween(W.unboundedPreceding, -1)).alias("_from"), F.first("_first", ignorenulls=True).over(stretches.rowsBetween(1, W.unboundedFollowing)).alias("_to"))
    order = W.partitionBy(key, "_bucket").orderBy("at_us", "side")
    around = every.withColumn("_p", F.last(point, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_n", F.first(point, ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    both = around.where("side = 1").join(carried, [key, "_bucket"]).withColumn("_p", F.coalesce("_p", "_from")).withColumn("_n", F.coalesce("_n", "_to"))
    before, behind = F.col("at_us") - F.col("_p.at_us"), F.col("_n.at_us") - F.col("at_us")
    chosen = F.when(F.col("_n").isNull() | (before <= behind), F.col("_p")).otherwise(F.col("_n"))
    return both.withColumn("_c", chosen).select(key, "id", "at_us", F.col(f"_c.{value}").alias(value), F.col("_c.at_us").alias("found_us"))
