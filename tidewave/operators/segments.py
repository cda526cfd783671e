"""Analysis windows over recordings: per file, over a total range, and anchored at files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered, running_sum_before
from .chains import anchored_chunks, furthest_chain
from .timeline import next_after


def hop_us(duration_us: int, overlap: float = 0.0) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    hop = duration_us * (1 - overlap)
    if duration_us <= 0 or abs(hop - round(hop)) > 1e-6:
        raise ValueError("duration and hop must be whole, positive microseconds")
    return round(hop)


def last_window_end(begin: Column, end: Column, hop: int, duration: int) -> Column:
    """Where the last window of a grid from ``begin`` that starts before ``end`` ends."""
    return begin + hop * (F.ceil((end - begin) / hop) - 1) + duration


def windows_total(bounds: DataFrame, duration_us: int, overlap: float = 0.0) -> DataFrame:
    """Tumbling or sliding windows from each row's begin_us; the last may run past end_us."""
    hop = hop_us(duration_us, overlap)
    count = F.ceil((F.col("end_us") - F.col("begin_us")) / hop)
    numbered = bounds.where(count > 0).withColumn("window", F.explode(F.sequence(F.lit(0), (count - 1).cast("long"))))
    begin = F.col("begin_us") + F.col("window") * hop
    rest = [c for c in bounds.columns if c not in ("begin_us", "end_us")]
    return numbered.select(*rest, "window", begin.alias("begin_us"), (begin + duration_us).alias("end_us"))


def total_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"))


#: Windows that one row stands for while items are brought to a grid.
STRETCH = 64


def populated_total(bounds: DataFrame, items: DataFrame, key: str, duration_us: int, overlap: float = 0.0) -> DataFrame:
    """The windows of ``windows_total`` with the duration that overlap-free items cover in them, their number and the covered share.

    An item's windows follow from its bounds, so that items are dealt out and windows are not: the grid comes in stretches of windows, a
    row each, which get the sums of their windows and are laid out last.
    """
    hop = hop_us(duration_us, overlap)
    grid = bounds.select(key, F.col("begin_us").alias("_lo"), F.ceil((F.col("end_us") - F.col("begin_us")) / hop).alias("_n")).where("_n > 0")
    own = items.where("begin_us IS NOT NULL AND end_us IS NOT NULL").select(key, "begin_us", "end_us").join(grid, key)
    low = F.greatest(F.floor((F.col("begin_us") - F.col("_lo") - duration_us) / hop) + 1, F.lit(0))
    high = F.least(F.ceil((F.col("end_us") - F.col("_lo")) / hop), F.col("_n")) - 1
    met = own.withColumns({"_low": low, "_high": high}).where("_high >= _low").withColumn("window", F.explode(F.sequence("_low", "_high")))
    begin = F.col("_lo") + F.col("window") * hop
    share = F.least("end_us", begin + duration_us) - F.greatest("begin_us", begin)
    dealt = met.select(key, F.floor(F.col("window") / STRETCH).alias("_stretch"), "window", share.alias("_us")).repartition(key, "_stretch")
    sums = dealt.groupBy(key, "_stretch", "window").agg(F.sum("_us").alias("us"), F.count("*").alias("n"))
    # at most as many entries as a stretch has windows
    held = sums.groupBy(key, "_stretch").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("us", "n")))).alias("_sums"))
    stretches = grid.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / STRETCH))))
    first = F.col("_stretch") * STRETCH
    laid = stretches.join(held, [key, "_stretch"], "left").withColumn("window", F.explode(F.sequence(first, F.least(first + STRETCH, F.col("_n")) - 1)))
    sums, zero = F.col("_sums")[F.col("window")], F.lit(0).cast("long")
    each = laid.select(key, "window", begin.alias("begin_us"), (begin + duration_us).alias("end_us"), F.coalesce(sums["us"], zero).alias("populated_us"), F.coalesce(sums["n"], zero).alias("n_items"))
    return each.withColumn("ratio", F.round(F.col("populated_us") / duration_us, 6))


def items_total(bounds: DataFrame, items: DataFrame, key: str, duration_us: int) -> DataFrame:
    """(key, window_begin_us, begin_us, end_us, file) of what the tumbling windows of ``windows_total`` hold: overlap-free items (by their id as
    ``file``) and the gaps around them (``file`` is null), cut at the borders of windows; a window without items is one gap.

    A gap reaches from an item, or the begin of the grid, to the next item, or the end of the grid; the windows of items and gaps follow from their
    bounds, so that items are dealt out and windows are not. Items of no length on a border lie in no window.
    """
    spans = bounds.select(key, F.col("begin_us").alias("_lo"), F.ceil((F.col("end_us") - F.col("begin_us")) / duration_us).alias("_n")).where("_n > 0")
    grid = spans.select(key, "_lo", (F.col("_lo") + F.col("_n") * duration_us).alias("_hi"))
    window = lambda at: F.expr(f"({at} - _lo) div {duration_us}L")
    cut = items.select(key, "begin_us", "end_us", F.col("id").alias("file")).join(grid, key).where("end_us > _lo AND begin_us < _hi")
    cut = cut.withColumn("begin_us", F.greatest("begin_us", "_lo")).withColumn("end_us", F.least("end_us", "_hi"))
    own = cut.where(window("end_us - 1") >= window("begin_us")).withColumn("_own", F.lit(True))
    # the begin of a grid is a mark of no length before its items; a key that is null has no items
    marks = grid.select(key, F.col("_lo").alias("begin_us"), F.col("_lo").alias("end_us"), F.lit(None).cast(own.schema["file"].dataType).alias("file"), "_lo", "_hi", F.lit(False).alias("_own"))
    known = next_after(own.unionByName(marks.where(F.col(key).isNotNull())), key, "begin_us", "_next")
    every = known.unionByName(marks.where(F.col(key).isNull()).withColumn("_next", F.lit(None).cast("long"))).withColumn("_next", F.coalesce("_next", "_hi"))
    nothing = F.lit(None).cast(own.schema["file"].dataType)
    gap = F.when(F.col("_next") > F.col("end_us"), F.struct(F.col("end_us").alias("b"), F.col("_next").alias("e"), nothing.alias("file")))
    item = F.when(F.col("_own"), F.struct(F.col("begin_us").alias("b"), F.col("end_us").alias("e"), F.col("file").alias("file")))
    pieces = every.select(key, "_lo", F.explode(F.array_compact(F.array(gap, item))).alias("_i")).select(key, "_lo", "_i.*")
    laid = pieces.withColumn("_window", F.explode(F.sequence(window("b"), window("e - 1")))).withColumn("window_begin_us", F.col("_lo") + F.col("_window") * duration_us)
    return laid.select(key, "window_begin_us", F.greatest("b", "window_begin_us").alias("begin_us"), F.least("e", F.col("window_begin_us") + duration_us).alias("end_us"), "file")


def windows_files(df: DataFrame, key: str) -> DataFrame:
    """One window per file, overlaps removed."""
    return furthest_chain(df, key)


def windows_file_anchored(df: DataFrame, key: str, duration_us: int, overlap: float = 0.0) -> DataFrame:
    """Windows from the begin of the first file of each chunk; a file joins the chunk if it begins
    no later than the chunk's last window ends, else it anchors a new chunk."""
    chunks = anchored_chunks(df, key, duration_us, hop_us(duration_us, overlap))
    return windows_total(chunks, duration_us, overlap)


def files_in_range(df: DataFrame, key: str, begin_us: int, end_us: int) -> DataFrame:
    """Files from the last one that begins at or before ``begin_us`` (the first one, if none does) to the last one that begins
    at or before ``end_us``."""
    first = df.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("begin_us") <= begin_us, F.col("begin_us"))), F.min("begin_us")).alias("_first"))
    return df.where(F.col("begin_us") <= end_us).join(first, key).where(F.col("begin_us") >= F.col("_first")).drop("_first")


def split_equal(df: DataFrame, parts: int) -> DataFrame:
    """Each interval in ``parts`` equal pieces."""
    span = F.col("end_us") - F.col("begin_us")
    cut = lambda k: F.col("begin_us") + F.floor(span * k / parts)
    rest = [c for c in df.columns if c not in ("begin_us", "end_us")]
    pieces = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return pieces.select(*rest, "part", cut(F.col("part")).alias("begin_us"), cut(F.col("part") + 1).alias("end_us"))


def frame_bounds(begin_us: Column, at_begin: Column, at_end: Column, rate: int) -> tuple[Column, Column]:
    """First frame (floor) and frame after the last (round half to even) of a stretch of a file."""
    return F.floor((at_begin - begin_us) * rate / 1_000_000), F.bround((at_end - begin_us) * rate / 1_000_000).cast("long")


def batches(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds ``batch``: ``n`` runs of rows in order, the remainder spread over the first ones.

    The place of a row comes from counts per range of sorted rows, not from one global window.
    """
    if n < 1:
        raise ValueError("there must be a batch")
    rows = numbered(df, list(order), "_place")
    total = rows.count()
    each, rest = divmod(total, n)
    at, big = F.col("_place"), rest * (each + 1)
    batch = F.when(at < big, F.floor(at / (each + 1))).otherwise(rest + F.floor((at - big) / max(each, 1)))
    return rows.withColumn("batch", batch).drop("_place")


def cumulative_begin(df: DataFrame, key: str, order: str, first_us: int) -> DataFrame:
    """For files without a time stamp: each begins where the ones before it end."""
    before = running_sum_before(df, key, [order], "duration_us", "begin_us")
    return before.withColumn("begin_us", F.col("begin_us") + F.lit(first_us))
