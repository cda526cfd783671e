"""Signals of windows: which stretches of which files a window holds, and their samples through the read chain.

A window is a list of items in time order: stretches of overlap-free files, and gaps between them, before the first and
after the last. The chain reads the items, resamples consecutive ones of one rate as one stream, fills gaps with
zeros, filters, normalises and calibrates, in this order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal
from ..sources import backends
from .timeline import clip, interval_join


def window_items(windows: DataFrame, files: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """The items of each window: (keys, ``id``, ``window_begin_us``, ``window_end_us``, ``begin_us``, ``end_us``, ``file``,
    ``file_us``); ``file`` is null for a gap, and a window without files is one gap.

    ``windows`` has the keys, id, begin_us, end_us; ``files`` the keys, id, begin_us, end_us, without overlaps.
    """
    own = windows.select(*keys, "id", "begin_us", "end_us")
    pairs = interval_join(own, files.select(*keys, "id", "begin_us", "end_us"), keys, width_us)
    begin, end = clip(F.col("r_begin_us"), F.col("r_end_us"), F.col("l_begin_us"), F.col("l_end_us"))
    names = [*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_id").alias("id"), F.col("l_begin_us").alias("window_begin_us"), F.col("l_end_us").alias("window_end_us")]
    held = pairs.select(*names, begin.alias("begin_us"), end.alias("end_us"), F.col("r_id").alias("file"), F.col("r_begin_us").alias("file_us"))
    # each window itself is a mark at its end, so that the gap before the mark is the tail, or the whole window
    marks = own.select(*keys, "id", F.col("begin_us").alias("window_begin_us"), F.col("end_us").alias("window_end_us"), F.col("end_us").alias("begin_us"), F.col("end_us"), F.lit(None).cast("long").alias("file"), F.lit(None).cast("long").alias("file_us"))
    order = W.partitionBy(*keys, "id", "window_begin_us").orderBy("begin_us", F.col("file").asc_nulls_last())
    every = held.unionByName(marks).withColumn("before_us", F.coalesce(F.lag("end_us").over(order), F.col("window_begin_us")))
    gap = F.when(F.col("begin_us") > F.col("before_us"), F.struct(F.col("before_us").alias("b"), F.col("begin_us").alias("e"), F.lit(None).cast("long").alias("file"), F.lit(None).cast("long").alias("at")))
    item = F.when(F.col("file").isNotNull(), F.struct(F.col("begin_us").alias("b"), F.col("end_us").alias("e"), F.col("file").alias("file"), F.col("file_us").alias("at")))
    rows = every.select(*keys, "id", "window_begin_us", "window_end_us", F.explode(F.array_compact(F.array(gap, item))).alias("i"))
    return rows.select(*keys, "id", "window_begin_us", "window_end_us", F.col("i.b").alias("begin_us"), F.col("i.e").alias("end_us"), F.col("i.file").alias("file"), F.col("i.at").alias("file_us"))


@dataclass(frozen=True)
class Chain:
    """What becomes of a window's samples. ``rate``: of the result (None: the rate of the files, which must then
    be one); ``channels``: indexes (None: all); ``sections``: of a filter, for the result's rate."""

    rate: float | None = None
    channels: tuple[int, ...] | None = None
    sections: tuple[tuple[float, ...], ...] = ()
    normalization: int = signal.RAW
    instrument: signal.Instrument | None = None

    def __post_init__(self) -> None:
        signal.check_normalization(self.normalization)
        if self.rate is not None and self.rate <= 0:
            raise ValueError("the rate must be positive")
        if self.channels is not None and (not self.channels or min(self.channels) < 0):
            raise ValueError("channels must be indexes from 0")

    def pick(self, x: np.ndarray) -> np.ndarray:
        if self.channels is None:
            return x
        if max(self.channels) >= x.shape[1]:
            raise ValueError(f"there are {x.shape[1]} channels only")
        return x[:, list(self.channels)]


def bround(value: float) -> int:
    """To the nearest whole number, half to even, as Spark's function of that name."""
    return int(np.rint(value))


def render(begin_us: int, end_us: int, items: list[tuple[int, int, float, np.ndarray]], chain: Chain) -> np.ndarray:
    """Channels by samples of a window, from its items (begin, end, rate, frames by channels) in time order.

    Items of one rate without a gap between them are resampled as one stream; where the rate changes or a gap lies, the
    stream ends. Each stream is put where its begin lies; what none covers is 0.
    """
    rates = {r for _, _, r, _ in items}
    if chain.rate is None and len(rates) > 1:
        raise ValueError(f"files of several rates ({sorted(rates)}) need a rate")
    rate = chain.rate or (rates.pop() if rates else 1.0)
    picked = [(b, e, r, chain.pick(x)) for b, e, r, x in items]
    widths = {x.shape[1] for *_, x in picked}
    if len(widths) > 1:
        raise ValueError("files of several numbers of channels need a choice of channels")
    out = np.zeros((widths.pop() if widths else len(chain.channels or (0,)), bround((end_us - begin_us) * rate / 1e6)))
    streams: list[tuple[int, float, list[np.ndarray]]] = []
    reached = None
    for b, e, r, x in picked:
        if streams and reached == b and streams[-1][1] == r:
            streams[-1][2].append(x)
        else:
            streams.append((b, r, [x]))
        reached = e
    for b, r, parts in streams:
        at = bround((b - begin_us) * rate / 1e6)
        for c, own in enumerate(np.concatenate(parts).T):
            own = signal.resample_array(own, r, rate)[: max(0, out.shape[1] - at)]
            out[c, at : at + len(own)] = own
    if chain.sections:
        out = np.stack([signal.filter_array(x, chain.sections) for x in out])
    out = np.stack([signal.normalize_array(x, chain.normalization) for x in out])
    return out * chain.instrument.pressure_per_unit if chain.instrument else out


RENDERED = "id long, channel int, rate double, x array<double>"


#: Samples of results that a task hands out at once.
SAMPLES_A_BATCH = 1_000_000


def _by_window(batches):
    """The rows of each window in turn, from batches sorted by ``id``; samples (``x``) become arrays."""
    held, rows = None, []
    for batch in batches:
        names = [c for c in batch.schema.names if c != "x"]
        columns = [batch.column(c).to_pylist() for c in names]
        x = batch.column("x") if "x" in batch.schema.names else None
        for i, values in enumerate(zip(*columns)):
            r = dict(zip(names, values))
            if x is not None and x[i].is_valid:
                r["x"] = x[i].values.to_numpy(zero_copy_only=False)
            if rows and r["id"] != held:
                yield rows
                rows = []
            held = r["id"]
            rows.append(r)
    if rows:
        yield rows


def _rendered(items: DataFrame, chain: Chain, samples) -> DataFrame:
    """Runs the chain on the items of each window; ``samples(row)`` gives an item's (rate, frames). Items are dealt by window, sorted,
    and rendered as they stream by."""

    def run(batches):
        import pyarrow as pa

        out, size = [], 0

        def handed():
            ids, channels, rates, x = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(channels, pa.int32()), pa.array(rates, pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["id", "channel", "rate", "x"])

        for rows in _by_window(batches):
            found = [(r["begin_us"], r["end_us"], *samples(r)) for r in rows if r["file"] is not None]
            rate = chain.rate or (found[0][2] if found else 1.0)
            for c, x in enumerate(render(rows[0]["window_begin_us"], rows[0]["window_end_us"], found, chain)):
                out.append((rows[0]["id"], c, rate, x))
                size += len(x)
            if size >= SAMPLES_A_BATCH:
                yield handed()
                out, size = [], 0
        if out:
            yield handed()

    return items.repartition("id").sortWithinPartitions("id", "begin_us").mapInArrow(backends.travelling(run), RENDERED)


def _frames(r: dict) -> tuple[int, int]:
    """First frame (floor) and the one after the last (half to even) of an item in its file, within the file."""
    start = (r["begin_us"] - r["file_us"]) * r["rate"] // 1_000_000
    stop = bround((r["end_us"] - r["file_us"]) * r["rate"] / 1e6)
    return int(start), min(int(stop), r["frames"])


def signals_of_files(windows: DataFrame, files: DataFrame, chain: Chain, keys: list[str], width_us: int) -> DataFrame:
    """(id, channel, rate, x) of each window, read from files by seeking.

    ``files``: the keys, id, begin_us, end_us (overlap-free), path, rate, frames. Only what describes the items is shuffled;
    the task that renders a window reads its frames.
    """
    items = window_items(windows, files, keys, width_us)
    known = files.select(*keys, F.col("id").alias("file"), "path", F.col("rate").cast("double").alias("rate"), "frames")
    ready = items.join(known, [*keys, "file"], "left")

    def samples(r: dict):
        return r["rate"], backends.read(r["path"], *_frames(r))

    return _rendered(ready, chain, samples)


def signals_of_tables(windows: DataFrame, recordings: DataFrame, chain: Chain, keys: list[str], width_us: int, spans: DataFrame | None = None) -> DataFrame:
    """(id, channel, rate, x) of each window, from a table of recordings (keys, id, begin_us, end_us, rate, x: samples of
    one channel). ``spans`` are the recordings' stretches without overlaps (keys, id, begin_us, end_us), where these differ."""
    items = window_items(windows, recordings if spans is None else spans, keys, width_us)
    known = recordings.select(*keys, F.col("id").alias("file"), F.col("begin_us").alias("whole_us"), F.col("rate").cast("double").alias("rate"), F.size("x").cast("long").alias("frames"), "x")
    ready = items.join(known, [*keys, "file"], "left")
    first = F.floor((F.col("begin_us") - F.col("whole_us")) * F.col("rate") / 1_000_000)
    stop = F.least(F.bround((F.col("end_us") - F.col("whole_us")) * F.col("rate") / 1_000_000).cast("long"), F.col("frames"))
    # only the frames of the item travel
    cut = ready.withColumn("x", F.when(F.col("file").isNotNull(), F.slice("x", (first + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int")))).drop("whole_us", "frames")

    def samples(r: dict):
        return r["rate"], np.asarray(r["x"], dtype=float)[:, None]

    return _rendered(cut, chain, samples)


STREAMED = "id long, start long, channel int, x array<double>"


def stream_of_files(windows: DataFrame, files: DataFrame, chain: Chain, keys: list[str], width_us: int, chunk: int = 8_192) -> DataFrame:
    """The samples of each window as a stream: rows (id, start, channel, x) of about ``chunk`` frames in the order of ``start``.

    For windows of any length: a task holds one piece at a time. Consecutive items of one rate are resampled as one
    stream, gaps are zeros, and the stream ends with the window. Steps that need a whole window (filter, normalisation) are refused.
    """
    if chain.rate is None or chain.sections or chain.normalization != signal.RAW:
        raise ValueError("a stream needs a rate, and neither filters nor normalises")
    items = window_items(windows, files, keys, width_us)
    known = files.select(*keys, F.col("id").alias("file"), "path", F.col("rate").cast("double").alias("rate"), "frames")
    fields = ["begin_us", "end_us", "file", "file_us", "path", "rate", "frames"]
    ready = items.join(known, [*keys, "file"], "left").groupBy("id", "window_begin_us", "window_end_us").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    gain = chain.instrument.pressure_per_unit if chain.instrument else 1.0
    wanted = len(chain.channels) if chain.channels else None

    def pieces(begin: int, end: int, rows: list[dict]):
        """(frames by channels) in order, as many as the window has."""
        frame = lambda us: bround((us - begin) * chain.rate / 1e6)
        total, made, streams, reached, rate = frame(end), 0, None, None, None

        def cut(x: np.ndarray, until: int) -> np.ndarray:
            nonlocal made
            x = x[: max(0, until - made)]
            made += len(x)
            return x

        def closed(until: int):
            nonlocal streams
            if streams:
                yield cut(np.stack([s.finish() for s in streams], axis=1), min(until, total))
                streams = None

        def zeros(until: int):
            while made < until:
                yield cut(np.zeros((min(chunk, until - made), width)), until)

        width = wanted or next((backends.info(r["path"]).channels for r in rows if r["file"] is not None), 1)
        for r in rows:
            if r["file"] is None or reached != r["begin_us"] or rate != r["rate"]:
                yield from closed(frame(r["begin_us"]) + 1)
                yield from zeros(frame(r["begin_us"]))
            if r["file"] is None:
                continue
            if streams is None:
                streams, rate = [signal.StreamResampler(r["rate"], chain.rate) for _ in range(width)], r["rate"]
            for x in backends.stream(r["path"], *_frames(r), chunk):
                yield cut(np.stack([s.push(c) for s, c in zip(streams, chain.pick(x).T, strict=True)], axis=1), total)
            reached = r["end_us"]
        yield from closed(total)
        yield from zeros(total)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                start = 0
                for x in pieces(row["window_begin_us"], row["window_end_us"], row["items"]):
                    n = x.shape[1]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * n, pa.int64()), pa.array([start] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(list(x.T * gain), pa.list_(pa.float64()))], names=["id", "start", "channel", "x"])
                    start += len(x)

    return ready.mapInArrow(backends.travelling(run), STREAMED)


def split_chunks(items: DataFrame, chunk: int = 8_192) -> DataFrame:
    """The pieces of at most ``chunk`` frames in which an item (``first``, ``stop``) is streamed: adds ``piece``, ``start`` and ``end``."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    n = F.ceil((F.col("stop") - F.col("first")) / chunk)
    pieces = items.where(n > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("first") + F.col("piece") * chunk
    return pieces.withColumn("start", start).withColumn("end", F.least(start + chunk, F.col("stop")))

