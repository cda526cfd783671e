"""Signals of any length as rows of consecutive samples, and what becomes of them without ever holding one whole.

A piece is a row (``id``, ``start``, ``channel``, ``x``): samples ``start`` and following of a channel of a signal, rates
being equal within a signal. Pieces come in any order and of any lengths, without overlaps and holes. Windows over
files are cut into pieces that tasks read side by side, each with the samples around it that resampling needs. A filter is a linear system: each piece
says what state it leaves behind from silence, the states are carried from piece to piece by powers of the
transition matrix, and each piece is then filtered from its own. Normalisation takes two passes, the first
for sums and extremes by piece. Of frames that reach over the borders of pieces only their samples are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal, spectral
from ..functions.signal import arrays_of, lists_of
from ..functions.spectral import Fft
from ..sources import backends
from .ranges import placed, written
from .signals import Chain, window_items
from .timeline import interval_join

PIECES = "id long, start long, channel int, x array<double>"
OWN = ["id", "channel"]
#: Samples of a piece, and of a part of a long-term average that a task holds.
CHUNK, PART = 65_536, 1 << 20


def _rows(batch):
    return zip(batch.column("id").to_pylist(), batch.column("start").to_pylist(), batch.column("channel").to_pylist(), arrays_of(batch.column("x")))


def _piece_batch(rows: list[tuple]):
    import pyarrow as pa

    ids, starts, channels, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(channels, pa.int32()), lists_of(list(x))], names=["id", "start", "channel", "x"])


# --- windows over files ------------------------------------------------------------------------


def _streams(items: DataFrame, rate: float) -> DataFrame:
    """Items of files (with ``first`` and ``n``, frames of the file) and the stream they belong to: consecutive items of one rate are one. Adds
    ``at`` and ``until`` (the stream's frames in the window), ``offset`` (of the item in the stream) and ``total`` (frames of the stream)."""
    order = W.partitionBy("id").orderBy("begin_us")
    joined = (F.lag("end_us").over(order) == F.col("begin_us")) & (F.lag("rate").over(order) == F.col("rate"))
    own = items.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), None).otherwise(F.col("begin_us")))
    own = own.withColumn("stream_us", F.last("_new", ignorenulls=True).over(order))
    stream = W.partitionBy("id", "stream_us")
    own = own.withColumn("offset", F.coalesce(F.sum("n").over(stream.orderBy("begin_us").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(stream))
    frame = lambda us: F.bround((us - F.col("window_begin_us")) * rate / 1_000_000).cast("long")
    own = own.withColumn("at", frame(F.col("stream_us"))).withColumn("whole", frame(F.col("window_end_us")))
    # where streams meet within the rounding of a frame, the later one has it
    following = F.min(F.when(F.col("_new").isNotNull(), F.col("at"))).over(order.rowsBetween(1, W.unboundedFollowing))
    until = F.least(F.col("at") + F.bround(F.col("total") * rate / F.col("rate")).cast("long"), F.coalesce(following, F.col("whole")), F.col("whole"))
    return own.withColumn("until", F.min(until).over(stream)).drop("_new", "whole")


def _with_frames(items: DataFrame, origin: str, frames: Column) -> DataFrame:
    """Items of files with their first frame (floor) and number of frames (up to the last, half to even)."""
    first = F.floor((F.col("begin_us") - F.col(origin)) * F.col("rate") / 1_000_000)
    stop = F.least(F.bround((F.col("end_us") - F.col(origin)) * F.col("rate") / 1_000_000).cast("long"), frames)
    return items.where(F.col("file").isNotNull()).withColumn("first", first).withColumn("n", F.greatest(stop - first, F.lit(0)))


FIELDS = ["at", "offset", "n", "first", "total", "until", "rate"]


def _in_chunks(windows: DataFrame, own: DataFrame, rate: float, payload: str, samples: Callable, width: Callable, chunk: int) -> DataFrame:
    """Pieces of ``chunk`` frames of each window from the items ``own`` of its streams. ``samples(row, p, q)`` gives frames [p, q) of the item in its
    stream, by channels; ``width(any payload of the window, or None)`` the number of channels."""
    # what an item's frames reach to in the result, and a frame more for rounding
    pace = F.col("rate") / rate
    half = F.when(F.col("rate") == rate, 0).otherwise(F.ceil(16 / F.least(F.lit(1.0), rate / F.col("rate"))) + 1)
    low = F.greatest(F.col("at") + F.floor((F.col("offset") - half) / pace) - 1, F.col("at"))
    high = F.least(F.col("at") + F.ceil((F.col("offset") + F.col("n") + half) / pace) + 1, F.col("until"))
    spans = own.select("id", low.alias("begin_us"), high.alias("end_us"), *FIELDS, payload).where("end_us > begin_us")
    whole = F.bround((F.col("end_us") - F.col("begin_us")) * rate / 1_000_000).cast("long")
    grid = windows.select("id", whole.alias("whole")).where("whole > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / chunk))))
    grid = grid.select("id", (F.col("k") * chunk).alias("begin_us"), F.least((F.col("k") + 1) * chunk, F.col("whole")).alias("end_us"))
    met = interval_join(grid, spans, ["id"], chunk).select(F.col("l_id").alias("id"), F.col("l_begin_us").alias("begin_us"), F.col("l_end_us").alias("end_us"), *[F.col(f"r_{c}").alias(c) for c in FIELDS], F.col(f"r_{payload}").alias(payload))
    # each piece itself is a row before those of its items, with some payload of its window
    kind = own.schema[payload].dataType
    any_payload = own.groupBy("id").agg(F.min(payload).alias(payload)) if payload == "path" else own.select("id", F.lit(None).cast(kind).alias(payload)).distinct()
    marks = grid.join(any_payload, "id", "left").select("id", "begin_us", "end_us", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in FIELDS], payload)
    ready = marks.unionByName(met).repartition("id", "begin_us").sortWithinPartitions("id", "begin_us", F.col("at").asc_nulls_first(), "offset")

    def rendered(begin: int, end: int, rows: list[dict], channels: int) -> np.ndarray:
        out = np.zeros((end - begin, channels))
        for at in sorted({r["at"] for r in rows}):
            stream = [r for r in rows if r["at"] == at]
            start, stop = max(begin, at), min(end, stream[0]["until"])
            if start >= stop:
                continue
            origin, total = stream[0]["rate"], stream[0]["total"]
            reach = signal.StreamResampler(origin, rate).half if origin != rate else 0
            a = max(0, int((start - at) * (origin / rate)) - reach)
            z = min(total, int((stop - at) * (origin / rate)) + reach + 2)
            x = np.zeros((max(0, z - a), channels))
            for r in stream:
                p, q = max(a, r["offset"]), min(z, r["offset"] + r["n"])
                if p < q:
                    frames = samples(r, p, q)
                    if frames.shape[1] != channels:
                        raise ValueError("files of several numbers of channels need a choice of channels")
                    x[p - a : q - a] = frames
            for c in range(channels):
                out[start - begin : stop - begin, c] = x[start - at - a : stop - at - a, c] if origin == rate else signal.resample_stretch(x[:, c], a, origin, rate, start - at, stop - at)
        return out

    def run(batches):
        piece, rows = None, []

        def made():
            x = rendered(piece["begin_us"], piece["end_us"], rows, width(piece[payload]))
            return _piece_batch([(piece["id"], piece["begin_us"], c, x[:, c]) for c in range(x.shape[1])])

        for batch in batches:
            columns = [batch.column(c).to_pylist() if c != "x" else arrays_of(batch.column(c)) for c in batch.schema.names]
            for row in (dict(zip(batch.schema.names, values)) for values in zip(*columns)):
                if row["at"] is not None:
                    rows.append(row)
                    continue
                if piece:
                    yield made()
                piece, rows = row, []
        if piece:
            yield made()

    return ready.mapInArrow(backends.travelling(run), PIECES)


def pieces_of_files(windows: DataFrame, files: DataFrame, chain: Chain, keys: list[str], width_us: int, chunk: int = CHUNK) -> DataFrame:
    """The samples of each window in pieces of ``chunk`` frames, as ``render`` gives them before it filters: channels picked, resampled, gaps as zeros.

    Each piece is read by seeking, where it is made: the frames of its stretch and those around it that resampling looks at, over the
    borders of files. Only what describes files and pieces is shuffled. ``files``: the keys, id, begin_us, end_us (overlap-free), path, rate, frames.
    """
    rate = chain.rate or one_rate(files)
    known = files.select(*keys, F.col("id").alias("file"), "path", F.col("rate").cast("double").alias("rate"), "frames")
    items = window_items(windows, files, keys, width_us).join(known, [*keys, "file"], "left")
    own = _streams(_with_frames(items, "file_us", F.col("frames")), rate)

    def samples(r: dict, p: int, q: int) -> np.ndarray:
        return chain.pick(backends.read(r["path"], r["first"] + p - r["offset"], r["first"] + q - r["offset"]))

    def width(path: str | None) -> int:
        return len(chain.channels) if chain.channels else backends.info(path).channels if path else 1

    return _in_chunks(windows, own, rate, "path", samples, width, chunk)


def pieces_of_tables(windows: DataFrame, recordings: DataFrame, chain: Chain, keys: list[str], width_us: int, spans: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """The same from a table of recordings of one channel, as ``signals_of_tables`` takes it. Recordings are cut before they are dealt, so
    that a task holds stretches of them only."""
    rate = chain.rate or one_rate(recordings)
    known = recordings.select(*keys, F.col("id").alias("file"), F.col("begin_us").alias("whole_us"), F.col("rate").cast("double").alias("rate"), F.size("x").cast("long").alias("frames"))
    items = window_items(windows, recordings if spans is None else spans, keys, width_us).join(known, [*keys, "file"])
    placed_items = _streams(_with_frames(items, "whole_us", F.col("frames")), rate).select(*keys, "file", "id", *FIELDS)
    parts = placed_items.join(recordings.select(*keys, F.col("id").alias("file"), "x"), [*keys, "file"]).where("n > 0")
    parts = parts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    size = F.least(F.lit(chunk), F.col("n") - F.col("_k") * chunk)
    cut = parts.withColumn("x", F.slice("x", (F.col("first") + F.col("_k") * chunk + 1).cast("int"), size.cast("int"))).withColumn("offset", F.col("offset") + F.col("_k") * chunk).withColumn("n", size)

    def samples(r: dict, p: int, q: int) -> np.ndarray:
        return chain.pick(r["x"][p - r["offset"] : q - r["offset"]][:, None])

    return _in_chunks(windows, cut, rate, "x", samples, lambda _: len(chain.channels) if chain.channels else 1, chunk)


def one_rate(files: DataFrame) -> float:
    rates = [r["rate"] for r in files.select("rate").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError("files of several rates need a rate")
    return float(rates[0]) if rates else 1.0


# --- filters and normalisation -----------------------------------------------------------------


def filter_pieces(pieces: DataFrame, sections: list[tuple[float, ...]]) -> DataFrame:
    """Each signal, filtered causally from silence at its begin."""
    sections = [tuple(s) for s in sections]
    wide = 2 * len(sections)
    names = ["id", "channel", "start", "n", "state"]

    def left_behind(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, c, s, len(x), signal.filter_run(x, sections)[1].ravel()) for i, s, c, x in _rows(batch)]
            if rows:
                ids, channels, starts, sizes, states = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(channels, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), lists_of(list(states))], names=names)

    schema = "id long, channel int, start long, n long, state array<double>"
    # one row a piece, ranged, so that a signal's states are carried inside ranges and from range to range
    held = placed(pieces.mapInArrow(left_behind, schema), ["id", "channel", "start"])
    step = signal.transition(sections)
    power = lambda n: np.linalg.matrix_power(step, n)

    def carried(whole: bool):
        """Along the pieces of each signal in a range: the states before each, or, ``whole``, what the range does as one piece."""

        def run(batches):
            import pyarrow as pa

            own, state, total, out = None, None, 0, []
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("id", "channel", "_part", "start", "n")]
                for i, c, part, start, n, left in zip(*columns, arrays_of(batch.column("state"))):
                    if own != (i, c, part):
                        if own and whole:
                            out.append((*own, own_start, total, state))
                        own, own_start, state, total = (i, c, part), start, np.zeros(wide), 0
                    if start < 0:  # what comes from the ranges before
                        state = left
                        continue
                    if not whole:
                        out.append((i, c, part, start, n, state))
                    state, total = power(n) @ state + left, total + n
            if own and whole:
                out.append((*own, own_start, total, state))
            if out:
                ids, channels, parts, starts, sizes, states = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(channels, pa.int32()), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), lists_of(list(states))], names=["id", "channel", "_part", "start", "n", "state"])

        return run

    ranged = "id long, channel int, _part int, start long, n long, state array<double>"
    dealt = lambda df, *by: df.select("id", "channel", "_part", "start", "n", "state").repartition(*by).sortWithinPartitions(*by, "start")
    by_range = dealt(held, "id", "channel", "_part").mapInArrow(carried(True), ranged)
    # a range is a piece of its own here, and its signal one range of ranges
    before = dealt(by_range.withColumn("start", F.col("_part").cast("long")).withColumn("_part", F.lit(0)), "id", "channel").mapInArrow(carried(False), ranged)
    opening = before.select("id", "channel", F.col("start").cast("int").alias("_part"), F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), "state")
    states = dealt(held.select("id", "channel", "_part", "start", "n", "state").unionByName(opening), "id", "channel", "_part").mapInArrow(carried(False), ranged)
    states = written(states.select("id", "channel", "start", "state"), "states")

    def filtered(batches):
        for batch in batches:
            rows = [(i, s, c, signal.filter_run(x, sections, state.reshape(-1, 2))[0]) for (i, s, c, x), state in zip(_rows(batch), arrays_of(batch.column("state")))]
            if rows:
                yield _piece_batch(rows)

    return pieces.join(states, ["id", "channel", "start"]).select("id", "start", "channel", "x", "state").mapInArrow(filtered, PIECES)


def normalization_of(pieces: DataFrame) -> DataFrame:
    """(id, channel, n, mean, low, high, std) of each signal: by piece, then over pieces, the deviations about the whole mean."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, c, len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()), float(x.min()), float(x.max())) for i, _, c, x in _rows(batch) if len(x)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "channel", "n", "m", "spread", "low", "high"])

    each = written(pieces.mapInArrow(run, "id long, channel int, n long, m double, spread double, low double, high double"), "sums")
    total = each.groupBy(*OWN).agg(F.sum("n").alias("total"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    away = F.col("m") - F.col("mean")
    spread = each.join(total, OWN).groupBy(*OWN, "total", "mean", "lowest", "highest").agg(F.sum(F.col("spread") + F.col("n") * away * away).alias("spread"))
    return spread.select(*OWN, F.col("total").alias("n"), "mean", F.col("lowest").alias("low"), F.col("highest").alias("high"), F.sqrt(F.col("spread") / F.col("total")).alias("std"))


def normalize_pieces(pieces: DataFrame, flags: int, gain: float = 1.0) -> DataFrame:
    """Each signal less its mean, then by its peak or deviation, as the flags say, and times ``gain``."""
    signal.check_normalization(flags)
    if flags == signal.RAW and gain == 1.0:
        return pieces
    shift, scale = F.lit(0.0), F.lit(1.0)
    if flags != signal.RAW:
        shift = F.col("mean") if flags & (signal.DC_REJECT | signal.ZSCORE) else shift
        scale = F.greatest(F.abs(F.col("high") - shift), F.abs(F.col("low") - shift)) if flags & signal.PEAK else F.col("std") if flags & signal.ZSCORE else scale
        pieces = pieces.join(written(normalization_of(pieces), "norms"), OWN, "left")
    ready = pieces.select("id", "start", "channel", "x", F.coalesce(shift, F.lit(0.0)).alias("shift"), F.coalesce(F.when(scale == 0, 1.0).otherwise(scale), F.lit(1.0)).alias("scale"))

    def run(batches):
        for batch in batches:
            rows = [(i, s, c, (x - a) / b * gain) for (i, s, c, x), a, b in zip(_rows(batch), batch.column("shift").to_pylist(), batch.column("scale").to_pylist())]
            if rows:
                yield _piece_batch(rows)

    return ready.mapInArrow(run, PIECES)


def chain_pieces(pieces: DataFrame, chain: Chain) -> DataFrame:
    """The steps of the read chain that need a whole window: filter, normalisation, calibration."""
    if chain.sections:
        pieces = filter_pieces(pieces, list(chain.sections))
    return normalize_pieces(pieces, chain.normalization, chain.instrument.pressure_per_unit if chain.instrument else 1.0)


def signals_in_pieces(windows: DataFrame, files: DataFrame, chain: Chain, keys: list[str], width_us: int, chunk: int = CHUNK, spans: DataFrame | None = None) -> DataFrame:
    """What ``signals_of_files`` gives, or of a table with samples ``signals_of_tables``, in pieces: windows of any length through the whole chain."""
    if "path" in files.columns:
        pieces = pieces_of_files(windows, files, chain, keys, width_us, chunk)
    else:
        pieces = pieces_of_tables(windows, files, chain, keys, width_us, spans, chunk)
    steps = bool(chain.sections) + (chain.normalization != signal.RAW)
    # several passes read the pieces again; written once, they are resampled once
    return chain_pieces(written(pieces, "pieces") if steps else pieces, chain)


# --- spectra -----------------------------------------------------------------------------------


def _framed(pieces: DataFrame, m: int, hop: int, first: int, padded: bool, kernel: Callable, schema: str, summed: bool = False) -> DataFrame:
    """Runs ``kernel(frames)``, which gives arrays of rows, on the frames of each signal: frame p covers samples p * hop + first and the ``m - 1`` after.

    ``schema``: id, channel, p and array columns. Frames inside a piece are taken there; of those that reach over a border the pieces' samples
    come together. ``padded``: frames that reach beyond the signal are filled with zeros, else there are none. ``summed``: rows are sums over the frames
    of a piece, and p is their number.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(ids, channels, places, arrays):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(channels, pa.int32()), pa.array(places, pa.int64()), *(lists_of(list(a)) for a in arrays)], names=names)

    def bounds(start: int, n: int) -> tuple[int, int, int, int]:
        """Frames that touch a piece, and those inside it."""
        touch = (start - m - first) // hop + 1, -(-(start + n - first) // hop)
        inside = -(-(start - first) // hop), (start + n - m - first) // hop + 1
        return *touch, *(inside if inside[1] > inside[0] else (touch[1], touch[1]))

    def inner(batches):
        for batch in batches:
            for i, start, c, x in _rows(batch):
                _, _, a, z = bounds(start, len(x))
                a = a if padded else max(a, 0)
                if len(x) and z > a:
                    found = kernel(np.lib.stride_tricks.sliding_window_view(x, m)[a * hop + first - start :: hop][: z - a])
                    if summed:
                        yield batch_of([i], [c], [z - a], [f.sum(axis=0, keepdims=True) for f in found])
                    else:
                        yield batch_of([i] * (z - a), [c] * (z - a), range(a, z), found)

    def parts(batches):
        import pyarrow as pa

        for batch in batches:
            rows, places = [], []
            for i, start, c, x in _rows(batch):
                low, high, a, z = bounds(start, len(x))
                for p in [*range(low, min(a, high)), *range(max(z, low), high)] if len(x) else []:
                    at = p * hop + first
                    if padded or at >= 0:
                        rows.append((i, max(start - at, 0), c, x[max(at - start, 0) : at + m - start]))
                        places.append(p)
            if rows:
                yield _piece_batch(rows).append_column("p", pa.array(places, pa.int64()))

    def joined(batches):
        own, frame, filled, out = None, None, 0, []

        def handed():
            keys, frames = zip(*out)
            out.clear()
            ids, channels, places = zip(*keys)
            return batch_of(ids, channels, [1] * len(ids) if summed else places, kernel(np.stack(frames)))

        for batch in batches:
            for (i, at, c, x), p in zip(_rows(batch), batch.column("p").to_pylist()):
                if own != (i, c, p):
                    if own and (padded or filled == m):
                        out.append((own, frame))
                    own, frame, filled = (i, c, p), np.zeros(m), 0
                frame[at : at + len(x)] = x
                filled += len(x)
            if len(out) * m >= CHUNK:
                yield handed()
        if own and (padded or filled == m):
            out.append((own, frame))
        if out:
            yield handed()

    borders = pieces.mapInArrow(parts, f"{PIECES}, p long").repartition("id", "channel", "p").sortWithinPartitions("id", "channel", "p", "start")
    return pieces.mapInArrow(inner, schema).unionByName(borders.mapInArrow(joined, schema))


SLICES = "id long, channel int, p long"


def stft_pieces(pieces: DataFrame, fft: Fft) -> DataFrame:
    """(id, channel, p, re, im): the slices of each signal, as ``stft_array`` gives them of the whole."""

    def kernel(frames):
        z = np.fft.rfft(frames * fft.scaled, fft.nfft)
        return z.real, z.imag

    return _framed(pieces, fft.m, fft.hop, -(fft.m // 2), True, kernel, f"{SLICES}, re array<double>, im array<double>")


def stft_power_pieces(pieces: DataFrame, fft: Fft) -> DataFrame:
    """(id, channel, p, power): squared magnitudes."""
    kernel = lambda frames: (np.abs(np.fft.rfft(frames * fft.scaled, fft.nfft)) ** 2,)
    return _framed(pieces, fft.m, fft.hop, -(fft.m // 2), True, kernel, f"{SLICES}, power array<double>")


def _mean_bins(rows: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """(by, k, value): the sums of the arrays ``power``, bin by bin, over the sum of the weights."""
    long = rows.select(*by, weight.alias("w"), F.posexplode("power").alias("k", "v"))
    return long.groupBy(*by, "k").agg((F.sum("v") / F.sum("w")).alias("value"))


def welch_pieces(pieces: DataFrame, fft: Fft, average: str = "mean", **options) -> DataFrame:
    """(id, channel, k, frequency, px): Welch's estimate of each signal, options as of ``spectral.welch``. For means each run of segments inside a piece
    is summed where it is, so that a piece is a row."""
    step, power = spectral.periodograms(fft, **options)
    frequency = (F.col("k") * fft.fs / fft.nfft).alias("frequency")
    each = _framed(pieces, fft.m, step, 0, False, lambda frames: (power(frames),), f"{SLICES}, power array<double>", average == "mean")
    bins = each.select(*OWN, "p", F.posexplode("power").alias("k", "power")).groupBy(*OWN, "k")
    if average == "mean":
        return bins.agg((F.sum("power") / F.sum("p")).alias("px")).select(*OWN, "k", frequency, "px")
    if average != "median":
        raise ValueError("average must be mean or median")
    medians = bins.agg(F.median("power").alias("px"), F.count("*").alias("n"))
    return medians.select(*OWN, "k", frequency, (F.col("px") / spectral.median_bias_of(F.col("n"))).alias("px"))


def ltas_pieces(pieces: DataFrame, fft: Fft, bins: int = 1920, part: int = PART) -> DataFrame:
    """(id, channel, p, power): long-term averages of each signal, as ``spectral.ltas`` gives them of the whole.

    A signal is cut again and again into ``bins`` parts, until a part has at most ``part`` samples or as few slices as bins; such a part
    comes together in a task, and counts in its bin by the share that the cuts give it.
    """
    whole = Fft(fft.win, fft.m, fft.fs, fft.mfft, fft.scale_to)
    first, _ = whole.slices(1)
    sizes = written(pieces.groupBy(*OWN).agg(F.max(F.col("start") + F.size("x")).alias("n")), "sizes")
    sized = pieces.join(sizes, OWN)
    few = F.floor((F.col("n") - 1 + whole.m // 2) / whole.hop) + 1 - first <= bins
    names = ["id", "channel", "p", "begin", "end", "share", "at", "x"]

    def leaves(a: int, z: int, share: float, p: int | None, start: int, stop: int):
        """(bin, begin, end, share) of the parts that samples [start, stop) are in."""
        n = z - a
        if p is not None and (n <= part or whole.n_slices(n) <= bins):
            yield p, a, z, share
            return
        for k in range(max(0, (start - a) * bins // n - 1), min(bins, (stop - a) * bins // n + 2)):
            b, e = a + n * k // bins, a + n * (k + 1) // bins
            if max(b, start) < min(e, stop):
                yield from leaves(b, e, share if p is None else share / bins, k if p is None else p, start, stop)

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for (i, start, c, x), n in zip(_rows(batch), batch.column("n").to_pylist()):
                for p, a, z, share in leaves(0, n, 1.0, None, start, start + len(x)):
                    out.append((i, c, p, a, z, share, max(start - a, 0), x[max(a - start, 0) : z - start]))
            if out:
                *columns, x = zip(*out)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), lists_of(list(x))], names=names)

    def averaged(batches):
        import pyarrow as pa

        own, x, out = None, None, []

        def close() -> None:
            found = spectral.ltas_array(x, whole, bins)
            if len(found):
                out.append((*own[:3], found.mean(axis=0) * own[5]))

        def handed():
            ids, channels, places, power = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(channels, pa.int32()), pa.array(places, pa.int32()), lists_of(list(power))], names=["id", "channel", "p", "power"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in names[:6]))
            for key, at, piece in zip(keys, batch.column("at").to_pylist(), arrays_of(batch.column("x"))):
                if own != key:
                    if own:
                        close()
                    own, x = key, np.zeros(key[4] - key[3])
                x[at : at + len(piece)] = piece
            if out:
                yield handed()
        if own:
            close()
        if out:
            yield handed()

    parts = sized.where(~few).mapInArrow(dealt, "id long, channel int, p int, begin long, end long, share double, at long, x array<double>")
    parts = parts.repartition("id", "channel", "p", "begin").sortWithinPartitions("id", "channel", "p", "begin", "at").mapInArrow(averaged, "id long, channel int, p int, power array<double>")
    summed = parts.select(*OWN, "p", F.posexplode("power").alias("k", "v")).groupBy(*OWN, "p", "k").agg(F.sum("v").alias("v"))
    long = summed.groupBy(*OWN, "p").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda b: b["v"]).alias("power"))
    short = stft_power_pieces(sized.where(few).select("id", "start", "channel", "x"), whole)
    return long.unionByName(short.withColumn("p", (F.col("p") - first).cast("int")))
