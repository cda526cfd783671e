"""Spectra of sample arrays: STFT, Welch, long-term averages, split and merge, frequency scales.

The transforms are Arrow batch kernels on ``rfft`` over one row (one window of samples) at a time; what
comes after them (means, medians, decibels, gathers) is left to Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import arrays_of, lists_of

STFT_SCHEMA = "id long, p int, re array<double>, im array<double>"
POWER_SCHEMA = "id long, p int, power array<double>"


def hamming(n: int) -> np.ndarray:
    """The symmetric window 0.54 - 0.46 cos(2 pi k / (n - 1))."""
    return np.ones(1) if n == 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


@dataclass(frozen=True)
class Fft:
    """Window values, hop, sampling rate, transform length, and scaling (magnitude, psd or none)."""

    win: tuple[float, ...]
    hop: int
    fs: float
    mfft: int | None = None
    scale_to: str | None = None
    scaled: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.hop < 1 or not self.win or (self.mfft or len(self.win)) < len(self.win):
            raise ValueError("hop must be positive and mfft at least the window length")
        w = np.asarray(self.win, dtype=float)
        if self.scale_to == "magnitude":
            w = w / abs(w.sum())
        elif self.scale_to == "psd":
            w = w / np.sqrt(self.fs * (w**2).sum())
        elif self.scale_to is not None:
            raise ValueError("scale_to must be magnitude, psd or None")
        object.__setattr__(self, "scaled", w)

    @property
    def m(self) -> int:
        return len(self.win)

    @property
    def nfft(self) -> int:
        return self.mfft or self.m

    @property
    def frequencies(self) -> np.ndarray:
        return np.arange(self.nfft // 2 + 1) * self.fs / self.nfft

    def slices(self, n: int) -> tuple[int, int]:
        """First slice that touches sample 0, and one past the last that touches sample n - 1."""
        return (self.m // 2 - self.m) // self.hop + 1, (n - 1 + self.m // 2) // self.hop + 1 if n else 0

    def n_slices(self, n: int) -> int:
        low, high = self.slices(n)
        return max(0, high - low)

    def shape(self, n: int) -> tuple[int, int]:
        return len(self.frequencies), self.n_slices(n)

    def nbytes(self, n: int, complex_values: bool = True) -> int:
        rows, columns = self.shape(n)
        return rows * columns * (16 if complex_values else 8)


def stft_array(x: np.ndarray, fft: Fft) -> np.ndarray:
    """Slices by frequencies; slice p covers p * hop - m // 2 onward, with zeros outside the signal."""
    low, high = fft.slices(len(x))
    if high <= low:
        return np.empty((0, len(fft.frequencies)), dtype=complex)
    start = low * fft.hop - fft.m // 2
    stop = (high - 1) * fft.hop - fft.m // 2 + fft.m
    padded = np.concatenate([np.zeros(max(0, -start)), x[max(0, start) : max(0, stop)], np.zeros(max(0, stop - len(x)))])
    frames = np.lib.stride_tricks.sliding_window_view(padded, fft.m)[:: fft.hop][: high - low]
    return np.fft.rfft(frames * fft.scaled, fft.nfft)


def map_rows(df: DataFrame, kernel, schema: str, id_col: str, column: str) -> DataFrame:
    """Runs ``kernel(samples)``, which yields (p, *arrays) in the order of the schema after id, on each row; null samples count as none."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [(i, *r) for i, x in zip(batch.column(0).to_pylist(), arrays_of(batch.column(1))) for r in kernel(x)]
            if rows:
                ids, places, *values = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), *map(lists_of, values)], names=names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, schema)


def stft(df: DataFrame, fft: Fft, id_col: str = "id", column: str = "x") -> DataFrame:
    """(id, p, re, im): one row per slice."""

    def kernel(x):
        low, _ = fft.slices(len(x))
        for p, row in enumerate(stft_array(x, fft), low):
            yield p, row.real, row.imag

    return map_rows(df, kernel, STFT_SCHEMA, id_col, column)


def stft_power(df: DataFrame, fft: Fft, id_col: str = "id", column: str = "x") -> DataFrame:
    """(id, p, power): squared magnitudes."""

    def kernel(x):
        low, _ = fft.slices(len(x))
        for p, row in enumerate(np.abs(stft_array(x, fft)) ** 2, low):
            yield p, row

    return map_rows(df, kernel, POWER_SCHEMA, id_col, column)


def long_form(df: DataFrame, value: str = "power") -> DataFrame:
    """One row per frequency bin ``k``."""
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(value).alias("k", value))


def welch_segments(df: DataFrame, fft: Fft, noverlap: int | None = None, detrend=True, scaling: str = "density", id_col: str = "id", column: str = "x") -> DataFrame:
    """One-sided periodograms (id, p, power) of the overlapping segments.

    ``noverlap`` defaults to the hop, halved where that is the whole window. ``detrend``: whether the mean of a segment
    is subtracted, ``"constant"`` or ``"linear"``, or a function of the segments (rows of an array).
    """
    step, power = periodograms(fft, noverlap, detrend, scaling)

    def kernel(x):
        if len(x) >= fft.m:
            yield from enumerate(power(np.lib.stride_tricks.sliding_window_view(x, fft.m)[::step]))

    return map_rows(df, kernel, POWER_SCHEMA, id_col, column)


def periodograms(fft: Fft, noverlap: int | None = None, detrend=True, scaling: str = "density"):
    """From segment to segment, and the function that gives the one-sided periodogram of each row of segments."""
    kinds = {True: "constant", False: None}
    trend = detrend if callable(detrend) else kinds.get(detrend, detrend)
    if not callable(trend) and trend not in (None, "constant", "linear"):
        raise ValueError("detrend must be a truth value, constant, linear or a function")
    if scaling not in ("density", "spectrum"):
        raise ValueError("scaling must be density or spectrum")
    w = np.asarray(fft.win, dtype=float)
    lap = fft.hop if noverlap is None else noverlap
    lap = lap // 2 if lap >= fft.m else lap
    norm = 1 / (fft.fs * (w**2).sum()) if scaling == "density" else 1 / w.sum() ** 2
    double = np.full(fft.nfft // 2 + 1, 2.0)
    double[0] = 1
    if fft.nfft % 2 == 0:
        double[-1] = 1

    def power(frames: np.ndarray) -> np.ndarray:
        if callable(trend):
            frames = trend(frames)
        elif trend:
            frames = frames - frames.mean(axis=1, keepdims=True)
            if trend == "linear":
                slope = np.arange(fft.m) - (fft.m - 1) / 2
                frames = frames - np.outer(frames @ slope / max((slope**2).sum(), 1e-300), slope)
        return np.abs(np.fft.rfft(frames * w, fft.nfft)) ** 2 * norm * double

    return fft.m - lap, power


def median_bias(n: int) -> float:
    """Expected median of n exponential values over their mean."""
    even = 2.0 * np.arange(1, (n - 1) // 2 + 1)
    return float(1 + (1 / (even + 1) - 1 / even).sum())


def median_bias_of(n: Column) -> Column:
    """``median_bias`` of a column."""
    odd = F.sequence(F.lit(1), F.floor((n - 1) / 2))
    return 1 + F.when(n > 2, F.aggregate(odd, F.lit(0.0), lambda s, i: s + 1 / (2 * i + 1) - 1 / (2 * i))).otherwise(0.0)


def welch(df: DataFrame, fft: Fft, average: str = "mean", **options) -> DataFrame:
    """(id, k, frequency, px): the mean, or bias-corrected median, of the segments."""
    bins = long_form(welch_segments(df, fft, **options))
    frequency = (F.col("k") * fft.fs / fft.nfft).alias("frequency")
    if average == "mean":
        return bins.groupBy("id", "k").agg(F.avg("power").alias("px")).select("id", "k", frequency, "px")
    if average != "median":
        raise ValueError("average must be mean or median")
    return bins.groupBy("id", "k").agg(F.median("power").alias("px"), F.count("*").alias("n")).select("id", "k", frequency, (F.col("px") / median_bias_of(F.col("n"))).alias("px"))


def ltas_array(x: np.ndarray, fft: Fft, bins: int) -> np.ndarray:
    if fft.n_slices(len(x)) <= bins:
        return np.abs(stft_array(x, fft)) ** 2
    cuts = len(x) * np.arange(bins + 1) // bins
    parts = [ltas_array(x[a:b], fft, bins) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.array([p.mean(axis=0) if len(p) else np.zeros(len(fft.frequencies)) for p in parts])


def ltas(df: DataFrame, fft: Fft, bins: int = 1920, id_col: str = "id", column: str = "x") -> DataFrame:
    """Long-term averages (id, p, power): at most ``bins`` columns of mean spectra, hop as long as the window."""
    whole = Fft(fft.win, fft.m, fft.fs, fft.mfft, fft.scale_to)

    def kernel(x):
        yield from enumerate(ltas_array(x, whole, bins))

    return map_rows(df, kernel, POWER_SCHEMA, id_col, column)


def split_stft(df: DataFrame, fft: Fft, parts: int, id_col: str = "id", column: str = "x") -> DataFrame:
    """The STFT of ``parts`` pieces cut at multiples of the hop; slices at a border appear in both
    neighbours and sum to those of the whole (``merge_stft``)."""

    def kernel(x):
        cuts = [min(len(x), round(k * len(x) / parts / fft.hop) * fft.hop) for k in range(parts)] + [len(x)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, _ = fft.slices(b - a)
            for p, row in enumerate(stft_array(x[a:b], fft), low + a // fft.hop):
                yield p, row.real, row.imag

    return map_rows(df, kernel, STFT_SCHEMA, id_col, column)


def merge_stft(parts: DataFrame) -> DataFrame:
    """(id, p, k, power) after adding the bins of slices that lie at borders."""
    both = parts.select("id", "p", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    summed = both.groupBy("id", "p", "k").agg(F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    return summed.select("id", "p", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


@dataclass(frozen=True)
class ScalePart:
    """A stretch [p_min, p_max] of the axis that shows [f_min, f_max], lin or log."""

    p_min: float
    p_max: float
    f_min: float
    f_max: float
    scale_type: str = "lin"

    def __post_init__(self) -> None:
        if not (0 <= self.p_min < self.p_max <= 1 and 0 <= self.f_min < self.f_max) or self.scale_type not in ("lin", "log"):
            raise ValueError("bounds must be ordered, shares in [0, 1], and the type lin or log")
        if self.scale_type == "log" and self.f_min <= 0:
            raise ValueError("a log part needs a positive f_min")

    def values(self, length: int) -> np.ndarray:
        n = int(self.p_max * length) - int(self.p_min * length)
        space = np.linspace if self.scale_type == "lin" else np.geomspace
        return space(self.f_min, self.f_max, n)


@dataclass(frozen=True)
class Scale:
    parts: tuple[ScalePart, ...]

    def map(self, length: int) -> np.ndarray:
        ordered = sorted(self.parts, key=lambda s: (s.p_min, s.p_max))
        return np.concatenate([s.values(length) for s in ordered])

    def indexes(self, frequencies: np.ndarray) -> list[int]:
        """The nearest original bin of each point; the lower one of two as near."""
        points = self.map(len(frequencies))
        return [int(np.argmin(np.abs(frequencies - f))) for f in points]

    def rescale(self, power: Column, frequencies: np.ndarray) -> Column:
        return F.array(*[F.get(power, F.lit(i)) for i in self.indexes(frequencies)])


def nearest_index(value: Column, grid: list[float]) -> Column:
    """Index of the nearest value of a sorted grid; the lower one of two as near."""
    array = F.array(*[F.lit(float(g)) for g in grid])
    scored = F.transform(array, lambda g, i: F.struct(F.abs(g - value).alias("d"), i.alias("i")))
    return F.array_min(scored)["i"]
