"""Sample arithmetic: normalisation, calibration, decibels, filters, resampling.

Columns hold one window per row with its samples as ARRAY<DOUBLE>; arrays stay inside the JVM but
for resampling, which is an Arrow batch kernel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW, DC_REJECT, PEAK, ZSCORE = 1, 2, 4, 8
TINY = 5e-324
PRESSURE_REFERENCE = 1e-6


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def std_pop(x: Column) -> Column:
    return let(x, lambda a: let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a))))


def normalization_values(x: Column) -> Column:
    """The values that normalisation divides by or subtracts, by name."""
    return F.create_map(F.lit("mean"), mean(x), F.lit("peak"), peak(x), F.lit("std"), std_pop(x))


def _nonzero(d: Column) -> Column:
    return F.when(d == 0, 1.0).otherwise(d)


def check_normalization(flags: int) -> int:
    if flags not in (RAW, DC_REJECT, PEAK, ZSCORE, DC_REJECT | PEAK, DC_REJECT | ZSCORE):
        raise ValueError("normalization must be one flag, or DC_REJECT and one other")
    return flags


def normalize(df: DataFrame, flags: int, column: str = "x") -> DataFrame:
    """Subtracts the mean, then divides by the peak or standardises, as the flags say."""
    check_normalization(flags)
    x = F.col(column)
    if flags & (DC_REJECT | ZSCORE):
        x = let(x, lambda a: let(mean(a), lambda m: F.transform(a, lambda v: v - m)))
    if flags & PEAK:
        x = let(x, lambda a: let(_nonzero(peak(a)), lambda d: F.transform(a, lambda v: v / d)))
    if flags & ZSCORE:
        x = let(x, lambda a: let(_nonzero(std_pop(a)), lambda d: F.transform(a, lambda v: v / d)))
    return df.withColumn(column, x)


@dataclass(frozen=True)
class Instrument:
    """A recording chain: V per Pa, peak voltage, gain; or its end-to-end level."""

    sensitivity: float = 1.0
    peak_voltage: float = 1.0
    gain_db: float = 0.0
    end_to_end_db: float | None = None

    @property
    def gain(self) -> float:
        return 10 ** (self.gain_db / 20)

    @property
    def pressure_per_unit(self) -> float:
        if self.end_to_end_db is not None:
            return 10 ** (self.end_to_end_db / 20) * PRESSURE_REFERENCE
        return self.peak_voltage / (self.sensitivity * self.gain)

    @property
    def level_db(self) -> float:
        return 20 * math.log10(self.pressure_per_unit / PRESSURE_REFERENCE)

    def pressure(self, n: Column) -> Column:
        return n * F.lit(self.pressure_per_unit)


def decibels(power: Column, reference: float | Column = 1.0) -> Column:
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    return 10 * F.log10(power + F.lit(TINY)) - 20 * F.log10(ref)


def reference_level(explicit: Column, instrument: Column) -> tuple[Column, Column]:
    """The dB reference and its kind: an explicit one, the pressure reference of an instrument, or full scale."""
    ref = F.when(explicit.isNotNull(), explicit).when(instrument, PRESSURE_REFERENCE).otherwise(1.0)
    kind = F.when(explicit.isNotNull(), "SPL_parameter").when(instrument, "SPL_instrument").otherwise("FS")
    return ref, kind


def default_limits(kind: str) -> tuple[float, float]:
    """The range of levels that is shown by default: below full scale, or above the pressure reference."""
    return (-120.0, 0.0) if kind == "FS" else (0.0, 170.0)


def limits(kind: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """(low, high): those given, else the default ones of the kind of reference."""
    full = kind == "FS"
    lowest, highest = F.when(full, F.lit(default_limits("FS")[0])).otherwise(F.lit(default_limits("SPL")[0])), F.when(full, F.lit(default_limits("FS")[1])).otherwise(F.lit(default_limits("SPL")[1]))
    return F.struct(F.coalesce(low, lowest).alias("low") if low is not None else lowest.alias("low"), F.coalesce(high, highest).alias("high") if high is not None else highest.alias("high"))


def butterworth_sections(order: int, cut: float | tuple[float, float], kind: str, rate: float) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth filter.

    Poles of the analogue prototype on the unit circle, moved to the wanted band with pre-warped
    edges, and mapped by the bilinear transform. ``kind``: lowpass, highpass, bandpass, bandstop.
    """
    if order < 1:
        raise ValueError("order must be positive")
    edges = np.atleast_1d(np.asarray(cut, dtype=float))
    if not (np.all(edges > 0) and np.all(edges < rate / 2)):
        raise ValueError("edges must lie between 0 and half the rate")
    warped = 2 * rate * np.tan(np.pi * edges / rate)
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    if kind == "lowpass":
        p, z = poles * warped[0], np.empty(0, complex)
    elif kind == "highpass":
        p, z = warped[0] / poles, np.zeros(order, complex)
    elif kind in ("bandpass", "bandstop") and len(edges) == 2:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2 if kind == "bandpass" else width / 2 / poles
        root = np.sqrt(half**2 - centre**2 + 0j)
        p = np.concatenate([half + root, half - root])
        z = np.zeros(order, complex) if kind == "bandpass" else np.tile([1j * centre, -1j * centre], order)
    else:
        raise ValueError("kind and edges do not fit")
    move = lambda s: (2 * rate + s) / (2 * rate - s)
    zd, pd = move(z), move(p)
    zd = np.concatenate([zd, -np.ones(len(pd) - len(zd))])
    # unit gain where the band lies: at 0, at half the rate, or at the band's centre
    at = {"lowpass": 0.0, "bandstop": 0.0, "highpass": np.pi}.get(kind, 2 * np.arctan(np.sqrt(np.prod(warped)) / (2 * rate)))
    e = np.exp(1j * at)
    gain = abs(np.prod(e - pd) / np.prod(e - zd))

    def pairs(roots: np.ndarray) -> list[np.ndarray]:
        """Conjugates together, then real ones two by two."""
        up = sorted((r for r in roots if r.imag > 1e-9), key=lambda r: abs(r))
        real = sorted(r.real for r in roots if abs(r.imag) <= 1e-9)
        return [np.array([r, np.conj(r)]) for r in up] + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]

    sections = []
    for zs, ps in zip(pairs(zd), pairs(pd), strict=True):
        b, a = np.poly(zs).real, np.poly(ps).real
        b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
        sections.append((b[0], b[1], b[2], a[1], a[2]))
    b0, b1, b2, a1, a2 = sections[0]
    sections[0] = (b0 * gain, b1 * gain, b2 * gain, a1, a2)
    return [tuple(float(v) for v in s) for s in sections]


def arrays_of(column) -> list[np.ndarray]:
    """The samples of each row of an Arrow list column, as views of its values; null samples count as none."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def lists_of(rows: list[np.ndarray]):
    """An Arrow list column of samples, without a Python number for each."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0), *rows])))


def _section_run(x: np.ndarray, section: tuple[float, ...], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section (transposed direct form) from a state on, in time linear in the length: the output and the state behind it.

    The signal is cut into about sqrt(n) blocks. All blocks are filtered side by side from a zero state; then the state
    is carried from block to block, and what it adds to each block is its free response. The rest is less than a block.
    """
    b0, b1, b2, a1, a2 = section
    size = max(1, int(np.sqrt(len(x))))
    blocks = len(x) // size
    cut = x[: size * blocks].reshape(blocks, size).T.copy()
    out = np.empty_like(cut)
    p, q = np.zeros(blocks), np.zeros(blocks)
    for t in range(size):
        v = cut[t]
        y = b0 * v + p
        p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
        out[t] = y
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    free, power = np.empty((size, 2)), np.eye(2)
    for t in range(size):
        free[t] = power[0]
        power = step @ power
    states = np.empty((2, blocks))
    for k in range(blocks):
        states[:, k] = state
        state = power @ state + (p[k], q[k])
    out += free @ states
    rest = np.empty(len(x) - size * blocks)
    p, q = state
    for t, v in enumerate(x[size * blocks :]):
        y = rest[t] = b0 * v + p
        p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
    return np.concatenate([out.T.ravel(), rest]), np.array([p, q])


def filter_run(x: np.ndarray, sections, states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filtering by second-order sections from ``states`` (sections by two, zeros by default): the output, and the states behind it."""
    states = np.zeros((len(sections), 2)) if states is None else states
    x, after = np.asarray(x, dtype=float), np.empty((len(sections), 2))
    for k, section in enumerate(sections):
        x, after[k] = _section_run(x, section, states[k])
    return x, after


def transition(sections) -> np.ndarray:
    """The matrix by which one sample of silence moves the states of a filter, laid end to end."""
    n = 2 * len(sections)
    return np.stack([filter_run(np.zeros(1), sections, row.reshape(-1, 2))[1].ravel() for row in np.eye(n)], axis=1)


def filter_array(x: np.ndarray, sections) -> np.ndarray:
    """Causal filtering by second-order sections from a zero start."""
    return filter_run(x, sections)[0] if len(x) else x


def _each(df: DataFrame, kernel, id_col: str, column: str) -> DataFrame:
    """(id, x) with ``kernel`` applied to the samples of each row; null samples count as none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of([kernel(x) for x in arrays_of(batch.column(1))])], names=["id", "x"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "id long, x array<double>")


def filter_sections(df: DataFrame, sections: list[tuple[float, ...]], id_col: str = "id", column: str = "x") -> DataFrame:
    """(id, x) filtered row by row, each from a zero start."""
    return _each(df, lambda x: filter_array(x, sections), id_col, column)


def normalize_array(x: np.ndarray, flags: int) -> np.ndarray:
    """As ``normalize``, of one array."""
    check_normalization(flags)
    if not len(x):
        return x
    if flags & (DC_REJECT | ZSCORE):
        x = x - x.mean()
    if flags & PEAK:
        x = x / (np.abs(x).max() or 1.0)
    if flags & ZSCORE:
        x = x / (x.std() or 1.0)
    return x


#: Cells of the weights that resampling holds at once.
RESAMPLE_CELLS = 4_000_000


class StreamResampler:
    """Band-limited interpolation with a Hann-windowed sinc, piece by piece: ``push`` gives the samples that the pieces so
    far decide, ``finish`` the rest, round(n * target / origin) in all. What is held does not grow with the stream."""

    def __init__(self, origin: float, target: float):
        if origin <= 0 or target <= 0:
            raise ValueError("rates must be positive")
        self.origin, self.target = origin, target
        self.band = min(1.0, target / origin)
        self.half = int(np.ceil(16 / self.band))
        self.held, self.base, self.total, self.done = np.empty(0), 0, 0, 0

    def _at(self, stop: int) -> np.ndarray:
        """Samples up to ``stop``; beyond the pieces so far the signal is 0."""
        out = np.empty(max(0, stop - self.done))
        block = max(1, RESAMPLE_CELLS // (2 * self.half))
        for low in range(self.done, stop, block):
            at = np.arange(low, min(stop, low + block)) * (self.origin / self.target)
            near = np.floor(at).astype(int)[:, None] + np.arange(-self.half + 1, self.half + 1)
            away = at[:, None] - near
            weight = self.band * np.sinc(self.band * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / self.half, -1, 1)))
            own = np.clip(near - self.base, 0, max(0, len(self.held) - 1))
            inside = (near >= self.base) & (near < self.base + len(self.held))
            out[low - self.done : low - self.done + len(at)] = (np.where(inside, self.held[own], 0) * weight).sum(axis=1) if len(self.held) else 0
        self.done = max(self.done, stop)
        return out

    def push(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        self.total += len(x)
        if self.origin == self.target:
            return x.copy()
        self.held = np.concatenate([self.held, x])
        out = self._at(int(np.ceil((self.total - self.half) * self.target / self.origin)))
        kept = max(self.base, int(self.done * (self.origin / self.target)) - self.half)
        self.held, self.base = self.held[kept - self.base :], kept
        return out

    def finish(self) -> np.ndarray:
        return np.empty(0) if self.origin == self.target else self._at(int(round(self.total * self.target / self.origin)))


def resample_stretch(x: np.ndarray, base: int, origin: float, target: float, start: int, stop: int) -> np.ndarray:
    """Samples [start, stop) of a signal at another rate, from its samples ``x``, the first of which is its ``base``-th; beyond ``x`` it is 0."""
    stream = StreamResampler(origin, target)
    stream.held, stream.base, stream.done = np.asarray(x, dtype=float), base, start
    return stream._at(stop)


def resample_array(x: np.ndarray, origin: float, target: float) -> np.ndarray:
    """A whole signal at another rate: round(n * target / origin) samples."""
    stream = StreamResampler(origin, target)
    return np.concatenate([stream.push(x), stream.finish()])


def resample_pieces(df: DataFrame, origin: float, target: float, piece: int = 8_192, id_col: str = "id", column: str = "x") -> DataFrame:
    """(id, x) as ``resample`` gives it, each row streamed in pieces of ``piece`` samples."""

    def kernel(x: np.ndarray) -> np.ndarray:
        stream = StreamResampler(origin, target)
        return np.concatenate([*[stream.push(x[at : at + piece]) for at in range(0, len(x), piece)], stream.finish()])

    return _each(df, kernel, id_col, column)


def resample(df: DataFrame, origin: float, target: float, id_col: str = "id", column: str = "x") -> DataFrame:
    """(id, x) at the target rate; each row is one stretch, resampled whole."""
    return _each(df, lambda x: resample_array(x, origin, target), id_col, column)
