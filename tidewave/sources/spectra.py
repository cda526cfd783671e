"""Stored spectra: rows of slices with their times, read by time, put together from pieces with gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal
from ..functions.spectral import Fft


def with_axes(power: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds the window's begin_us and end_us and the slice's ``time_us`` to rows (id, p, ...): slice i of n
    of a window begins at i n-ths of its duration. ``windows``: id, begin_us, end_us."""
    sizes = power.groupBy("id").agg(F.min("p").alias("_first"), F.count("*").alias("_n"))
    own = power.join(sizes.join(windows.select("id", "begin_us", "end_us"), "id"), "id")
    time = F.col("begin_us") + F.floor((F.col("p") - F.col("_first")) * (F.col("end_us") - F.col("begin_us")) / F.col("_n"))
    return own.withColumn("time_us", time.cast("long")).drop("_first", "_n")


def frequencies(fft: Fft) -> Column:
    return F.array(*[F.lit(float(f)) for f in fft.frequencies])


#: What a folder of one stretch of a stored spectrum holds, by default.
STRETCH_US = 3_600_000_000


def store(spectra: DataFrame, folder: str, stretch_us: int = STRETCH_US) -> None:
    """Writes rows with ``time_us`` by stretches of time, each a folder, sorted by time inside its files: a slice then opens the folders of
    its stretches, and in these the row groups of its times. A stretch with very many rows is several files."""
    if stretch_us < 1:
        raise ValueError("a stretch must be positive")
    ranged = spectra.withColumns({"stretch_us": F.lit(stretch_us).cast("long"), "from_us": F.floor(F.col("time_us") / stretch_us) * stretch_us}).repartitionByRange("from_us", "time_us")
    ranged.sortWithinPartitions("from_us", "time_us").write.mode("append").partitionBy("stretch_us", "from_us").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Spectra that ``store`` has written, however many sets of them: rows of slices, with what they hold (powers, or complex values)."""
    found = spark.read.parquet(folder)
    if not {"time_us", "stretch_us", "from_us"} <= set(found.columns) or not ({"power"} <= set(found.columns) or {"re", "im"} <= set(found.columns)):
        raise ValueError(f"{folder!r} holds no stored spectra")
    return found


def time_slice(spectra: DataFrame, begin_us: int, end_us: int) -> DataFrame:
    """The slices that begin at or after ``begin_us`` and before ``end_us``; both bounds reach the Parquet scan. Of stored spectra only the stretches that
    may hold them are opened."""
    cut = spectra.where((F.col("time_us") >= begin_us) & (F.col("time_us") < end_us))
    if {"stretch_us", "from_us"} <= set(spectra.columns):
        cut = cut.where((F.col("from_us") < end_us) & (F.col("from_us") + F.col("stretch_us") > begin_us)).drop("stretch_us", "from_us")
    return cut


def time_resolution(begin_us: Column, end_us: Column, slices: Column) -> Column:
    """Seconds from slice to slice."""
    return (end_us - begin_us) / slices / 1e6


def decibel_grid(spectra: DataFrame, db_ref: float | None = None, instrument: bool = False, value: str = "power") -> DataFrame:
    """(id, p, k, db, reference): the levels of a spectrogram, one row per cell."""
    reference, kind = signal.reference_level(F.lit(db_ref).cast("double"), F.lit(instrument))
    rest = [c for c in spectra.columns if c != value]
    cells = spectra.select(*rest, F.posexplode(value).alias("k", "_v"))
    return cells.select(*rest, "k", signal.decibels(F.col("_v"), reference).alias("db"), kind.alias("reference"))


def stitch(items: DataFrame, pieces: DataFrame) -> DataFrame:
    """One spectrum from stored pieces: (id, ``slice``, ``time_us``, power), slices in order of time.

    ``items``: id, begin_us, end_us, piece (null: a gap), as ``window_items`` gives them; ``pieces``: piece, time_us, step_us, power.
    A gap holds as many slices of zeros as fit. Pieces of several resolutions in time or numbers of frequencies are refused.
    """
    shape = pieces.select("step_us", F.size("power").alias("bins")).distinct().limit(2).collect()
    if len(shape) > 1:
        raise ValueError("the pieces differ in their resolution")
    step, bins = (shape[0]["step_us"], shape[0]["bins"]) if shape else (1, 0)
    held = items.where("piece is not null").join(pieces, "piece").where((F.col("time_us") >= F.col("begin_us")) & (F.col("time_us") < F.col("end_us"))).select("id", "time_us", "power")
    n = F.bround((F.col("end_us") - F.col("begin_us")) / step).cast("long")
    gaps = items.where("piece is null").withColumn("i", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    empty = gaps.select("id", (F.col("begin_us") + F.col("i") * step).alias("time_us"), F.array_repeat(F.lit(0.0), bins).alias("power"))
    return held.unionByName(empty).withColumn("slice", F.row_number().over(W.partitionBy("id").orderBy("time_us")) - 1).select("id", "slice", "time_us", "power")


def as_power(spectra: DataFrame) -> DataFrame:
    """Power from complex slices (re, im); a spectrum of powers stays as it is, as complex values can't be had from it."""
    if "power" in spectra.columns:
        return spectra
    if not {"re", "im"} <= set(spectra.columns):
        raise TypeError("neither complex values nor powers")
    rest = [c for c in spectra.columns if c not in ("re", "im")]
    return spectra.select(*rest, F.zip_with("re", "im", lambda a, b: a * a + b * b).alias("power"))


def as_complex(spectra: DataFrame) -> DataFrame:
    if not {"re", "im"} <= set(spectra.columns):
        raise TypeError("complex values can't be had from powers")
    return spectra


def trim(spectra: DataFrame, audio: DataFrame, begin_us: int, end_us: int) -> tuple[DataFrame, DataFrame]:
    """Spectra and the audio that they are linked to, both cut to the bounds; neither can grow."""
    keep = lambda df: df.where((F.col("end_us") >= begin_us) & (F.col("begin_us") < end_us)).withColumn("begin_us", F.greatest("begin_us", F.lit(begin_us))).withColumn("end_us", F.least("end_us", F.lit(end_us)))
    return keep(spectra), keep(audio)


def choose_channel(audio: DataFrame, channel: int) -> DataFrame:
    """The rows (id, channel, ...) of the channel that a spectrum is made of; one that no data has is refused."""
    own = audio.where(F.col("channel") == channel)
    if own.isEmpty() and not audio.isEmpty():
        raise ValueError(f"no data has a channel {channel}")
    return own
