"""Audio files as tables: metadata, samples by frame range, and a WAV writer.

Spark lists the files; headers and frames are read by seeking, through the backend of the file's suffix (WAV here:
uncompressed PCM of 8, 16, 24 and 32 bit, IEEE float of 32 and 64 bit; ``backends.register`` adds others).
"""

from __future__ import annotations

import datetime
import io
import re
import struct
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_absolute
from ..functions.timestamps import localize, parse
from ..operators.ranges import running_sum_before, written
from . import backends

META = "path string, sample_rate int, channels int, frames long, error string"
SAMPLES = "path string, channel int, start long, x array<double>"


def frames(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Frames by channels of a WAV in memory, as float64 in [-1, 1); bounds are checked as in a seek."""
    file, own = io.BytesIO(data), backends.Wav()
    total = own.info(file).frames
    stop = total if stop is None else stop
    if not (0 <= start <= stop <= total):
        raise ValueError("frames out of bounds")
    return own.read(file, start, stop)


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 64-bit float WAV of frames by channels."""
    x = np.atleast_2d(np.asarray(x, dtype="<f8"))
    body = x.tobytes()
    fmt = struct.pack("<HHIIHH", 3, x.shape[1], rate, rate * x.shape[1] * 8, x.shape[1] * 8, 64)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the files of a folder that some backend reads, in any case of the suffix; their contents are not read."""
    known = "|".join(re.escape(x) for x in backends.suffixes())
    return spark.read.format("binaryFile").load(folder).select("path").where(F.col("path").rlike(f"(?i)(?:{known})$"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Header fields of each audio file of a folder; files that can't be read have ``error`` set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    own = backends.info(path)
                    out.append((path, own.rate, own.channels, own.frames, None if own.frames else "no frames"))
                except (ValueError, OSError, struct.error) as e:
                    out.append((path, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "sample_rate", "channels", "frames", "error"])

    return _files(spark, folder).mapInArrow(backends.travelling(run), META)


def recordings(spark: SparkSession, folder: str, templates: list[str] | None, first_us: int = 1_577_836_800_000_000, zone: str | None = None, begin_us: int | None = None, end_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(recordings, rejects). A file begins at the time in its name, a local time of ``zone`` where one is given; without
    templates each begins where the one before it (by path) ends, the first at ``first_us``. Only files that
    reach into [begin_us, end_us) are returned."""
    meta = scan(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    duration = F.bround(F.col("frames") * 1_000_000 / F.col("sample_rate")).cast("long")
    good = meta.where("error is null").withColumn("duration_us", duration)
    if templates:
        stamp = parse(name, templates)
        stamp = localize(stamp, zone) if zone else stamp
        stamped = good.withColumn("begin_us", F.unix_micros(stamp.cast("timestamp")))
        late = stamped.where("begin_us is null").select("path", F.lit("no time stamp in the name").alias("error"))
        ready, bad = stamped.where("begin_us is not null"), meta.where("error is not null").select("path", "error").unionByName(late)
    else:
        ready = running_sum_before(good.withColumn("_all", F.lit(0)), "_all", ["path"], "duration_us", "begin_us").withColumn("begin_us", F.col("begin_us") + F.lit(first_us)).drop("_all")
        bad = meta.where("error is not null").select("path", "error")
    ready = ready.withColumn("end_us", F.col("begin_us") + F.col("duration_us")).drop("error")
    if begin_us is not None:
        ready = ready.where(F.col("end_us") > begin_us)
    return (ready if end_us is None else ready.where(F.col("begin_us") < end_us)), bad


def read_windows(spark: SparkSession, folder: str, windows: DataFrame) -> DataFrame:
    """Samples (path, channel, start, x) of frames [start, stop) of files; ``windows`` has path (whole, or relative to the
    folder), start, stop. Only these frames are read."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                x = backends.read(path if is_absolute(path) else f"{folder.rstrip('/')}/{path}", start, stop)
                n = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array([start] * n, pa.int64()), pa.array(list(x.T), pa.list_(pa.float64()))], names=["path", "channel", "start", "x"])

    return windows.select("path", "start", "stop").mapInArrow(backends.travelling(run), SAMPLES)


def gap_filled(items: DataFrame, length: Column, key: list[str]) -> DataFrame:
    """(key, x): one array per window of ``length`` frames; items (offset, x) are put at their offsets,
    what none covers is 0. Items must not overlap."""
    parts = items.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("offset", "x"))).alias("parts"), F.first(length).alias("n"))

    def add(s: Column, p: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), F.greatest(p["offset"] - F.size(s), F.lit(0)).cast("int"))
        return F.concat(s, gap, p["x"])

    filled = F.aggregate("parts", F.array().cast("array<double>"), add)
    rest = F.array_repeat(F.lit(0.0), F.greatest(F.col("n") - F.size("x"), F.lit(0)).cast("int"))
    return parts.withColumn("x", filled).select(*key, F.slice(F.concat("x", rest), F.lit(1), F.col("n").cast("int")).alias("x"))


def write(samples: DataFrame, folder: str) -> DataFrame:
    """Writes each window of ``samples`` (id, channel, rate, x, begin_us) as a WAV file of 64-bit floats, named by its begin
    (UTC) and, where several begin alike, its id; returns (path, frames). Tasks write beside and rename, so a
    task that runs twice leaves one whole file."""

    def run(key, rows):
        import pyarrow as pa

        held = sorted(rows.to_pylist(), key=lambda r: r["channel"])
        x = np.array([r["x"] for r in held], dtype=float).T
        begin = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=held[0]["begin_us"])
        system, inner = backends.location(folder)
        system.create_dir(inner, recursive=True)
        path = f"{inner}/{begin:%Y_%m_%d_%H_%M_%S_%f}" + (f"_{held[0]['id']}" if held[0]["alike"] > 1 else "") + ".wav"
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(beside) as out:
            out.write(encode(x, round(held[0]["rate"])))
        system.move(beside, path)
        return pa.Table.from_arrays([pa.array([path]), pa.array([len(x)], pa.int64())], names=["path", "frames"])

    alike = samples.select("id", "begin_us").distinct().groupBy("begin_us").agg(F.count("*").alias("alike"))
    named = samples.select("id", "channel", "rate", "x", "begin_us").join(alike, "begin_us")
    return written(named.groupBy("id").applyInArrow(run, "path string, frames long"), "wav")


def synthetic(spark: SparkSession, files: int, samples: int, kind: str = "sine", frequency: float = 1000.0, rate: int = 48_000, magnitude: float = 1.0) -> DataFrame:
    """(id, x): ``files`` signals of ``samples`` values: repeat (a ramp each), increase, sine or noise."""
    n = F.sequence(F.lit(0), F.lit(samples - 1))
    ramp = lambda i, low, high: low + (high - low) * i / max(1, samples - 1)
    values = {
        "repeat": F.transform(n, lambda i: ramp(i, 0.0, 1.0) * magnitude),
        "increase": F.transform(n, lambda i: (F.col("id") * samples + i) / F.lit(float(files * samples)) * magnitude),
        "sine": F.transform(n, lambda i: F.lit(magnitude) * F.sin(F.lit(2 * np.pi * frequency / rate) * (F.col("id") * samples + i))),
        # sums of twelve uniform hashes are close to normal and the same on every run
        "noise": F.transform(n, lambda i: (F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda s, k: s + F.pmod(F.xxhash64(F.col("id"), i, k), F.lit(1 << 30)) / float(1 << 30)) - 6.0) * magnitude),
    }
    if kind not in values:
        raise ValueError("kind must be repeat, increase, sine or noise")
    return spark.range(files).select("id", values[kind].alias("x"))
