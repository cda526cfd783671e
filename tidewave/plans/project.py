"""Named transforms of a set of recordings, materialised as tables in one folder.

A project is a folder with a catalogue and one Parquet table per output. Preparing a
transform returns lazy frames; running it writes them. All paths go through Spark's file systems. The recordings are a table of
samples, or of files that are read by seeking where a window asks for them.

The catalogue is a log of numbered versions (JSON), each of which is created whole or not at all; a writer that finds its number taken merges again with
what is there now. Tables lie in folders of their own that only the catalogue names, and are written before it names them and deleted
after it has ceased to. So a writer that breaks off anywhere leaves the state before or after, no lock, and at most folders that
nothing names, which ``sweep`` deletes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from enum import IntFlag
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal, spectral
from ..functions.text import within
from ..operators import datasets, pieces, segments
from ..operators.signals import Chain, signals_of_files, signals_of_tables
from ..sources import spectra, wav
from .describe import spectrum_of


class Output(IntFlag):
    AUDIO = 1
    SPECTRUM = 2
    WELCH = 4
    SPECTROGRAM = 8


SPECTRAL = Output.SPECTRUM | Output.WELCH | Output.SPECTROGRAM
MODES = ("files", "timedelta_total", "timedelta_file", "whole")


@dataclass(frozen=True)
class Transform:
    """What to make: outputs, windows (mode files, timedelta_total, timedelta_file, or whole: one window over all), and
    signal steps. ``butterworth``: order, cut and kind; ``instrument``: the fields of an ``Instrument``; spectra are made of
    ``channel``, the first one by default. A sampling rate and that of the fft must be one."""

    name: str
    outputs: Output
    mode: str = "files"
    duration_us: int | None = None
    overlap: float = 0.0
    sample_rate: float | None = None
    normalization: int = signal.RAW
    fft: dict | None = None
    nb_ltas_time_bins: int | None = None
    channels: tuple[int, ...] | None = None
    channel: int = 0
    butterworth: dict | None = None
    instrument: dict | None = None
    db_ref: float | None = None
    detrend: bool = True
    tags: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name or "/" in self.name or self.name.startswith((".", "_")):
            raise ValueError("a name must be a plain folder name")
        if self.mode not in MODES:
            raise ValueError("unknown mode")
        if self.mode.startswith("timedelta"):
            segments.hop_us(self.duration_us or 0, self.overlap)
        signal.check_normalization(self.normalization)
        if self.outputs & SPECTRAL and not self.fft:
            raise ValueError("spectral outputs need an fft")
        if self.fft and self.sample_rate and self.sample_rate != self.fft["fs"]:
            raise ValueError("the sampling rates of transform and fft differ")

    def at_rate(self, rate: float) -> Transform:
        """The same at another rate; the fft follows."""
        return replace(self, sample_rate=rate, fft=self.fft and self.fft | {"fs": rate})

    def spec(self) -> spectral.Fft:
        return spectrum_of({"fft": self.fft})[1]

    def chain(self) -> Chain:
        """The read chain; the rate of the fft is that of the samples."""
        rate = self.sample_rate or (self.fft or {}).get("fs")
        b = self.butterworth
        if b and not rate:
            raise ValueError("a filter needs a sample_rate")
        sections = signal.butterworth_sections(b["order"], tuple(b["cut"]) if isinstance(b["cut"], (list, tuple)) else b["cut"], b["kind"], rate) if b else []
        return Chain(rate, self.channels, tuple(sections), self.normalization, signal.Instrument(**self.instrument) if self.instrument else None)


def windows_of(own: DataFrame, t: Transform) -> DataFrame:
    """(key, id, begin_us, end_us, ...): in mode files the id is the file's, else a hash of key and bounds."""
    own = own.select("key", "id", "begin_us", "end_us")
    if t.mode == "files":
        return segments.windows_files(own, "key")
    if t.mode == "whole":
        windows = datasets.single_window(segments.total_bounds(own, "key"))
    elif t.mode == "timedelta_total":
        windows = segments.windows_total(segments.total_bounds(own, "key"), t.duration_us, t.overlap)
    else:
        windows = segments.windows_file_anchored(own, "key", t.duration_us, t.overlap)
    return windows.withColumn("id", F.xxhash64("key", "begin_us", "end_us"))


def _sources_of(own: DataFrame, windows: DataFrame, t: Transform) -> tuple[DataFrame, DataFrame, int]:
    """Recordings with their rate, their stretches without overlaps (of files, with path, rate and frames), and a width for joins with windows."""
    derived = F.round((F.col("frames") if "path" in own.columns else F.size("x")) * 1_000_000 / (F.col("end_us") - F.col("begin_us")), 6)
    own = own.where(F.col("end_us") > F.col("begin_us")).withColumn("rate", F.coalesce(F.col("rate").cast("double"), derived) if "rate" in own.columns else derived)
    if t.chain().rate is None:
        datasets.require_one(own, "rate")
    spans = windows if t.mode == "files" else segments.windows_files(own.select("key", "id", "begin_us", "end_us"), "key")
    # of one window over all, the recordings are what the join's buckets should fit
    width = own.agg(F.coalesce(F.max(F.col("end_us") - F.col("begin_us")), F.lit(1))).first()[0] if t.mode in ("files", "whole") else t.duration_us
    if "path" in own.columns:
        spans = spans.select("key", "id", "begin_us", "end_us").join(own.select("key", "id", F.col("begin_us").alias("whole_us"), "path", "rate", "frames"), ["key", "id"])
    return own, spans, width


def signals_of(own: DataFrame, windows: DataFrame, t: Transform) -> DataFrame:
    """(id, channel, rate, x): the samples of each window, joined from the recordings without their overlaps through the
    read chain; what none covers is 0. ``own``: key, id, begin_us, end_us, and x (samples) or path, rate and frames."""
    own, spans, width = _sources_of(own, windows, t)
    if "path" in own.columns:
        return signals_of_files(windows, spans, t.chain(), ["key"], width)
    return signals_of_tables(windows, own, t.chain(), ["key"], width, spans)


def pieces_of(own: DataFrame, windows: DataFrame, t: Transform) -> DataFrame:
    """The same in pieces (id, start, channel, rate, x), for windows that no task shall hold."""
    own, spans, width = _sources_of(own, windows, t)
    chain = t.chain()
    chain = chain if chain.rate else replace(chain, rate=pieces.one_rate(own))
    files = spans if "path" in own.columns else own
    found = pieces.signals_in_pieces(windows, files, chain, ["key"], width, spans=spans)
    return found.select("id", "start", "channel", F.lit(chain.rate).alias("rate"), "x")


def outputs_of(own: DataFrame, t: Transform, share: list | None = None) -> dict[str, DataFrame]:
    """Lazy frames by kind of output; nothing is read but the sampling rates and the longest duration. In mode whole the samples stay in
    pieces, which a filter or normalisation reads more than once and so writes. ``share``: first and last (exclusive) of the windows, by begin."""
    windows = windows_of(own, t)
    if share:
        windows = datasets.take(windows, ["begin_us", "key", "id"], *share).select(*windows.columns)
    out = {"windows": windows}
    long = t.mode == "whole"
    signals = pieces_of(own, windows, t) if long else signals_of(own, windows, t)
    if t.outputs & Output.AUDIO:
        out["audio"] = signals
    if t.outputs & SPECTRAL:
        single = spectra.choose_channel(signals, t.channel) if t.channel else signals.where("channel = 0")
        bounds = windows.select("id", "begin_us", "end_us")
        if t.outputs & (Output.SPECTRUM | Output.SPECTROGRAM):
            kind, fft, bins = spectrum_of({"fft": t.fft, "nb_ltas_time_bins": t.nb_ltas_time_bins})
            if long:
                power = (pieces.ltas_pieces(single, fft, bins) if kind == "ltas" else pieces.stft_power_pieces(single, fft)).drop("channel")
            else:
                power = spectral.ltas(single, fft, bins) if kind == "ltas" else spectral.stft_power(single, fft)
            out["spectrum"] = spectra.with_axes(power, bounds)
        if t.outputs & Output.WELCH:
            px = pieces.welch_pieces(single, t.spec(), detrend=t.detrend).drop("channel") if long else spectral.welch(single, t.spec(), detrend=t.detrend)
            out["welch"] = px.join(bounds, "id")
    return out


def in_time(audio: DataFrame, windows: DataFrame) -> DataFrame:
    """An audio output with the bounds of its windows; each piece of a window counts as one of its own."""
    rest = windows.select("key", "id", "begin_us", "end_us")
    if "start" not in audio.columns:
        return audio.join(rest, "id")
    at = lambda frames: (F.col("whole_us") + F.bround(frames * 1_000_000 / F.col("rate"))).cast("long")
    own = audio.join(rest.withColumnRenamed("begin_us", "whole_us").drop("end_us"), "id")
    bounds = own.withColumn("begin_us", at(F.col("start"))).withColumn("end_us", at(F.col("start") + F.size("x")))
    return bounds.withColumn("id", F.xxhash64("id", "start")).drop("start", "whole_us")


class Project:
    """``spark``, a folder, and the frame of recordings (key, id, begin_us, end_us, x, rate)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _within(self, name: str) -> str:
        if not name or "/" in name or "\\" in name or name in (".", ".."):
            raise ValueError(f"{name!r} isn't a name inside the project")
        within(self.folder, name)
        return f"{self.folder}/{name}"

    def _versions(self) -> list[int]:
        fs, path = self._fs(f"{self.folder}/catalogue")
        names = [str(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _version(self, number: int) -> str:
        return f"{self.folder}/catalogue/{number:012d}.json"

    def catalogue(self) -> dict:
        """The latest version. It is never changed, so that it is read whole."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "outputs": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self._version(versions[-1]), wholetext=True).collect()))

    def _create(self, path: str, text: str) -> bool:
        """Creates a file in one step, by moving it into its place; false where another one is there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, beside = self._fs(f"{self.folder}/catalogue/.{uuid.uuid4().hex}.tmp")
        _, final = self._fs(path)
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 0)
        source, goal = fs.makeQualified(beside), fs.makeQualified(final)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, goal, never)
            return True
        except Exception:
            if not fs.exists(final):
                raise
            return False
        finally:
            fs.delete(beside, False)

    def commit(self, change: Callable[[dict], dict], tries: int = 100) -> dict:
        """Stores ``change(outputs)`` as the next version. Where another writer was first, it is applied to what that one stored, so it may run
        several times; what it raises ends the commit."""
        for _ in range(tries):
            held = self.catalogue()
            stored = {"version": held["version"] + 1, "outputs": change(dict(held["outputs"]))}
            if self._create(self._version(stored["version"]), json.dumps(stored, indent=4, sort_keys=True)):
                return stored
        raise TimeoutError(f"other writers were first {tries} times")

    def update(self, entries: dict, gone: tuple[str, ...] = ()) -> None:
        """Merges entries into the catalogue; entries that are stored already stay as they are."""
        self.commit(lambda outputs: entries | {k: v for k, v in outputs.items() if k not in gone})

    def _new_folder(self, name: str) -> str:
        self._within(name)
        return f"tables/{name}-{uuid.uuid4().hex}"

    def sweep(self) -> list[str]:
        """Deletes the folders of tables that no version names any more, and versions before the latest; to be run while nothing is written."""
        named = {p["folder"] for v in self.catalogue()["outputs"].values() for p in v["parts"]}
        fs, path = self._fs(f"{self.folder}/tables")
        gone = [f"tables/{f.getPath().getName()}" for f in fs.listStatus(path)] if fs.exists(path) else []
        gone = [g for g in gone if g not in named] + [f"catalogue/{n:012d}.json" for n in self._versions()[:-1]]
        for g in gone:
            fs.delete(self._fs(f"{self.folder}/{g}")[1], True)
        return gone

    def build(self, recordings: DataFrame) -> None:
        """From a table (key, id, begin_us, end_us, x, rate), or of files (path, rate, frames in place of x)."""
        folder = self._new_folder("original")
        recordings.write.parquet(f"{self.folder}/{folder}")

        def add(outputs: dict) -> dict:
            if "original" in outputs:
                raise ValueError("the project is built already")
            return outputs | {"original": {"transform": None, "kind": "recordings", "parts": [{"folder": folder}]}}

        self.commit(add)

    def build_from_folder(self, folder: str, templates: list[str] | None, **options) -> DataFrame:
        """Scans a folder, stores what describes its files (not their samples), and returns the files that were rejected."""
        good, bad = wav.recordings(self.spark, folder, templates, **options)
        if good.isEmpty():
            raise ValueError(f"no valid file in {folder!r}")
        rows = good.select(F.lit(0).cast("long").alias("key"), F.xxhash64("path").alias("id"), "begin_us", "end_us", "path", F.col("sample_rate").cast("double").alias("rate"), "frames", "channels")
        self.build(rows)
        return bad

    def build_from_files(self, paths: list[str], templates: list[str] | None, move: bool = False, **options) -> DataFrame:
        """Copies or moves files into the project's folder ``files`` and builds from it."""
        names = [p.rstrip("/").rpartition("/")[2] for p in paths]
        if len(set(names)) != len(names):
            raise ValueError("two files have one name")
        target = self._within("files")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path, name in zip(paths, names):
            (from_fs, source), (to_fs, goal) = self._fs(path), self._fs(f"{target}/{name}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, source, to_fs, goal, move, False, conf)
        return self.build_from_folder(target, templates, **options)

    def prepare(self, t: Transform, source: str = "original") -> dict[str, DataFrame]:
        """Lazy frames by kind of output; ``windows`` says what the ``id`` of the other outputs stands for; in mode files
        they are whole files without their overlaps. ``source``: the recordings, or an audio output."""
        return outputs_of(self.recordings(source), t)

    def recordings(self, name: str = "original") -> DataFrame:
        """The recordings, or an audio output as such (its first channel), so that a transform can start from it."""
        entry = self.catalogue()["outputs"].get(name)
        if entry is None:
            raise KeyError(name)
        own = self.load(name)
        if entry["kind"] == "recordings":
            return own
        if entry["kind"] != "audio":
            raise ValueError(f"{name!r} holds no samples")
        windows = self.load(f"{entry['transform']}_windows")
        return in_time(own.where("channel = 0"), windows).select("id", "rate", "x", "key", "begin_us", "end_us")

    def run(self, t: Transform, source: str = "original", partitions: int | None = None, first: int | None = None, last: int | None = None) -> list[str]:
        """Writes the outputs. A spectrum is computed once for itself and its spectrogram. ``partitions``: files of an output.

        With ``first`` and ``last`` it makes the windows [first, last) of the transform only, by begin, as one of several runs that
        share its outputs, at once or one after the other. A run whose windows are there already, or whose transform isn't that of the others, is
        refused: before anything is written, or at its commit.
        """
        share = None if first is None and last is None else [first or 0, last]
        frames = outputs_of(self.recordings(source), t, share)
        kinds = [k for k in frames if k != "spectrum" or t.outputs & Output.SPECTRUM] + (["spectrogram"] if t.outputs & Output.SPECTROGRAM else [])
        names = {kind: f"{t.name}_{kind}" for kind in kinds}
        described = json.loads(json.dumps({k: (int(v) if isinstance(v, Output) else v) for k, v in asdict(t).items()}))
        folders: dict[str, str] = {}

        def meets(a: list | None, b: list | None) -> bool:
            return a is None or b is None or ((a[1] is None or b[0] < a[1]) and (b[1] is None or a[0] < b[1]))

        def add(outputs: dict) -> dict:
            for kind, name in names.items():
                entry = outputs.get(name, {"transform": t.name, "kind": kind, "spec": described, "parts": []})
                if any(meets(p.get("share"), share) for p in entry["parts"]):
                    raise ValueError(f"already there: {name}")
                if entry["spec"] != described:
                    raise ValueError(f"{name} is of another transform")
                outputs[name] = entry | {"parts": entry["parts"] + ([{"folder": folders[kind], "share": share}] if kind in folders else [])}
            return outputs

        add(dict(self.catalogue()["outputs"]))

        def write(frame: DataFrame, kind: str) -> None:
            folder = self._new_folder(names[kind])
            (frame.repartition(partitions) if partitions else frame).write.parquet(f"{self.folder}/{folder}")
            folders[kind] = folder

        for kind, frame in frames.items():
            if kind in names:
                write(frame, kind)
        if "spectrogram" in names:
            own = self.spark.read.parquet(f"{self.folder}/{folders['spectrum']}") if "spectrum" in folders else frames["spectrum"]
            write(spectra.decibel_grid(own, t.db_ref, bool(t.instrument)), "spectrogram")
        self.commit(add)
        return list(names.values())

    def transform(self, name: str) -> Transform:
        """The transform that an output was made by."""
        spec = dict(self.catalogue()["outputs"][name]["spec"])
        spec["outputs"] = Output(spec["outputs"])
        spec["channels"] = tuple(spec["channels"]) if spec.get("channels") else None
        return Transform(**spec)

    def fft(self, name: str) -> spectral.Fft:
        """The transform of a stored spectrum."""
        return self.transform(name).spec()

    def export_audio(self, name: str, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
        """Writes [first, last) of an audio output, by time, as WAV files named by their begins; returns what was written."""
        windows = self.load(f"{self.catalogue()['outputs'][name]['transform']}_windows")
        samples = in_time(self.load(name), windows)
        own = datasets.take(samples.select("id", "begin_us").distinct(), ["begin_us", "id"], first, last)
        return wav.write(samples.select("id", "channel", "rate", "x").join(own, "id"), folder)

    def outputs(self, transform: str | None = None) -> list[str]:
        return [n for n, v in sorted(self.catalogue()["outputs"].items()) if transform in (None, v["transform"])]

    def transforms(self) -> set[str]:
        return {v["transform"] for v in self.catalogue()["outputs"].values() if v["transform"]}

    def load(self, name: str) -> DataFrame:
        """An output as far as it has been made."""
        entry = self.catalogue()["outputs"].get(name)
        if entry is None:
            raise KeyError(name)
        return self.spark.read.parquet(*[f"{self.folder}/{p['folder']}" for p in entry["parts"]])

    def _forget(self, chosen: Callable[[dict], bool]) -> None:
        """Takes entries out of the catalogue, and then deletes their tables."""
        folders: list[str] = []

        def change(outputs: dict) -> dict:
            gone = [n for n, v in outputs.items() if chosen(v)]
            folders[:] = [p["folder"] for n in gone for p in outputs[n]["parts"]]
            return {n: v for n, v in outputs.items() if n not in gone}

        self.commit(change)
        for folder in folders:
            fs, path = self._fs(f"{self.folder}/{folder}")
            fs.delete(path, True)

    def delete(self, transform: str) -> None:
        self._forget(lambda entry: entry["transform"] == transform)

    def rename(self, old: str, new: str) -> None:
        """Changes the catalogue only; tables stay where they are."""
        self._within(f"{new}_windows")

        def change(outputs: dict) -> dict:
            if any(v["transform"] == new for v in outputs.values()):
                raise ValueError(f"already there: {new}")
            return {(f"{new}_{v['kind']}" if v["transform"] == old else n): (v | {"transform": new} if v["transform"] == old else v) for n, v in outputs.items()}

        self.commit(change)

    def reset(self) -> None:
        """Deletes every output but the recordings, and what broken runs have left; a folder with files that aren't the project's is left alone."""
        fs, path = self._fs(self.folder)
        strange = [n for n in (str(f.getPath().getName()) for f in fs.listStatus(path)) if n not in ("catalogue", "tables", "files") and not n.startswith(".")]
        if strange:
            raise ValueError(f"not the project's: {strange}")
        self._forget(lambda entry: entry["transform"] is not None)
        self.sweep()


def flags(*names: str) -> Output:
    return reduce(or_, (Output[n.upper()] for n in names))
