"""Formats registered on the driver are read where the data is."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import signals
from tidewave.sources import backends, datasource, wav


def text_backend():
    """A format of its own, defined here so that it has to travel as it is: a rate, then one sample a line."""

    class Lines:
        suffixes = (".lines",)

        def _values(self, file):
            file.seek(0)
            return [float(v) for v in io.BytesIO(file.read()).read().split()]

        def info(self, file):
            values = self._values(file)
            return (lambda rate, frames: __import__("tidewave.sources.backends", fromlist=["Info"]).Info(rate, frames, 1))(int(values[0]), len(values) - 1)

        def read(self, file, start, stop):
            return np.array(self._values(file)[1:][start:stop], dtype=float)[:, None]

    return Lines()


@pytest.fixture
def lines(tmp_path):
    (tmp_path / "a.lines").write_text("8\n" + "\n".join(map(str, range(16))))
    (tmp_path / "b.LINES").write_text("8\n" + "\n".join(str(100 + k) for k in range(16)))
    (tmp_path / "c.wav").write_bytes(wav.encode(np.full((8, 1), 0.5), 8))
    (tmp_path / "notes.txt").write_text("no audio")
    before = backends.known()
    backends.register(text_backend())
    yield tmp_path
    backends._KNOWN.clear()
    backends.adopt(before)


def test_scan_and_windows_use_a_registered_backend(spark, lines):
    meta = {r["path"].rsplit("/", 1)[1]: (r["sample_rate"], r["frames"], r["error"]) for r in wav.scan(spark, str(lines)).collect()}
    assert meta == {"a.lines": (8, 16, None), "b.LINES": (8, 16, None), "c.wav": (8, 8, None)}
    cut = spark.createDataFrame([("a.lines", 2, 5), ("b.LINES", 0, 2)], "path string, start long, stop long")
    assert {r["path"]: r["x"] for r in wav.read_windows(spark, str(lines), cut).collect()} == {"a.lines": [2.0, 3.0, 4.0], "b.LINES": [100.0, 101.0]}


def test_chains_use_a_registered_backend(spark, lines):
    second = 1_000_000
    files = spark.createDataFrame([(1, 1, 0, 2 * second, f"{lines}/a.lines", 8, 16), (1, 2, 2 * second, 4 * second, f"{lines}/b.LINES", 8, 16)], "key int, id long, begin_us long, end_us long, path string, rate int, frames long")
    window = spark.createDataFrame([(1, 9, second, 3 * second)], "key int, id long, begin_us long, end_us long")
    wanted = [*map(float, range(8, 16)), *(100.0 + k for k in range(8))]
    assert signals.signals_of_files(window, files, signals.Chain(), ["key"], second).first()["x"] == wanted
    pieces = signals.stream_of_files(window, files, signals.Chain(rate=8.0), ["key"], second, chunk=5).collect()
    assert [v for r in sorted(pieces, key=lambda r: r["start"]) for v in r["x"]] == wanted


def test_data_source_uses_a_registered_backend(spark, lines):
    datasource.register(spark)
    read = spark.read.format("recordings").option("chunk", 5).load(str(lines))
    assert {r["path"].rsplit("/", 1)[1]: r["n"] for r in read.groupBy("path").agg(F.sum(F.size("x")).alias("n")).collect()} == {"a.lines": 16, "b.LINES": 16, "c.wav": 8}


def test_backends_by_name():
    found = backends.named("tidewave.sources.backends:Wav, ")
    assert list(found) == [".wav"] and backends.named("") == {}


def test_data_source_on_folders_without_files(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "readme.txt").write_text("nothing here")
    found = spark.read.format("recordings").option("backends", "tidewave.sources.backends:Wav").load(str(tmp_path))
    assert found.count() == 0 and found.columns == ["path", "rate", "channel", "start", "x"]
