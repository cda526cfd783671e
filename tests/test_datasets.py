"""Sets of data, windows of files, the read chain, stored spectra, catalogue and command line."""

import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import signal, spectral, text, timestamps
from tidewave.operators import datasets, detections, ranges, signals, timeline
from tidewave.plans import describe, export
from tidewave.plans.project import Output, Project, Transform
from tidewave.sources import backends, datasource, spectra, wav

SECOND = 1_000_000


@pytest.fixture
def folder(tmp_path):
    """Two channels at 480 Hz: seconds 0, 1, 2, a gap, and second 4 at 240 Hz."""
    (tmp_path / "in").mkdir()
    for k, rate in ((0, 480), (1, 480), (2, 480), (4, 240)):
        x = np.stack([np.full(rate, k + 1.0), -np.arange(rate) / rate], axis=1)
        (tmp_path / "in" / f"a_2024_01_01_00_00_0{k}.wav").write_bytes(wav.encode(x, rate))
    (tmp_path / "in" / "b.wav").write_bytes(b"RIFF....")
    (tmp_path / "in" / "notes.txt").write_text("no audio")
    return f"{tmp_path}/in"


# --- files ---


def test_backends_seek(folder):
    path = f"{folder}/a_2024_01_01_00_00_01.wav"
    assert backends.info(path) == (480, 480, 2)
    assert np.allclose(backends.read(path, 10, 14), [[2, -n / 480] for n in range(10, 14)])
    assert [len(x) for x in backends.stream(path, 5, 480, 200)] == [200, 200, 75]
    for start, stop in ((-1, 3), (480, 480), (5, 481), (9, 4)):
        with pytest.raises(ValueError):
            backends.read(path, start, stop)
    with pytest.raises(ValueError):
        backends.backend_for("x.flac")


@pytest.mark.parametrize("width, kind", [(1, 1), (2, 1), (3, 1), (4, 1), (4, 3), (8, 3)])
def test_sample_formats(width, kind):
    whole = np.array([0, 1, -1, 5, -7])
    if kind == 3:
        raw = whole.astype(f"<f{width}").tobytes()
    elif width == 1:
        raw = (whole + 128).astype(np.uint8).tobytes()
    else:
        raw = b"".join(int(v).to_bytes(width, "little", signed=True) for v in whole)
    scale = 1 if kind == 3 else 1 << (8 * width - 1)
    assert np.allclose(backends.decode(raw, kind, width), whole / scale)


def test_registered_backend(tmp_path):
    class Text:
        suffixes = (".num",)

        def info(self, file):
            return backends.Info(1, len(file.read().split()), 1)

        def read(self, file, start, stop):
            file.seek(0)
            return np.array(file.read().split()[start:stop], dtype=float)[:, None]

    backends.register(Text())
    (tmp_path / "a.NUM").write_text("1 2 3 4")
    assert backends.read(f"{tmp_path}/a.NUM", 1, 3).ravel().tolist() == [2, 3]
    del backends._KNOWN[".num"]


def test_data_source(spark, folder):
    datasource.register(spark)
    frame = spark.read.format("recordings").option("chunk", 100).option("bytes", 3000).option("channels", "1").load(f"{folder}/a_2024_01_01_00_00_00.wav")
    rows = frame.orderBy("start").collect()
    assert frame.rdd.getNumPartitions() > 1 and {r["channel"] for r in rows} == {1}
    assert np.allclose(np.concatenate([r["x"] for r in rows]), -np.arange(480) / 480)
    with pytest.raises(Exception, match="channels"):
        spark.read.format("recordings").option("channels", "5").load(f"{folder}/a_2024_01_01_00_00_00.wav").count()


def test_scan_bounds_zone_and_rejects(spark, folder):
    form = ["%Y_%m_%d_%H_%M_%S"]
    good, bad = wav.recordings(spark, folder, form, begin_us=0)
    assert good.count() == 4 and [r["path"][-5:] for r in bad.collect()] == ["b.wav"]
    utc = good.agg(F.min("begin_us")).first()[0]
    paris = wav.recordings(spark, folder, form, zone="Europe/Paris")[0].agg(F.min("begin_us")).first()[0]
    assert utc - paris == 3600 * SECOND
    assert wav.recordings(spark, folder, form, begin_us=utc + SECOND, end_us=utc + 2 * SECOND)[0].count() == 1


def test_window_of_files_through_the_chain(spark, folder):
    """A window over files, a gap and another rate; channels chosen, resampled, calibrated."""
    files = wav.recordings(spark, folder, ["%Y_%m_%d_%H_%M_%S"])[0]
    files = files.select(F.lit(0).alias("key"), F.xxhash64("path").alias("id"), "begin_us", "end_us", "path", F.col("sample_rate").alias("rate"), "frames")
    t0 = files.agg(F.min("begin_us")).first()[0]
    windows = spark.createDataFrame([(0, 1, t0 + SECOND // 2, t0 + 5 * SECOND + SECOND // 2), (0, 2, t0 + 90 * SECOND, t0 + 91 * SECOND)], "key int, id long, begin_us long, end_us long")
    chain = signals.Chain(480.0, (0,), instrument=signal.Instrument(peak_voltage=2.0))
    got = {r["id"]: np.array(r["x"]) for r in signals.signals_of_files(windows, files, chain, ["key"], SECOND).collect()}
    assert len(got[1]) == 2400 and not got[2].any() and len(got[2]) == 480
    x = got[1] / 2
    assert np.allclose(x[:240], 1) and np.allclose(x[240:720], 2) and np.allclose(x[720:1200], 3) and not x[1200:1680].any()
    assert x[1800:2100].mean() == pytest.approx(5, rel=0.01) and not x[2160:].any()
    with pytest.raises(Exception, match="several rates"):
        signals.signals_of_files(windows, files, signals.Chain(), ["key"], SECOND).collect()
    with pytest.raises(Exception, match="channels only"):
        signals.signals_of_files(windows, files, signals.Chain(480.0, (2,)), ["key"], SECOND).collect()


def test_stream_is_resampled_across_items():
    """Two items of one rate give what their join gives; a gap between them parts the stream."""
    x = np.sin(np.arange(128) / 5)
    items = [(0, SECOND, 64.0, x[:64, None]), (SECOND, 2 * SECOND, 64.0, x[64:, None])]
    assert np.allclose(signals.render(0, 2 * SECOND, items, signals.Chain(48.0))[0], signal.resample_array(x, 64, 48))
    apart = [items[0], (2 * SECOND, 3 * SECOND, 64.0, x[64:, None])]
    got = signals.render(0, 3 * SECOND, apart, signals.Chain(48.0))[0]
    assert not got[48:96].any() and np.allclose(got[96:], signal.resample_array(x[64:], 64, 48))


@pytest.mark.parametrize("origin, target, piece", [(64, 48, 10), (64, 48, 1), (48_000, 480, 777), (480, 48_000, 50), (64, 64, 7)])
def test_pieces_give_what_the_whole_gives(origin, target, piece):
    x = np.random.default_rng(5).normal(size=3_001)
    stream = signal.StreamResampler(origin, target)
    got = np.concatenate([*[stream.push(x[a : a + piece]) for a in range(0, len(x), piece)], stream.finish()])
    assert len(stream.held) <= 2 * stream.half + piece + 2
    assert np.allclose(got, signal.resample_array(x, origin, target))


def test_windows_as_streams(spark, folder):
    """A stream of a window gives what the window gives, in pieces."""
    files = wav.recordings(spark, folder, ["%Y_%m_%d_%H_%M_%S"])[0]
    files = files.select(F.lit(0).alias("key"), F.xxhash64("path").alias("id"), "begin_us", "end_us", "path", F.col("sample_rate").alias("rate"), "frames")
    t0 = files.agg(F.min("begin_us")).first()[0]
    windows = spark.createDataFrame([(0, 1, t0 + SECOND // 2, t0 + 5 * SECOND + SECOND // 2), (0, 2, t0 + 90 * SECOND, t0 + 91 * SECOND)], "key int, id long, begin_us long, end_us long")
    chain = signals.Chain(300.0, (0, 1))
    whole = {(r["id"], r["channel"]): r["x"] for r in signals.signals_of_files(windows, files, chain, ["key"], SECOND).collect()}
    rows = signals.stream_of_files(windows, files, chain, ["key"], SECOND, 100).collect()
    assert max(len(r["x"]) for r in rows) <= 160
    for (i, c), x in whole.items():
        own = sorted((r["start"], r["x"]) for r in rows if (r["id"], r["channel"]) == (i, c))
        got = np.concatenate([p for _, p in own]) if own else np.zeros(0)
        if i == 2:
            assert c == 0 or not len(x) or not np.any(x)
        assert [s for s, _ in own] == [0, *np.cumsum([len(p) for _, p in own])[:-1]] and np.allclose(got, x if i == 1 else np.zeros(len(got)))
    assert {len(x) for (i, _), x in whole.items() if i == 1} == {1500}
    with pytest.raises(ValueError):
        signals.stream_of_files(windows, files, signals.Chain(300.0, normalization=signal.PEAK), ["key"], SECOND)


def test_written_files_read_back(spark, tmp_path):
    rows = [(1, 0, 8.0, [0.1, 0.2], 0), (1, 1, 8.0, [0.3, 0.4], 0), (2, 0, 8.0, [0.5], 0), (3, 0, 8.0, [0.6], 7)]
    done = wav.write(spark.createDataFrame(rows, "id long, channel int, rate double, x array<double>, begin_us long"), f"{tmp_path}/out").collect()
    names = sorted(r["path"].rpartition("/")[2] for r in done)
    assert names == ["1970_01_01_00_00_00_000000_1.wav", "1970_01_01_00_00_00_000000_2.wav", "1970_01_01_00_00_00_000007.wav"]
    assert np.allclose(backends.read(f"{tmp_path}/out/{names[0]}"), [[0.1, 0.3], [0.2, 0.4]])


# --- filters and folds of long inputs ---


def test_filter_in_blocks_equals_the_recursion():
    x = np.random.default_rng(3).normal(size=1003)
    sections = signal.butterworth_sections(5, (6.0, 12.0), "bandpass", 64.0)
    want = x.copy()
    for b0, b1, b2, a1, a2 in sections:
        p = q = 0.0
        for i, v in enumerate(want):
            y = b0 * v + p
            p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
            want[i] = y
    assert np.allclose(signal.filter_array(x, sections), want)
    assert len(signal.filter_array(np.random.default_rng(1).normal(size=480_000), sections)) == 480_000


def test_strong_downsampling_keeps_memory_bounded(monkeypatch):
    monkeypatch.setattr(signal, "RESAMPLE_CELLS", 50_000)
    assert len(signal.resample_array(np.ones(200_000), 48_000, 480)) == 2_000


def test_one_island_of_many_events(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("station"), "id", (F.col("id") * 10).alias("begin_us"), (F.col("id") * 10 + 15).alias("end_us"))
    kept = timeline.remove_overlaps(rows, "station")
    assert kept.count() == n and kept.where("end_us - begin_us = 10").count() == n - 1
    assert timeline.fill_gaps(kept, "station").count() == 0


def test_carries_cross_buckets(spark):
    rows = [(1, i, b, b + 5) for i, b in enumerate(range(0, 400, 10))] + [(2, 90, 3, 4)]
    own = spark.createDataFrame(rows, "station long, id long, begin_us long, end_us long")
    gaps = timeline.next_after(own, "station", "begin_us", "n", 37).where("n is not null").select("begin_us", "n").collect()
    assert sorted(map(tuple, gaps)) == [(b, b + 10) for b in range(0, 390, 10)]
    left = spark.createDataFrame([(1, k, k) for k in range(0, 450, 7)] + [(2, 1, 2), (2, 2, 900)], "station long, id long, at_us long")
    right = own.select("station", F.col("begin_us").alias("at_us"), F.col("id").alias("v"))
    got = {(r["station"], r["id"]): r["v"] for r in timeline.asof_backward(left, right, "station", "v", 37).collect()}
    assert got == {(1, k): min(k // 10, 39) for k in range(0, 450, 7)} | {(2, 1): None, (2, 2): 90}
    sums = ranges.running_sum_before(own, "station", ["id"], "begin_us", "s").where("station = 1").orderBy("id").select("s").collect()
    assert [r[0] for r in sums] == np.cumsum([0, *range(0, 390, 10)]).tolist()
    fills = timeline.fill_gaps(own, "station", label="none").first()
    assert fills["label"] == "none" and fills["id"] is None


def test_join_by_key_and_id(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 0, 10)], "station long, id long, begin_us long, end_us long")
    hits = spark.createDataFrame([(2, 9, 5, 6)], "station long, id long, begin_us long, end_us long")
    assert [r["station"] for r in timeline.interval_join(rows, hits, ["station"], 4, "left_semi").collect()] == [2]
    assert [r["station"] for r in timeline.interval_join(rows, hits, ["station"], 4, "left_anti").collect()] == [1]


# --- sets of data ---


def test_sets(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 8.0), (3, None, 8.0), (4, "b", 4.0)], "id long, kind string, rate double")
    assert [r["id"] for r in datasets.take(rows, ["id"], -2).orderBy("id").collect()] == [3, 4]
    assert [r["id"] for r in datasets.take(rows, ["id"], 1, -1).orderBy("id").collect()] == [2, 3]
    with pytest.raises(ValueError):
        datasets.require_one(rows, "rate")
    assert datasets.require_one(rows.where("id > 1 and id < 4"), "rate") == 8.0
    with pytest.raises(ValueError):
        datasets.drop_empty(rows, F.col("rate"), 1.5)
    kept, removed = datasets.drop_empty(rows, F.col("rate") / 10, 0.4)
    assert kept.count() == 2 and removed.count() == 2
    assert datasets.equal(rows, rows.orderBy(F.desc("id"))) and not datasets.equal(rows, rows.limit(3))
    assert datasets.with_parameters(rows, rate=1.0).agg(F.sum("rate")).first()[0] == 4


def test_written_slice_has_its_names_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, name string")
    datasets.write_slice(rows, f"{tmp_path}/ok", ["id"], last=2)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 2
    with pytest.raises(ValueError, match="'b'"):
        datasets.write_slice(rows, f"{tmp_path}/no", ["id"])


def test_neighbours_cross_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("key"), "id").repartition(7)
    got = {r["id"]: (r["previous"], r["next"], r["place"]) for r in ranges.neighbours(rows, "key", ["id"], "id").collect()}
    assert got == {i: (i - 2 if i > 1 else None, i + 2 if i < 498 else None, i // 2) for i in range(500)}


def test_invalid_detections_are_told(spark):
    raw = spark.createDataFrame([("9", "5", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:09+00:00")], "min_frequency string, max_frequency string, start_datetime string, end_datetime string")
    with pytest.raises(ValueError, match="not a valid detection"):
        detections.require_valid(detections.parse(raw))
    assert detections.require_valid(detections.parse(raw.withColumn("max_frequency", F.lit("10")))).count() == 1


def test_link_refuses_what_has_no_audio(spark):
    data = spark.createDataFrame([(0, 1, 8.0), (1, 2, 8.0)], "begin_us long, end_us long, rate double")
    audio = spark.createDataFrame([(0, 1, 8.0, 5), (1, 2, 8.0, 6)], "begin_us long, end_us long, rate double, id long")
    assert sorted(r["audio_id"] for r in datasets.link(data, audio, rate="rate").collect()) == [5, 6]
    with pytest.raises(ValueError, match="no audio"):
        datasets.link(data, audio.where("id = 5"))
    with pytest.raises(ValueError, match="rates"):
        datasets.link(data, audio.withColumn("rate", F.lit(4.0)), rate="rate")


def test_windows_without_files(spark):
    none = spark.createDataFrame([], "key long, id long, begin_us long, end_us long")
    own = spark.createDataFrame([(1, 5, 0, 10)], "key long, id long, begin_us long, end_us long")
    rows = signals.window_items(own, none, ["key"], 10).collect()
    assert [(r["begin_us"], r["end_us"], r["file"]) for r in rows] == [(0, 10, None)]
    assert signals.window_items(none, own, ["key"], 10).count() == 0


# --- stored spectra ---


def test_spectra_guards(spark):
    z = spark.createDataFrame([(1, 0, [3.0], [4.0])], "id long, p int, re array<double>, im array<double>")
    assert spectra.as_power(z).first()["power"] == [25.0]
    with pytest.raises(TypeError):
        spectra.as_complex(spectra.as_power(z))
    pieces = spark.createDataFrame([(1, 0, 5, [1.0]), (2, 0, 6, [1.0])], "piece long, time_us long, step_us long, power array<double>")
    items = spark.createDataFrame([(1, 0, 10, 1)], "id long, begin_us long, end_us long, piece long")
    with pytest.raises(ValueError, match="resolution"):
        spectra.stitch(items, pieces)
    audio = spark.createDataFrame([(1, 0)], "id long, channel int")
    with pytest.raises(ValueError, match="channel"):
        spectra.choose_channel(audio, 3)
    both = spark.createDataFrame([(1, 0, 10), (2, 10, 20)], "id long, begin_us long, end_us long")
    assert [tuple(r) for part in spectra.trim(both, both, 5, 10) for r in part.orderBy("id").collect()] == [(1, 5, 10)] * 2


def test_detrend_kinds(spark):
    x = np.linspace(0, 5, 64) + np.sin(np.arange(64))
    df = spark.createDataFrame([(1, x.tolist())], "id long, x array<double>")
    fft = spectral.Fft(tuple(spectral.hamming(16)), 8, 64.0)
    px = {d: spectral.welch(df, fft, detrend=d).where("k = 0").first()["px"] for d in (False, "constant", "linear")}
    assert px[False] > 100 * px["constant"] and px["linear"] < px["constant"]
    with pytest.raises(ValueError):
        spectral.welch(df, fft, detrend="cubic")


# --- projects ---


FFT = {"win": spectral.hamming(16).tolist(), "hop": 8, "fs": 64.0}


def test_project_from_a_folder(spark, folder, tmp_path):
    project = Project(spark, f"file://{tmp_path}/p")
    assert project.build_from_folder(folder, ["%Y_%m_%d_%H_%M_%S"]).count() == 1
    with pytest.raises(ValueError):
        Project(spark, f"file://{tmp_path}/q").build_from_folder(folder, ["%H:%M"])
    t = Transform("low", Output.AUDIO | Output.SPECTRUM | Output.SPECTROGRAM, mode="timedelta_total", duration_us=2 * SECOND, sample_rate=64.0, fft=FFT, butterworth={"order": 2, "cut": 20.0, "kind": "lowpass"}, instrument={"end_to_end_db": 120.0}, channel=1)
    assert sorted(project.run(t)) == ["low_audio", "low_spectrogram", "low_spectrum", "low_windows"]
    audio = project.load("low_audio")
    assert audio.count() == 6 and {len(r["x"]) for r in audio.collect()} == {128}
    grid, power = project.load("low_spectrogram"), project.load("low_spectrum")
    assert grid.count() == 9 * power.count() and {r[0] for r in grid.select("reference").distinct().collect()} == {"SPL_instrument"}
    assert project.transform("low_spectrum") == t and project.fft("low_spectrum") == t.spec()
    first = project.export_audio("low_audio", f"{tmp_path}/wavs", 0, 2).collect()
    assert sorted(r["path"].rpartition("/")[2] for r in first) == ["2024_01_01_00_00_00_000000.wav", "2024_01_01_00_00_02_000000.wav"]
    project.run(Transform("again", Output.WELCH, mode="whole", fft=FFT), source="low_audio")
    assert project.load("again_welch").count() == 9
    with pytest.raises(ValueError, match="no samples"):
        project.recordings("low_spectrum")
    (tmp_path / "p" / "mine.txt").write_text("keep")
    with pytest.raises(ValueError, match="not the project's"):
        project.reset()


def test_project_from_copied_files(spark, folder, tmp_path):
    project = Project(spark, f"file://{tmp_path}/p")
    project.build_from_files([f"{folder}/a_2024_01_01_00_00_00.wav", f"{folder}/a_2024_01_01_00_00_01.wav"], ["%Y_%m_%d_%H_%M_%S"])
    done = export.main(["--project", f"file://{tmp_path}/p", "--name", "x", "--outputs", "audio", "welch", "--fft", json.dumps(FFT | {"fs": 480.0}), "--no-detrend", "--partitions", "1"], spark)
    assert sorted(done) == ["x_audio", "x_welch", "x_windows"] and project.load("x_audio").count() == 4
    project.reset()
    assert project.outputs() == ["original"]


def test_catalogue_merges(spark, tmp_path):
    project = Project(spark, f"file://{tmp_path}/p")
    assert project.catalogue() == {"version": 0, "outputs": {}}
    project.update({"a": {"transform": None, "kind": "x"}})
    project.update({"a": {"transform": None, "kind": "y"}, "b": {"transform": None, "kind": "z"}})
    assert {k: v["kind"] for k, v in project.catalogue()["outputs"].items()} == {"a": "x", "b": "z"}
    project.update({}, ("a",))
    assert project.outputs() == ["b"] and project.catalogue()["version"] == 3


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """A writer that finds its version taken merges with what the other one stored."""
    one, other = (Project(spark, f"file://{tmp_path}/p") for _ in range(2))
    create, rivals = one._create, [{"x": {"transform": "x", "kind": "k"}}, {"y": {"transform": "y", "kind": "k"}}]

    def late(path, text):
        if rivals:
            other.update(rivals.pop())
        return create(path, text)

    monkeypatch.setattr(one, "_create", late)
    one.update({"mine": {"transform": "z", "kind": "k"}})
    assert set(one.catalogue()["outputs"]) == {"x", "y", "mine"} and one.catalogue()["version"] == 3
    assert not one._create(one._version(3), "{}") and other.catalogue()["version"] == 3


class Killed(Exception):
    pass


def killed(*_, **__):
    raise Killed


def small_project(spark, folder):
    project = Project(spark, folder)
    rows = [(1, k, k * SECOND, (k + 1) * SECOND, [float(k)] * 8) for k in range(8)]
    project.build(spark.createDataFrame(rows, "key long, id long, begin_us long, end_us long, x array<double>"))
    return project


def test_a_writer_that_breaks_off(spark, tmp_path, monkeypatch):
    """Whatever step it breaks at, readers see the state before or after, and the same call works again."""
    project = small_project(spark, f"file://{tmp_path}/p")
    t = Transform("t", Output.AUDIO, mode="timedelta_total", duration_us=2 * SECOND)
    with pytest.raises(ValueError):
        small_project(spark, project.folder)
    for step in ("_new_folder", "commit", "_create"):
        with monkeypatch.context() as broken:
            broken.setattr(project, step, killed)
            with pytest.raises(Killed):
                project.run(t)
        assert Project(spark, project.folder).outputs() == ["original"]
    assert sorted(project.run(t)) == ["t_audio", "t_windows"] and project.load("t_audio").count() == 4
    assert len(project.sweep()) >= 4 and project.load("t_audio").count() == 4 and project.sweep() == []
    project.rename("t", "u")
    assert project.outputs("u") == ["u_audio", "u_windows"] and project.load("u_audio").count() == 4
    with monkeypatch.context() as broken:
        broken.setattr(project, "_fs", lambda path, fs=project._fs: killed() if "tables" in path else fs(path))
        with pytest.raises(Killed):
            project.delete("u")
    assert project.outputs() == ["original"]
    project.reset()
    assert [n for n in os.listdir(tmp_path / "p" / "tables") if not n.startswith(("original", "."))] == []


def test_runs_share_an_output(spark, tmp_path):
    project = small_project(spark, f"file://{tmp_path}/p")
    t = Transform("t", Output.AUDIO, mode="timedelta_total", duration_us=2 * SECOND)
    project.run(t, first=2)
    other = Project(spark, project.folder)
    assert other.load("t_windows").count() == 2
    with pytest.raises(ValueError, match="already there"):
        other.run(t, first=1, last=3)
    with pytest.raises(ValueError, match="another transform"):
        other.run(Transform("t", Output.AUDIO, mode="timedelta_total", duration_us=SECOND), last=2)
    other.run(t, last=2)
    with pytest.raises(ValueError):
        other.run(t)
    project.run(Transform("whole", Output.AUDIO, mode="timedelta_total", duration_us=2 * SECOND))
    both = [sorted((r["id"], r["channel"], r["x"]) for r in project.load(n).collect()) for n in ("t_audio", "whole_audio")]
    assert both[0] == both[1] and len(both[0]) == 4


def test_transform_rules():
    with pytest.raises(ValueError):
        Transform("x", Output.AUDIO, sample_rate=32.0, fft=FFT)
    moved = Transform("x", Output.WELCH, sample_rate=64.0, fft=FFT).at_rate(32.0)
    assert moved.sample_rate == moved.fft["fs"] == 32.0
    with pytest.raises(ValueError):
        Transform("x", Output.AUDIO, butterworth={"order": 1, "cut": 3.0, "kind": "lowpass"}).chain()


# --- helpers ---


def test_parameters_round_trip():
    parts = [signal.Instrument(gain_db=3.0), spectral.Fft((1.0, 2.0), 1, 8.0, 4, "psd"), spectral.Scale((spectral.ScalePart(0, 1, 1, 2, "log"),)), signals.Chain(8.0, (0, 1), ((1.0, 0.0, 0.0, 0.0, 0.0),))]
    for p in parts:
        assert describe.loads(describe.dumps(p)) == p
    assert describe.loads(describe.dumps({"list": parts})) == {"list": parts}
    with pytest.raises(KeyError):
        describe.from_dict({"type": "Nothing"})
    assert describe.spectrum_of({"fft": FFT})[0] == "spectro" and describe.spectrum_of({"fft": FFT, "nb_ltas_time_bins": 4})[::2] == ("ltas", 4)
    with pytest.raises(KeyError):
        describe.spectrum_of({})


def test_text_helpers(spark):
    assert text.argument_string({"name": "x", "to_json": True, "plot": False, "first": None, "ids": [1, 2]}) == "--name x --to-json --no-plot --ids 1 2"
    assert text.within("/a/b", "c/../d") == "/a/b/d" and text.relative_to("/a/b", "/a/b/c/d") == "c/d"
    for bad in ("../x", "/a/bc", "C:\\x", "c/../../x"):
        with pytest.raises(ValueError):
            text.within("/a/b", bad)
    assert [text.is_absolute(p) for p in ("/a", "C:\\a", "\\\\host\\a", "hdfs://a/b", "a/b")] == [True, True, True, True, False]
    assert not text.is_empty_record(signal.Instrument())
    row = spark.range(1).select(text.all_null(F.lit(None), F.lit(None)).alias("a"), text.all_null(F.lit(None), F.lit(1)).alias("b")).first()
    assert (row["a"], row["b"]) == (True, False)


def test_timestamp_errors_and_offsets(spark):
    with pytest.raises(ValueError, match="%Y_%m"):
        timestamps.parse_one("nothing here", ["%Y_%m", "%H:%M"])
    assert timestamps.parse_one("x 2024_03", ["%H:%M", "%Y_%m"]) == datetime.datetime(2024, 3, 1)
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 12:00:00.5' AS t").select(timestamps.format_millis(F.col("t")).alias("u"), timestamps.format_millis(F.col("t"), "Europe/Paris").alias("p")).first()
    assert (row["u"], row["p"]) == ("2024-07-01T12:00:00.500+0000", "2024-07-01T14:00:00.500+0200")
    again = spark.createDataFrame([("01/02/2024 03h",)], "t string").select(timestamps.reformat(F.col("t"), ["%d/%m/%Y %Hh"]).alias("x")).first()["x"]
    assert again == "2024-02-01T03:00:00.000+0000"
