import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import spectral
from tidewave.operators import detections
from tidewave.plans.project import Output, Project, Transform
from tidewave.sources import spectra, wav
from tidewave.streaming import windows


@pytest.fixture
def folder(tmp_path):
    x = np.sin(np.arange(480) / 7)[:, None]
    for k in range(3):
        (tmp_path / f"a_2024_01_01_00_00_0{k}.wav").write_bytes(wav.encode(x * (k + 1), 480))
    (tmp_path / "a_2024_01_01_00_00_09.WAV").write_bytes(b"no audio")
    return str(tmp_path)


def test_wav_scan_and_read(spark, folder):
    good, bad = wav.recordings(spark, folder, ["%Y_%m_%d_%H_%M_%S"])
    assert good.count() == 3 and bad.count() == 1
    assert {r["duration_us"] for r in good.collect()} == {1_000_000}
    picks = good.select("path", F.lit(10).alias("start"), F.lit(14).alias("stop"))
    rows = wav.read_windows(spark, folder, picks).orderBy("path").collect()
    assert np.allclose(rows[1]["x"], 2 * np.sin(np.arange(10, 14) / 7))
    untimed, _ = wav.recordings(spark, folder, None, 0)
    assert sorted(r["begin_us"] for r in untimed.collect()) == [0, 1_000_000, 2_000_000]


def test_wav_bounds():
    data = wav.encode(np.zeros((4, 2)), 8)
    assert wav.frames(data, 1, 3).shape == (2, 2)
    with pytest.raises(ValueError):
        wav.frames(data, 3, 9)


def test_synthetic(spark):
    for kind in ("repeat", "increase", "sine", "noise"):
        assert all(len(r["x"]) == 16 for r in wav.synthetic(spark, 2, 16, kind).collect())


def test_detections(spark, tmp_path):
    (tmp_path / "a.csv").write_text("min_frequency,max_frequency,start_datetime,end_datetime,confidence_indicator_level,eve\n1,5,2024-01-01T00:00:00+00:00,2024-01-01T00:00:09+00:00,2/3,true\n")
    (tmp_path / "b.csv").write_text("min_frequency,max_frequency,start_datetime,end_datetime\n9,5,2024-01-01T00:00:00+00:00,2024-01-01T00:00:09+00:00\n")
    d = detections.parse(detections.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]))
    assert d.count() == 2 and detections.invalid(d).count() == 1
    row = d.where("bounds.min_frequency = 1").first()
    assert row["verifications"] == {"eve": True} and row["confidence"]["level"]["maximum"] == 3
    with pytest.raises(ValueError):
        detections.parse(spark.createDataFrame([(1,)], "x int"))


def test_project(spark, tmp_path):
    rows = [(1, i, i * 1_000_000, (i + 1) * 1_000_000, [float(v) for v in range(64)]) for i in range(4)]
    project = Project(spark, f"file://{tmp_path}/p")
    project.build(spark.createDataFrame(rows, "key long, id long, begin_us long, end_us long, x array<double>"))
    fft = {"win": spectral.hamming(16).tolist(), "hop": 8, "fs": 64.0}
    t = Transform("day", Output.AUDIO | Output.SPECTRUM | Output.WELCH, mode="timedelta_total", duration_us=2_000_000, fft=fft)
    assert sorted(project.run(t)) == ["day_audio", "day_spectrum", "day_welch", "day_windows"]
    with pytest.raises(ValueError):
        project.run(t)
    assert project.load("day_windows").count() == 2 and project.transforms() == {"day"}
    project.rename("day", "night")
    assert project.load("night_welch").count() == 2 * 9
    project.reset()
    assert project.outputs() == ["original"]
    with pytest.raises(ValueError):
        Transform("x", Output.WELCH)


def test_files_with_one_header_are_one_scan(spark, tmp_path):
    (tmp_path / "many files").mkdir()
    for k in range(120):
        vote = "anna" if k % 2 else "ben"
        (tmp_path / "many files" / f"{k}.csv").write_text(f"annotation_id,{vote}\n{k},true\n{k + 1000},\n")
    (tmp_path / "many files" / "empty.csv").write_text("")
    raw = detections.read_csv(spark, sorted(str(p) for p in (tmp_path / "many files").iterdir()))
    assert raw._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2 and raw.count() == 240
    votes = {r["annotation_id"]: (r["anna"], r["ben"]) for r in raw.collect()}
    assert votes["5"] == ("true", None) and votes["4"] == (None, "true") and votes["1004"] == (None, None)


def test_stored_spectra_open_only_what_a_slice_needs(spark, tmp_path):
    second, folder = 1_000_000, f"{tmp_path}/spectra"
    rows = [(1, p, p * second, [float(p), 1.0]) for p in range(600)]
    spectra.store(spark.createDataFrame(rows[:300], "id long, p int, time_us long, power array<double>"), folder, 60 * second)
    spectra.store(spark.createDataFrame(rows[300:], "id long, p int, time_us long, power array<double>"), folder, 60 * second)
    everything = spectra.stored(spark, folder)
    cut = spectra.time_slice(everything, 130 * second, 250 * second)
    assert sorted(r["p"] for r in cut.collect()) == list(range(130, 250)) and cut.columns == ["id", "p", "time_us", "power"]

    # the scan's own filters on folders are what decides which files are opened
    opened = cut.select(F.input_file_name().alias("f")).distinct().count()
    assert opened < everything.select(F.input_file_name().alias("f")).distinct().count() / 2
    plan = cut._jdf.queryExecution().toString()
    folders = plan[plan.rindex("PartitionFilters: ") :].split("]")[0]
    assert "from_us" in folders and "stretch_us" in folders
    assert "GreaterThanOrEqual(time_us,130000000)" in plan and "LessThan(time_us,250000000)" in plan
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no stored spectra"):
        spectra.stored(spark, f"{tmp_path}/other")


def test_project_outputs_are_per_window(spark, tmp_path):
    """Windows are cut, joined and zero-filled; recordings overlap (1, 2), leave a gap (2, 3) and a window without any."""
    second = 1_000_000
    spans = [(1, 0, 2), (2, 1, 3), (3, 5, 6), (4, 11, 12)]
    rows = [(1, i, a * second, z * second, [float(i)] * (8 * (z - a))) for i, a, z in spans]
    project = Project(spark, f"file://{tmp_path}/p")
    project.build(spark.createDataFrame(rows, "key long, id long, begin_us long, end_us long, x array<double>"))
    fft = {"win": spectral.hamming(8).tolist(), "hop": 4, "fs": 8.0}
    project.run(Transform("total", Output.AUDIO | Output.WELCH | Output.SPECTRUM, mode="timedelta_total", duration_us=4 * second, overlap=0.5, fft=fft))
    begins = {r["id"]: r["begin_us"] // second for r in project.load("total_windows").collect()}
    got = {begins[r["id"]]: r["x"] for r in project.load("total_audio").collect()}
    timeline = [1.0] * 8 + [2.0] * 16 + [0.0] * 16 + [3.0] * 8 + [0.0] * 40 + [4.0] * 8 + [0.0] * 32
    assert got == {b: timeline[8 * b : 8 * b + 32] for b in range(0, 12, 2)}
    assert project.load("total_welch").count() == 6 * 5 and project.load("total_spectrum").select("id").distinct().count() == 6
    project.run(Transform("chunk", Output.AUDIO, mode="timedelta_file", duration_us=2 * second))
    begins = {r["id"]: r["begin_us"] // second for r in project.load("chunk_windows").collect()}
    got = {begins[r["id"]]: r["x"] for r in project.load("chunk_audio").collect()}
    assert begins and got == {b: timeline[8 * b : 8 * b + 16] for b in begins.values()}


def test_project_rates_in_one_window(spark, tmp_path):
    rows = [(1, 1, 0, 1_000_000, 8.0, [1.0] * 8), (1, 2, 1_000_000, 2_000_000, 4.0, [2.0] * 4)]
    project = Project(spark, f"file://{tmp_path}/p")
    project.build(spark.createDataFrame(rows, "key long, id long, begin_us long, end_us long, rate double, x array<double>"))
    project.run(Transform("t", Output.AUDIO, mode="timedelta_total", duration_us=2_000_000, sample_rate=8.0))
    x = project.load("t_audio").first()["x"]
    assert len(x) == 16 and x[2] == pytest.approx(1, abs=0.3) and x[13] == pytest.approx(2, abs=0.5)
    with pytest.raises(ValueError):
        project.prepare(Transform("u", Output.AUDIO, mode="timedelta_total", duration_us=2_000_000))


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(source)
    batch = spark.read.parquet(source)
    stream = windows.windowed_counts(spark.readStream.schema(batch.schema).parquet(source), "ts", "event_type", "10 minutes", "5 minutes", "1 minute")
    windows.run_available(stream, out, str(tmp_path / "state"))
    got = spark.read.parquet(out)
    want = windows.windowed_counts(batch, "ts", "event_type", "10 minutes", "5 minutes")
    # the last windows stay open until the watermark passes them
    assert got.count() > 0.9 * want.count()
    assert got.select("event_type", "begin", "n").exceptAll(want.select("event_type", "begin", "n")).count() == 0


def test_live_trim(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 15), (1, 3, 6, 9)], "key long, id long, begin_us long, end_us long").coalesce(1).write.parquet(source)
    stream = windows.trim_live(spark.readStream.schema("key long, id long, begin_us long, end_us long").parquet(source))
    windows.run_available(stream, out, str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 1, 0, 10), (1, 2, 10, 15)]
