import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import signal, spectral, timestamps


def test_scale_parts_and_nearest():
    scale = spectral.Scale((spectral.ScalePart(0.5, 1, 10, 20), spectral.ScalePart(0, 0.5, 1, 10, "log")))
    assert len(scale.map(10)) == 10 and scale.map(10)[0] == pytest.approx(1)
    assert scale.indexes(np.arange(21.0))[-1] == 20
    with pytest.raises(ValueError):
        spectral.ScalePart(0.5, 0.4, 1, 2)


def test_parseval_and_sine_level():
    fs, n = 64.0, 640
    x = np.sin(2 * np.pi * 8 * np.arange(n) / fs)
    fft = spectral.Fft(tuple(spectral.hamming(64)), 32, fs, scale_to="magnitude")
    power = np.abs(spectral.stft_array(x, fft)) ** 2
    assert 10 * np.log10(4 * power[5].max()) == pytest.approx(0, abs=0.2)
    frames = np.random.default_rng(1).normal(size=64)
    flat = spectral.Fft((1.0,) * 64, 64, fs)
    own = np.abs(np.fft.rfft(frames)) ** 2
    assert (own[0] + own[-1] + 2 * own[1:-1].sum()) / 64 == pytest.approx((frames**2).sum())
    assert flat.slices(64) == (0, 2)


def test_split_sums_to_whole(spark):
    x = np.random.default_rng(2).normal(size=100)
    fft = spectral.Fft(tuple(spectral.hamming(16)), 8, 100.0)
    df = spark.createDataFrame([(1, x.tolist())], "id long, x array<double>")
    merged = spectral.merge_stft(spectral.split_stft(df, fft, 3)).orderBy("p", "k").toPandas()
    assert np.allclose(merged["power"].to_numpy(), (np.abs(spectral.stft_array(x, fft)) ** 2).ravel())


def test_white_noise_psd(spark):
    fs = 4800.0
    x = np.random.default_rng(1).normal(size=20_000)
    df = spark.createDataFrame([(1, x.tolist())], "id long, x array<double>")
    px = spectral.welch(df, spectral.Fft(tuple(spectral.hamming(256)), 128, fs)).toPandas()["px"]
    assert 10 * np.log10(px.median()) == pytest.approx(-10 * np.log10(fs / 2), abs=0.3)


@pytest.mark.parametrize("kind, cut, order", [("lowpass", 8.0, 3), ("highpass", 8.0, 4), ("bandpass", (6.0, 12.0), 2), ("bandstop", (6.0, 12.0), 3)])
def test_butterworth_edges(kind, cut, order):
    sections = signal.butterworth_sections(order, cut, kind, 64.0)

    def gain(f):
        z = np.exp(-2j * np.pi * f / 64)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))

    for edge in np.atleast_1d(cut):
        assert gain(edge) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert gain({"lowpass": 0.01, "highpass": 31.9, "bandpass": 8.7, "bandstop": 0.01}[kind]) == pytest.approx(1, abs=0.03)


def test_resample_length_and_band():
    x = np.sin(2 * np.pi * 3 * np.arange(640) / 64)
    y = signal.resample_array(x, 64, 48)
    assert len(y) == 480
    assert np.abs(y[60:-60] - np.sin(2 * np.pi * 3 * np.arange(480) / 48)[60:-60]).max() < 0.02


def test_normalization_flags():
    with pytest.raises(ValueError):
        signal.check_normalization(signal.PEAK | signal.ZSCORE)


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 3.0])], "id long, x array<double>")
    assert [r["x"] for r in signal.normalize(df, signal.PEAK).orderBy("id").collect()] == [[0, 0], [1, 1]]
    assert [r["x"] for r in signal.normalize(df, signal.ZSCORE).orderBy("id").collect()] == [[0, 0], [0, 0]]


def test_instrument():
    assert signal.Instrument(end_to_end_db=150).level_db == pytest.approx(150)
    assert signal.Instrument(gain_db=20).gain == pytest.approx(10)


@pytest.mark.parametrize(
    "text, templates, want",
    [
        ("a_2024_01_02_03_04_05_678.wav", ["%Y_%m_%d_%H_%M_%S_%f"], datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)),
        ("x (240102) 3:4", ["(%y%m%d) %-H:%-M"], datetime.datetime(2024, 1, 2, 3, 4)),
        ("240102", ["%Y-%m-%d", "%y%m%d"], datetime.datetime(2024, 1, 2)),
        ("2024-01-02T03:04:05+02:00", ["%Y-%m-%dT%H:%M:%S%z"], datetime.datetime(2024, 1, 2, 1, 4, 5)),
        ("02 PM 2024-01-02", ["%I %p %Y-%m-%d"], datetime.datetime(2024, 1, 2, 14)),
        ("none", ["%Y"], None),
    ],
)
def test_parse(spark, text, templates, want):
    row = spark.createDataFrame([(text,)], "t string").select(timestamps.parse(F.col("t"), templates).alias("s")).first()
    assert row["s"] == want


def test_template_validity():
    assert timestamps.is_valid_template("%Y_%m") and not timestamps.is_valid_template("%Y%Y") and not timestamps.is_valid_template("%Q")
