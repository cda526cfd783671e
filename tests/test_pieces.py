"""Signals in pieces, against the same signals whole."""

import random

import numpy as np
import pytest

from tidewave.functions import signal, spectral
from tidewave.operators import pieces, signals
from tidewave.sources import wav

RATE = 64.0
SECTIONS = tuple(signal.butterworth_sections(4, (4.0, 9.0), "bandpass", RATE))


def whole(seed, n):
    return np.random.default_rng(seed).normal(size=n) + 3


@pytest.fixture(scope="module")
def cut(spark):
    """Two signals in pieces of all lengths, in no order, some shorter than a frame."""
    rng = random.Random(1)
    rows = []
    for i, n in ((1, 3_000), (2, 700)):
        x = whole(i, n)
        cuts = sorted({0, n, *(rng.randrange(1, n) for _ in range(25)), 100, 101, 103})
        rows += [(i, a, 0, x[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, pieces.PIECES).repartition(4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def together(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["id"], r["channel"], r["start"])):
        own = out.setdefault((r["id"], r["channel"]), [])
        assert r["start"] == len(own)
        own += r["x"]
    return out


def test_filter_goes_on_from_any_state():
    x, states = whole(3, 500), None
    found = []
    for a, b in ((0, 1), (1, 1), (1, 17), (17, 300), (300, 500)):
        y, states = signal.filter_run(x[a:b], SECTIONS, states)
        found.append(y)
    assert np.allclose(np.concatenate(found), signal.filter_array(x, SECTIONS), atol=1e-12)
    silent = signal.filter_run(np.zeros(50), SECTIONS, states)[1]
    assert np.allclose(silent.ravel(), np.linalg.matrix_power(signal.transition(SECTIONS), 50) @ states.ravel(), atol=1e-12)


def test_filter_in_pieces(cut):
    found = together(pieces.filter_pieces(cut, SECTIONS))
    for i, n in ((1, 3_000), (2, 700)):
        assert np.allclose(found[i, 0], signal.filter_array(whole(i, n), SECTIONS), atol=1e-10)


@pytest.mark.parametrize("flags", [signal.DC_REJECT, signal.PEAK, signal.ZSCORE, signal.DC_REJECT | signal.PEAK, signal.DC_REJECT | signal.ZSCORE])
def test_normalisation_in_pieces(cut, flags):
    found = together(pieces.normalize_pieces(cut, flags, gain=2.0))
    for i, n in ((1, 3_000), (2, 700)):
        assert np.allclose(found[i, 0], 2 * signal.normalize_array(whole(i, n), flags), atol=1e-12)


def test_normalisation_of_constants(spark):
    flat = spark.createDataFrame([(1, 0, 0, [2.0] * 4), (1, 4, 0, [2.0]), (2, 0, 0, [0.0, 0.0])], pieces.PIECES)
    assert together(pieces.normalize_pieces(flat, signal.ZSCORE)) == {(1, 0): [0.0] * 5, (2, 0): [0.0] * 2}
    assert together(pieces.normalize_pieces(flat, signal.PEAK)) == {(1, 0): [1.0] * 5, (2, 0): [0.0] * 2}


@pytest.mark.parametrize("m, hop", [(16, 8), (65, 20), (33, 33)])
def test_stft_in_pieces(cut, m, hop):
    fft = spectral.Fft(tuple(spectral.hamming(m)), hop, RATE, scale_to="magnitude")
    for i, n in ((1, 3_000), (2, 700)):
        wanted, low = spectral.stft_array(whole(i, n), fft), fft.slices(n)[0]
        rows = sorted((r["p"], r["re"], r["im"]) for r in pieces.stft_pieces(cut.where(f"id = {i}"), fft).collect())
        assert [r[0] for r in rows] == list(range(low, low + len(wanted)))
        assert np.allclose(np.array([r[1] for r in rows]) + 1j * np.array([r[2] for r in rows]), wanted, atol=1e-10)


@pytest.mark.parametrize("options", [{}, {"average": "median"}, {"detrend": "linear", "noverlap": 3}, {"detrend": lambda f: f - f.min(axis=1, keepdims=True), "scaling": "spectrum"}])
def test_welch_in_pieces(spark, cut, options):
    fft = spectral.Fft(tuple(spectral.hamming(32)), 16, RATE)
    frame = spark.createDataFrame([(i, whole(i, n).tolist()) for i, n in ((1, 3_000), (2, 700))], "id long, x array<double>")
    wanted = {(r["id"], r["k"]): (r["frequency"], r["px"]) for r in spectral.welch(frame, fft, **options).collect()}
    found = {(r["id"], r["k"]): (r["frequency"], r["px"]) for r in pieces.welch_pieces(cut, fft, **options).collect()}
    assert wanted.keys() == found.keys() and all(np.allclose(wanted[k], found[k], rtol=1e-9) for k in wanted)


@pytest.mark.parametrize("bins, part", [(400, 1000), (7, 1000), (3, 50), (7, 1)])
def test_long_term_average_in_pieces(cut, bins, part):
    fft = spectral.Fft(tuple(spectral.hamming(16)), 16, RATE)
    for i, n in ((1, 3_000), (2, 700)):
        wanted = spectral.ltas_array(whole(i, n), fft, bins)
        rows = sorted((r["p"], r["power"]) for r in pieces.ltas_pieces(cut.where(f"id = {i}"), fft, bins, part).collect())
        assert [r[0] for r in rows] == list(range(len(wanted)))
        assert np.allclose(np.array([r[1] for r in rows]), wanted, rtol=1e-9)


SECOND = 1_000_000


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Files of two rates and two channels, some without a gap between them, some with."""
    folder = tmp_path_factory.mktemp("pieces")
    spans = [(1, 0.0, 2.0, 64), (2, 2.0, 3.0, 64), (3, 3.0, 3.5, 64), (4, 5.0, 7.0, 64), (5, 7.0, 9.0, 32), (6, 9.5, 10.0, 32)]
    rows = []
    for k, a, z, rate in spans:
        x = np.stack([whole(10 * k + c, int((z - a) * rate)) for c in range(2)], axis=1)
        (folder / f"{k}.wav").write_bytes(wav.encode(x, rate))
        rows.append((1, k, int(a * SECOND), int(z * SECOND), f"{folder}/{k}.wav", rate, len(x)))
    return spark.createDataFrame(rows, "key int, id long, begin_us long, end_us long, path string, rate int, frames long")


@pytest.mark.parametrize("rate", [64.0, 48.0, 100.0])
@pytest.mark.parametrize("chunk", [7, 64, 10_000])
def test_windows_in_pieces_equal_whole_windows(spark, files, rate, chunk):
    windows = spark.createDataFrame([(1, 1, 0, 12 * SECOND), (1, 2, SECOND // 2, 8 * SECOND), (1, 3, 20 * SECOND, 21 * SECOND), (1, 4, 3 * SECOND, 3 * SECOND + 900_000)], "key int, id long, begin_us long, end_us long")
    chain = signals.Chain(rate=rate, channels=(1, 0))
    wanted = {(r["id"], r["channel"]): r["x"] for r in signals.signals_of_files(windows, files, chain, ["key"], 2 * SECOND).collect()}
    found = together(pieces.pieces_of_files(windows, files, chain, ["key"], 2 * SECOND, chunk))
    assert wanted.keys() == found.keys()
    assert all(len(wanted[k]) == len(found[k]) and np.allclose(wanted[k], found[k], atol=1e-12) for k in wanted)


@pytest.mark.parametrize("rate", [64.0, 50.0])
def test_tables_in_pieces_equal_whole_windows(spark, rate):
    rows = [(1, k, int(a * SECOND), int(z * SECOND), float(r), whole(k, int((z - a) * r)).tolist()) for k, a, z, r in [(1, 0, 2, 64), (2, 2, 3, 64), (3, 4, 6, 32), (4, 6, 6.5, 64)]]
    own = spark.createDataFrame(rows, "key int, id long, begin_us long, end_us long, rate double, x array<double>")
    windows = spark.createDataFrame([(1, 1, 0, 8 * SECOND), (1, 2, SECOND // 4, 5 * SECOND), (1, 3, 30 * SECOND, 31 * SECOND)], "key int, id long, begin_us long, end_us long")
    chain = signals.Chain(rate=rate)
    wanted = {(r["id"], r["channel"]): r["x"] for r in signals.signals_of_tables(windows, own, chain, ["key"], 2 * SECOND).collect()}
    for chunk in (9, 1_000):
        found = together(pieces.pieces_of_tables(windows, own, chain, ["key"], 2 * SECOND, chunk=chunk))
        assert wanted.keys() == found.keys()
        assert all(len(wanted[k]) == len(found[k]) and np.allclose(wanted[k], found[k], atol=1e-12) for k in wanted)


def test_whole_chain_in_pieces(spark, files):
    """One window over all recordings, resampled, filtered, normalised and calibrated."""
    windows = spark.createDataFrame([(1, 1, 0, 12 * SECOND)], "key int, id long, begin_us long, end_us long")
    chain = signals.Chain(rate=RATE, sections=SECTIONS, normalization=signal.DC_REJECT | signal.PEAK, instrument=signal.Instrument(sensitivity=0.5))
    wanted = {(r["id"], r["channel"]): r["x"] for r in signals.signals_of_files(windows, files, chain, ["key"], 2 * SECOND).collect()}
    found = together(pieces.signals_in_pieces(windows, files, chain, ["key"], 2 * SECOND, 50))
    assert wanted.keys() == found.keys() and all(np.allclose(wanted[k], found[k], atol=1e-10) for k in wanted)


def test_pieces_of_one_rate_need_no_rate(spark, files):
    own = files.where("rate = 32")
    windows = spark.createDataFrame([(1, 1, 7 * SECOND, 10 * SECOND)], "key int, id long, begin_us long, end_us long")
    assert {len(x) for x in together(pieces.pieces_of_files(windows, own, signals.Chain(), ["key"], SECOND)).values()} == {96}
    with pytest.raises(ValueError):
        pieces.pieces_of_files(windows, files, signals.Chain(), ["key"], SECOND)


def test_nothing_in_pieces(spark):
    none = spark.createDataFrame([], pieces.PIECES)
    fft = spectral.Fft(tuple(spectral.hamming(16)), 8, RATE)
    for frame in (pieces.filter_pieces(none, SECTIONS), pieces.normalize_pieces(none, signal.ZSCORE), pieces.stft_pieces(none, fft), pieces.welch_pieces(none, fft), pieces.ltas_pieces(none, fft)):
        assert frame.count() == 0


@pytest.mark.parametrize("bins", [None, 6])
def test_project_over_all_recordings(spark, tmp_path, bins):
    """Mode whole keeps samples in pieces; what it gives is what one array gives, and its audio is a source of its own."""
    from tidewave.plans.project import Output, Project, Transform

    rows = [(1, k, int(a * SECOND), int(z * SECOND), whole(k, int((z - a) * RATE)).tolist()) for k, a, z in [(1, 0, 20), (2, 20, 31), (3, 33, 40)]]
    x = np.concatenate([whole(1, 20 * 64), whole(2, 11 * 64), np.zeros(2 * 64), whole(3, 7 * 64)])
    x = signal.normalize_array(signal.filter_array(x, signal.butterworth_sections(2, 8.0, "lowpass", RATE)), signal.ZSCORE)
    project = Project(spark, f"file://{tmp_path}/p")
    project.build(spark.createDataFrame(rows, "key long, id long, begin_us long, end_us long, x array<double>"))
    fft = {"win": spectral.hamming(32).tolist(), "hop": 32 if bins else 16, "fs": RATE}
    kinds = Output.AUDIO | Output.SPECTRUM | Output.WELCH
    project.run(Transform("all", kinds, mode="whole", normalization=signal.ZSCORE, butterworth={"order": 2, "cut": 8.0, "kind": "lowpass"}, fft=fft, nb_ltas_time_bins=bins))
    audio = project.load("all_audio")
    assert np.allclose(next(iter(together(audio).values())), x, atol=1e-9) and {r["rate"] for r in audio.select("rate").distinct().collect()} == {RATE}
    spec = spectral.Fft(tuple(fft["win"]), fft["hop"], RATE)
    wanted = spectral.ltas_array(x, spec, bins) if bins else np.abs(spectral.stft_array(x, spec)) ** 2
    found = sorted((r["time_us"], r["power"]) for r in project.load("all_spectrum").collect())
    assert np.allclose([r[1] for r in found], wanted, rtol=1e-7, atol=1e-12) and found[0][0] == 0
    px = {r["k"]: r["px"] for r in project.load("all_welch").collect()}
    one = spark.createDataFrame([(1, x.tolist())], "id long, x array<double>")
    assert np.allclose([px[k] for k in sorted(px)], [r["px"] for r in spectral.welch(one, spec).orderBy("k").collect()], rtol=1e-7)
    source = project.recordings("all_audio")
    assert (min(r["begin_us"] for r in source.collect()), max(r["end_us"] for r in source.collect())) == (0, 40 * SECOND)
    project.run(Transform("cut", Output.AUDIO, mode="timedelta_total", duration_us=10 * SECOND), source="all_audio")
    begins = {r["id"]: r["begin_us"] for r in project.load("cut_windows").collect()}
    cut_up = {begins[r["id"]]: r["x"] for r in project.load("cut_audio").collect()}
    assert np.allclose(np.concatenate([cut_up[b] for b in sorted(cut_up)]), x, atol=1e-9)
