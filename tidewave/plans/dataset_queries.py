"""Queries over sets of data, windows of signals and stored spectra, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal, spectral, text
from ..operators import datasets, ranges, segments, signals, timeline
from ..operators import detections as det
from ..sources import spectra
from ..streaming import windows as live
from . import project, queries, views
from .queries import BOUNDS, FFT16, HOUR, KEPT, SECTIONS, WELCH_SQL, grid_sql, kept_sql, query, stft_sql
from .views import with_views

SECOND = 1_000_000


# --- windows and their items ---------------------------------------------------------------------


@query(with_views(BOUNDS + grid_sql(6 * HOUR, 6 * HOUR) + ", " + KEPT + """,
it AS (SELECT w.station, w.begin_us AS wb, greatest(w.begin_us, k.begin_us) AS b, least(w.end_us, k.end_us) AS e, k.id AS file FROM win w JOIN kept k ON w.station = k.station AND w.begin_us < k.end_us AND w.end_us > k.begin_us),
lg AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY station, wb ORDER BY b, file), wb) AS prev FROM it),
tail AS (SELECT w.station, w.begin_us AS wb, coalesce(m.me, w.begin_us) AS b, w.end_us AS e FROM win w LEFT JOIN (SELECT station, wb, max(e) AS me FROM it GROUP BY 1, 2) m ON m.station = w.station AND m.wb = w.begin_us)
SELECT station, wb AS window_begin_us, b AS begin_us, e AS end_us, file FROM it
UNION ALL SELECT station, wb, prev, b, NULL FROM lg WHERE b > prev UNION ALL SELECT station, wb, b, e, NULL FROM tail WHERE b < e""", "rec", recursive=True))
def window_items(spark, sf_dir):
    own = views.recordings(spark, sf_dir)
    return segments.items_total(segments.total_bounds(own, "station"), timeline.remove_overlaps(own, "station"), "station", 6 * HOUR)


@query(with_views(BOUNDS + "x AS (SELECT 1) SELECT station, 0::BIGINT AS \"window\", lo AS begin_us, hi AS end_us FROM b", "rec"))
def single_window(spark, sf_dir):
    return datasets.single_window(segments.total_bounds(views.recordings(spark, sf_dir), "station")).select("station", "window", "begin_us", "end_us")


@query(with_views(queries.POPULATED.rpartition("SELECT station, begin_us")[0] + "SELECT station, count(CASE WHEN populated_us * 4 > end_us - begin_us THEN 1 END) AS kept, count(CASE WHEN populated_us * 4 <= end_us - begin_us THEN 1 END) AS removed FROM p GROUP BY station", "rec", recursive=True))
def remove_empty_sides(spark, sf_dir):
    full = queries._populated(spark, sf_dir)
    kept = datasets.filled(F.col("populated_us") / (F.col("end_us") - F.col("begin_us")), 0.25)
    return full.groupBy("station").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, p AS piece, p * 512 AS start, least(p * 512 + 512, CAST(floor(value * 10) AS BIGINT)) AS \"end\" FROM events, range(0, 20) t(p) WHERE p * 512 < CAST(floor(value * 10) AS BIGINT)")
def stream_chunks(spark, sf_dir):
    own = views.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit(0).cast("long").alias("first"), F.floor(F.col("value") * 10).cast("long").alias("stop"))
    return signals.split_chunks(own, 512).select("id", "k", "piece", "start", "end")


# --- signals of windows ----------------------------------------------------------------------------


def _seconds(spark, sf_dir, gaps: bool = True):
    """Recordings of one second at 64 Hz; with gaps, every seventh is missing."""
    own = views.waveforms(spark, sf_dir)
    own = own.where("id % 7 <> 0") if gaps else own
    return own.select(F.lit(0).cast("long").alias("key"), "id", (F.col("id") * SECOND).alias("begin_us"), ((F.col("id") + 1) * SECOND).alias("end_us"), F.lit(64.0).alias("rate"), "x")


def _windowed(seconds: float, hop: float) -> str:
    """Samples (window begin in samples ``a``, place i, v) of windows over the recordings with gaps."""
    n, step = int(seconds * 64), int(hop * 64)
    return f"""s AS (SELECT vec_id, unnest(range(0, 64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id % 7 <> 0),
b AS (SELECT min(vec_id) * 64 AS lo, (max(vec_id) + 1) * 64 AS hi FROM s),
w AS (SELECT lo + unnest(range(0, CAST(ceil((hi - lo) / {step}.0) AS BIGINT))) * {step} AS a FROM b),
x AS (SELECT w.a, t.i, coalesce(s.v, 0) AS v FROM w CROSS JOIN range(0, {n}) t(i) LEFT JOIN s ON s.vec_id = (w.a + t.i) // 64 AND s.n = (w.a + t.i) % 64)"""


def _summary(found, windows):
    """One row per window: its samples' number, a checksum that hangs on their places, and their energy."""
    rows = found.join(windows.select("id", "begin_us"), "id").select("begin_us", F.posexplode("x").alias("n", "v"))
    return rows.groupBy("begin_us").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * (F.col("n") + 1)), 4).alias("checksum"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("energy"))


_SUMMARY = "SELECT a * 15625 AS begin_us, count(*) AS n, round(sum(v * (i + 1)), 4) AS checksum, round(sum(v * v), 4) AS energy FROM c GROUP BY a"


@query(f"WITH {_windowed(2.5, 2.5)}, c AS (SELECT a, i, v - avg(v) OVER (PARTITION BY a) AS v FROM x) {_SUMMARY}")
def window_signals(spark, sf_dir):
    own = _seconds(spark, sf_dir)
    windows = segments.windows_total(segments.total_bounds(own, "key"), 5 * SECOND // 2).withColumn("id", F.col("window"))
    return _summary(signals.signals_of_tables(windows, own, signals.Chain(normalization=signal.DC_REJECT), ["key"], SECOND), windows)


@query(f"WITH {_windowed(2, 1)}, c AS (SELECT a, i, v / coalesce(nullif(max(abs(v)) OVER (PARTITION BY a), 0), 1) AS v FROM x) {_SUMMARY}")
def project_audio(spark, sf_dir):
    t = project.Transform("audio", project.Output.AUDIO, mode="timedelta_total", duration_us=2 * SECOND, overlap=0.5, normalization=signal.PEAK)
    out = project.outputs_of(_seconds(spark, sf_dir), t)
    return _summary(out["audio"], out["windows"])


_FFT = {"win": spectral.hamming(16).tolist(), "hop": 8, "fs": 64.0}


@query(f"""WITH {_windowed(2, 2)}, seg AS (SELECT a, p, n, v FROM x JOIN range(0, 15) q(p) ON true JOIN range(0, 16) r(n) ON x.i = q.p * 8 + r.n),
dt AS (SELECT a, p, n, (v - avg(v) OVER (PARTITION BY a, p)) * (0.54 - 0.46 * cos(2 * pi() * n / 15.0)) AS v FROM seg),
px AS (SELECT a, p, k::INTEGER AS k, (pow(sum(v * cos(2 * pi() * k * n / 16.0)), 2) + pow(sum(v * sin(2 * pi() * k * n / 16.0)), 2)) * (CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / (64.0 * {float((spectral.hamming(16) ** 2).sum())!r}::DOUBLE) AS px FROM dt, range(0, 9) c(k) GROUP BY a, p, k)
SELECT a * 15625 AS begin_us, a * 15625 + 2000000 AS end_us, k, k * 4.0::DOUBLE AS frequency, round(avg(px), 6) AS px FROM px GROUP BY a, k""")
def project_welch(spark, sf_dir):
    t = project.Transform("welch", project.Output.WELCH, mode="timedelta_total", duration_us=2 * SECOND, fft=_FFT)
    return project.outputs_of(_seconds(spark, sf_dir), t)["welch"].select("begin_us", "end_us", "k", "frequency", F.round("px", 6).alias("px"))


_B0, _B1, _B2, _A1, _A2 = (repr(v) for v in SECTIONS[0])


@query(f"""WITH RECURSIVE s AS (SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
f AS (SELECT id, n, {_B0}::DOUBLE * v AS y, {_B1}::DOUBLE * v - {_A1}::DOUBLE * ({_B0}::DOUBLE * v) AS p, {_B2}::DOUBLE * v - {_A2}::DOUBLE * ({_B0}::DOUBLE * v) AS q FROM s WHERE n = 0
UNION ALL SELECT s.id, s.n, {_B0}::DOUBLE * s.v + f.p, {_B1}::DOUBLE * s.v - {_A1}::DOUBLE * ({_B0}::DOUBLE * s.v + f.p) + f.q, {_B2}::DOUBLE * s.v - {_A2}::DOUBLE * ({_B0}::DOUBLE * s.v + f.p) FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1)
SELECT id, n, round((y - avg(y) OVER (PARTITION BY id)) * 4.0, 6) AS v FROM f""")
def read_chain(spark, sf_dir):
    """Filtered, without its mean, and calibrated, window by window."""
    own = _seconds(spark, sf_dir, gaps=False)
    chain = signals.Chain(64.0, (0,), tuple(SECTIONS), signal.DC_REJECT, signal.Instrument(sensitivity=0.5, peak_voltage=2.0))
    found = signals.signals_of_tables(own.select("key", "id", "begin_us", "end_us"), own, chain, ["key"], SECOND)
    return found.select("id", F.posexplode("x").alias("n", "v")).select("id", "n", F.round("v", 6).alias("v"))


RESAMPLED = """WITH s AS (SELECT vec_id AS id, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
y AS (SELECT id, m, j, v, m * 64.0 / 48.0 - j AS d FROM s, range(0, 48) t(m) WHERE j > floor(m * 64.0 / 48.0) - 22 AND j <= floor(m * 64.0 / 48.0) + 22)
SELECT id, m::INTEGER AS n, round(sum(v * 0.75 * (CASE WHEN abs(d) < 1e-9 THEN 1.0 ELSE sin(pi() * 0.75 * d) / (pi() * 0.75 * d) END) * (0.5 + 0.5 * cos(pi() * greatest(-1.0, least(1.0, d / 22.0))))), 6) AS v FROM y GROUP BY id, m"""


@query(RESAMPLED)
def resample_values(spark, sf_dir):
    found = signal.resample(views.waveforms(spark, sf_dir), 64.0, 48.0)
    return found.select("id", F.posexplode("x").alias("n", "v")).select("id", "n", F.round("v", 6).alias("v"))


@query(RESAMPLED)
def resample_stream(spark, sf_dir):
    """The same, streamed in pieces of ten samples."""
    found = signal.resample_pieces(views.waveforms(spark, sf_dir), 64.0, 48.0, 10)
    return found.select("id", F.posexplode("x").alias("n", "v")).select("id", "n", F.round("v", 6).alias("v"))


@query("SELECT vec_id AS id, (n // 2)::INTEGER AS n, round(CAST(embedding[n + 1] AS DOUBLE), 6) AS v FROM embeddings, range(0, 64) t(n) WHERE n % 2 = 1")
def channel_projection(spark, sf_dir):
    """The second of two interleaved channels."""
    x = F.col("x")
    both = views.waveforms(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("channel"), "x")
    split = both.select("id", "channel", F.filter(x, lambda v, i: i % 2 == F.col("channel")).alias("x"))
    return spectra.choose_channel(split, 1).select("id", F.posexplode("x").alias("n", "v")).select("id", "n", F.round("v", 6).alias("v"))


# --- stored spectra ----------------------------------------------------------------------------------


def _spectra(spark, sf_dir, gaps: bool = False):
    own = _seconds(spark, sf_dir, gaps)
    return spectra.with_axes(spectral.stft_power(own, FFT16), own)


@query(f"WITH {stft_sql(16, 8, *FFT16.slices(64))} SELECT id, p, id * 1000000 + p * 1000000 // 9 AS time_us, k, round(power, 6) AS power FROM power WHERE id * 1000000 + p * 1000000 // 9 >= 5250000 AND id * 1000000 + p * 1000000 // 9 < 20500000")
def spectrum_time_slice(spark, sf_dir):
    cut = spectra.time_slice(_spectra(spark, sf_dir), 5_250_000, 20_500_000)
    return spectral.long_form(cut).select("id", "p", "time_us", "k", F.round("power", 6).alias("power"))


@query(f"WITH {stft_sql(16, 8, *FFT16.slices(64))} SELECT id, p, id * 1000000 + p * 1000000 // 9 AS time_us, k, round(power, 6) AS power FROM power WHERE id * 1000000 + p * 1000000 // 9 >= 5250000 AND id * 1000000 + p * 1000000 // 9 < 20500000")
def stored_time_slice(spark, sf_dir):
    """The same of a stored spectrum: of all its stretches the scan opens those of the slice."""
    folder = ranges.new_folder(spark, "spectra")
    spectra.store(_spectra(spark, sf_dir), folder, 4 * SECOND)
    cut = spectra.time_slice(spectra.stored(spark, folder), 5_250_000, 20_500_000)
    return spectral.long_form(cut.select("id", "p", "time_us", "power")).select("id", "p", "time_us", "k", F.round("power", 6).alias("power"))


@query(f"WITH {stft_sql(16, 8, *FFT16.slices(64))} SELECT id, p, k, round(10 * log10(power + 5e-324) - 20 * log10(2.0), 4) AS db, 'SPL_parameter' AS reference FROM power WHERE k > 0")
def spectrogram_db(spark, sf_dir):
    grid = spectra.decibel_grid(spectral.stft_power(views.waveforms(spark, sf_dir), FFT16), 2.0)
    return grid.where("k > 0").select("id", "p", "k", F.round("db", 4).alias("db"), "reference")


@query(f"""WITH {stft_sql(16, 8, 0, 8)}, b AS (SELECT min(vec_id) AS lo, max(vec_id) + 1 AS hi FROM embeddings WHERE vec_id % 7 <> 0),
w AS (SELECT lo + unnest(range(0, CAST(ceil((hi - lo) / 3.0) AS BIGINT))) * 3 AS a FROM b)
SELECT w.a * 1000000 AS begin_us, j::INTEGER AS slice, u.k, round(coalesce(q.power, 0), 6) AS power FROM w CROSS JOIN range(0, 24) t(j) CROSS JOIN (SELECT unnest(range(0, 9))::INTEGER AS k) u LEFT JOIN (SELECT * FROM power WHERE id % 7 <> 0) q ON q.k = u.k AND q.id = w.a + j // 8 AND q.p = j % 8""")
def spectrum_stitch(spark, sf_dir):
    """Windows of three seconds put together from spectra of one second each; missing ones are zeros."""
    own = _seconds(spark, sf_dir)
    windows = segments.windows_total(segments.total_bounds(own, "key"), 3 * SECOND).withColumn("id", F.col("begin_us"))
    items = signals.window_items(windows, own.select("key", "id", "begin_us", "end_us"), ["key"], SECOND).withColumnRenamed("file", "piece")
    power = spectral.stft_power(own, FFT16).where("p < 8")
    pieces = power.select(F.col("id").alias("piece"), (F.col("id") * SECOND + F.col("p") * (SECOND // 8)).alias("time_us"), F.lit(SECOND // 8).alias("step_us"), "power")
    whole = spectra.stitch(items, pieces)
    return whole.select(F.col("id").alias("begin_us"), "slice", F.posexplode("power").alias("k", "power")).withColumn("power", F.round("power", 6))


@query(f"WITH {WELCH_SQL} SELECT id, k, round(avg(px), 6) AS px FROM px GROUP BY id, k")
def welch_detrend_function(spark, sf_dir):
    centred = lambda frames: frames - frames.mean(axis=1, keepdims=True)
    return spectral.welch(views.waveforms(spark, sf_dir), FFT16, detrend=centred).select("id", "k", F.round("px", 6).alias("px"))


# --- sets of data ------------------------------------------------------------------------------------


@query("SELECT id, place FROM (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events) WHERE place >= 100 AND place < 250")
def slice_first_last(spark, sf_dir):
    return datasets.take(views.events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts_us"), ["ts_us", "id"], 100, 250).select("id", "place")


@query(with_views(f"f AS (SELECT station, coalesce(max(begin_us) FILTER (begin_us <= {queries.T0 + 48 * HOUR}), min(begin_us)) AS b FROM rec GROUP BY station) SELECT r.station, r.id, r.begin_us FROM rec r JOIN f ON r.station = f.station AND r.begin_us >= f.b AND r.begin_us <= {queries.T0 + 60 * HOUR}", "rec"))
def files_in_range(spark, sf_dir):
    return segments.files_in_range(views.recordings(spark, sf_dir), "station", queries.T0 + 48 * HOUR, queries.T0 + 60 * HOUR).select("station", "id", "begin_us")


@query("WITH s AS (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), a AS (SELECT id, avg(v) AS mean, max(abs(v)) AS peak, stddev_pop(v) AS std FROM s GROUP BY id) SELECT id, 'mean' AS name, round(mean, 6) AS value FROM a UNION ALL SELECT id, 'peak', round(peak, 6) FROM a UNION ALL SELECT id, 'std', round(std, 6) FROM a")
def normalization_values(spark, sf_dir):
    found = views.waveforms(spark, sf_dir).select("id", F.explode(signal.normalization_values(F.col("x"))).alias("name", "value"))
    return found.withColumn("value", F.round("value", 6))


@query(with_views(f"""k AS (SELECT station, begin_us, end_us, 1 AS d FROM rec UNION ALL SELECT station, greatest(begin_us, {queries.T0 + 48 * HOUR}), least(end_us, {queries.T0 + 96 * HOUR}), -1 FROM rec WHERE end_us >= {queries.T0 + 48 * HOUR} AND begin_us < {queries.T0 + 96 * HOUR})
SELECT station, begin_us, end_us, sum(d)::BIGINT AS surplus FROM k GROUP BY ALL HAVING sum(d) <> 0""", "rec"))
def timeline_differences(spark, sf_dir):
    own = views.recordings(spark, sf_dir).select("station", "begin_us", "end_us")
    return datasets.differences(own, timeline.trim(own, queries.T0 + 48 * HOUR, queries.T0 + 96 * HOUR))


@query("SELECT user_id AS station, arg_min(event_type, (-n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def parameter_mode(spark, sf_dir):
    return datasets.mode_of(views.events(spark, sf_dir).withColumnRenamed("user_id", "station"), ["station"], "event_type")


@query("SELECT user_id AS station, count(DISTINCT event_type) AS n_event_type, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS n_hop FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1 OR count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) > 1")
def parameter_consistency(spark, sf_dir):
    own = views.events(spark, sf_dir).select(F.col("user_id").alias("station"), "event_type", (F.get_json_object("props", "$.k").cast("long") % 3).alias("hop"))
    return datasets.inconsistent(own, ["station"], ["event_type", "hop"])


@query("""WITH e AS (SELECT event_id AS id, user_id AS station, ts, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id END AS chain FROM events),
m AS (SELECT station, arg_min(kind, (-n, kind)) AS kind FROM (SELECT station, kind, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT station, arg_min(chain, (ts, id)) FILTER (chain IS NOT NULL) AS chain FROM e GROUP BY 1)
SELECT e.id, coalesce(e.kind, m.kind) AS kind, coalesce(e.chain, c.chain) AS chain FROM e LEFT JOIN m USING (station) LEFT JOIN c USING (station)""")
def parameter_defaults(spark, sf_dir):
    own = views.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("station"), "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("chain"))
    return datasets.with_defaults(own, ["station"], ["kind"], ["chain"], ["ts", "id"]).select("id", "kind", "chain")


def _transforms(spark, sf_dir):
    return views.events(spark, sf_dir).select(F.col("event_id").cast("string").alias("name"), F.col("event_type").alias("win"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("hop"))


@query("SELECT event_type AS win, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS hop, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS names FROM events GROUP BY 1, 2")
def transform_names(spark, sf_dir):
    return datasets.transform_groups(_transforms(spark, sf_dir), ["win", "hop"]).withColumn("names", F.array_join("names", ","))


@query("SELECT event_id::VARCHAR AS name, event_type AS win, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS hop FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id::VARCHAR, NULL, NULL FROM events WHERE event_type = 'view'")
def transform_membership(spark, sf_dir):
    own = _transforms(spark, sf_dir)
    return datasets.by_membership(own.select("name"), datasets.transform_groups(own.where("win <> 'view'"), ["win", "hop"]))


@query("SELECT coalesce(a.id, b.id) AS id, coalesce(a.value, b.value) AS value FROM (SELECT event_id AS id, value FROM events WHERE event_id % 2 = 0) a FULL JOIN (SELECT event_id AS id, -value AS value FROM events WHERE event_id % 3 = 0) b USING (id)")
def outputs_merge(spark, sf_dir):
    own = views.events(spark, sf_dir).select(F.col("event_id").alias("id"), "value")
    return datasets.merged(own.where("id % 2 = 0"), own.where("id % 3 = 0").withColumn("value", -F.col("value")), "id")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE strftime(ts, '%Y_%m_%d_%H_%M_%S_%f') END || CASE WHEN event_id % 3 = 0 THEN '_low' ELSE '' END AS name FROM events")
def default_names(spark, sf_dir):
    from ..functions.timestamps import format_name

    own = views.events(spark, sf_dir)
    named = datasets.renamed(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), format_name(F.col("ts")), F.when(F.col("event_id") % 3 == 0, "low").otherwise(""))
    return own.select(F.col("event_id").alias("id"), named.alias("name"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN -120.0 ELSE 0.0 END::DOUBLE AS low, CASE WHEN event_id % 2 = 0 THEN 42.0 WHEN event_id % 3 = 2 THEN 0.0 ELSE 170.0 END::DOUBLE AS high FROM events")
def reference_limits(spark, sf_dir):
    kind = F.col("event_id") % 3
    _, name = signal.reference_level(F.when(kind == 0, 2.0), kind == 1)
    shown = signal.limits(name, None, F.when(F.col("event_id") % 2 == 0, 42.0))
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), shown.alias("v")).select("id", F.col("v.low").alias("low"), F.col("v.high").alias("high"))


@query("SELECT event_id AS id, event_id % 4 <= 1 AND event_id % 5 <> 0 AS inside FROM events")
def paths_inside(spark, sf_dir):
    """Whether a/../../b and the like stay in their folder; a root or a drive does not."""
    path = F.when(F.col("event_id") % 10 == 0, F.lit("C:\\x")).when(F.col("event_id") % 5 == 0, F.lit("/etc/x")).otherwise(F.concat(F.lit("a/./"), F.repeat(F.lit("../"), (F.col("event_id") % 4).cast("int")), F.lit("b")))
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), text.inside(path, "/data").alias("inside"))


@query("SELECT event_id AS annotation_id, event_type AS label FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 3")
def confident_detections(spark, sf_dir):
    """One label, and the highest confidence that there is."""
    found = det.parse(queries._raw(spark, sf_dir))
    return det.select(found, label="error", confident=True).select("annotation_id", "label")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return live.sessions(views.events(spark, sf_dir), "ts", "user_id", "2 hours")


@query(kept_sql("SELECT station, min(end_us) AS first_end_us, count(*) AS n FROM kept GROUP BY station"))
def kept_per_station(spark, sf_dir):
    return timeline.remove_overlaps(views.recordings(spark, sf_dir), "station").groupBy("station").agg(F.min("end_us").alias("first_end_us"), F.count("*").alias("n"))
