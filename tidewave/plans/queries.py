"""Queries over the timelines, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal, spectral, timestamps
from ..operators import detections as det
from ..operators import ranges, segments, timeline
from ..streaming import windows as live
from . import views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, MINUTE = 3_600_000_000, 60_000_000
JOIN_WIDTH = 8 * HOUR  # about the 95th percentile of the recordings' durations
T0 = 1_704_067_200_000_000  # 2024-01-01


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL pieces -------------------------------------------------------------------------------

#: Overlap removal by recursion over the sorted events of a station, as overlap-free rows ``kept``.
KEPT = """
s AS (SELECT station, {'id': id, 'b': begin_us, 'e': end_us} AS x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY station) AS n FROM rec WINDOW w AS (PARTITION BY station ORDER BY begin_us, end_us DESC, id)),
f AS (SELECT station, rn, n, x AS c, NULL::STRUCT(id BIGINT, b BIGINT, e BIGINT) AS k, []::STRUCT(id BIGINT, b BIGINT, e BIGINT)[] AS o FROM s WHERE rn = 1
  UNION ALL SELECT s.station, s.rn, s.n,
    CASE WHEN s.x.b < f.c.e THEN f.c WHEN f.k IS NOT NULL AND s.x.b < f.k.e THEN f.k ELSE s.x END,
    CASE WHEN s.x.b < f.c.e THEN CASE WHEN s.x.e > greatest(f.c.e, coalesce(f.k.e, f.c.e)) THEN s.x ELSE f.k END WHEN f.k IS NOT NULL AND s.x.b < f.k.e AND s.x.e > f.k.e THEN s.x ELSE NULL END,
    CASE WHEN s.x.b < f.c.e THEN [] WHEN f.k IS NULL THEN [f.c] WHEN s.x.b < f.k.e THEN [{'id': f.c.id, 'b': f.c.b, 'e': f.k.b}] ELSE [{'id': f.c.id, 'b': f.c.b, 'e': f.k.b}, f.k] END
  FROM f JOIN s ON s.station = f.station AND s.rn = f.rn + 1),
o AS (SELECT station, unnest(o) AS v FROM f UNION ALL SELECT station, unnest(CASE WHEN k IS NULL THEN [c] ELSE [{'id': c.id, 'b': c.b, 'e': k.b}, k] END) FROM f WHERE rn = n),
kept AS (SELECT station, v.id AS id, v.b AS begin_us, v.e AS end_us FROM o)
"""


def kept_sql(sql: str) -> str:
    return with_views(KEPT + sql, "rec", recursive=True)


# --- joins ------------------------------------------------------------------------------------


@query(with_views("SELECT d.station, d.id AS detection_id, r.id AS recording_id, greatest(d.begin_us, r.begin_us) AS begin_us, least(d.end_us, r.end_us) AS end_us FROM det d JOIN rec r ON d.station = r.station AND d.begin_us < r.end_us AND d.end_us > r.begin_us", "rec", "det"))
def interval_overlap_join(spark, sf_dir):
    pairs = timeline.interval_join(views.detections(spark, sf_dir), views.recordings(spark, sf_dir), ["station"], JOIN_WIDTH)
    begin, end = timeline.clip(F.col("l_begin_us"), F.col("l_end_us"), F.col("r_begin_us"), F.col("r_end_us"))
    return pairs.select(F.col("l_station").alias("station"), F.col("l_id").alias("detection_id"), F.col("r_id").alias("recording_id"), begin.alias("begin_us"), end.alias("end_us"))


@query(with_views("SELECT a.id, count(*) AS n, max_by(b.id, (b.end_us, -b.id)) AS furthest_id FROM rec a JOIN rec b ON a.station = b.station AND a.id <> b.id AND a.begin_us < b.end_us AND a.end_us > b.begin_us GROUP BY a.id", "rec"))
def interval_self_overlaps(spark, sf_dir):
    own = views.recordings(spark, sf_dir)
    pairs = timeline.interval_join(own, own, ["station"], JOIN_WIDTH).where("l_id <> r_id")
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("n"), F.max_by("r_id", F.struct("r_end_us", -F.col("r_id"))).alias("furthest_id"))


@query(with_views("SELECT station, id, begin_us, end_us FROM rec r WHERE EXISTS (SELECT 1 FROM det d WHERE d.station = r.station AND d.begin_us < r.end_us AND d.end_us > r.begin_us)", "rec", "det"))
def detection_semi_join(spark, sf_dir):
    return timeline.interval_join(views.recordings(spark, sf_dir), views.detections(spark, sf_dir), ["station"], JOIN_WIDTH, "left_semi").select("station", "id", "begin_us", "end_us")


@query(with_views("SELECT station, id, begin_us, end_us FROM rec r WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.station = r.station AND d.begin_us < r.end_us AND d.end_us > r.begin_us)", "rec", "det"))
def detection_anti_join(spark, sf_dir):
    return timeline.interval_join(views.recordings(spark, sf_dir), views.detections(spark, sf_dir), ["station"], JOIN_WIDTH, "left_anti").select("station", "id", "begin_us", "end_us")


@query(with_views("SELECT d.station, d.id, d.begin_us AS at_us, r.id AS recording_id FROM det d ASOF LEFT JOIN (SELECT station, begin_us, max(id) AS id FROM rec GROUP BY station, begin_us) r ON d.station = r.station AND d.begin_us >= r.begin_us", "rec", "det"))
def asof_previous_recording(spark, sf_dir):
    left = views.detections(spark, sf_dir).select("station", "id", F.col("begin_us").alias("at_us"))
    right = views.recordings(spark, sf_dir).select("station", F.col("begin_us").alias("at_us"), F.col("id").alias("recording_id"))
    return timeline.asof_backward(left, right, "station", "recording_id")


@query(with_views("""r AS (SELECT user_id AS station, epoch_us(ts) AS t, max(event_id) AS id FROM events WHERE event_type <> 'error' GROUP BY ALL),
p AS (SELECT d.station, d.id, d.begin_us, r.id AS rid, r.t FROM det d ASOF LEFT JOIN r ON d.station = r.station AND d.begin_us >= r.t),
n AS (SELECT d.id, r.id AS rid, r.t FROM det d ASOF LEFT JOIN r ON d.station = r.station AND d.begin_us < r.t),
b AS (SELECT p.station, p.id, p.begin_us AS at_us, coalesce(n.t IS NULL OR p.begin_us - p.t <= n.t - p.begin_us, false) AS earlier, p.rid AS a, p.t AS s, n.rid AS b, n.t AS e FROM p JOIN n ON p.id = n.id)
SELECT station, id, at_us, CASE WHEN earlier THEN a ELSE b END AS event_id, CASE WHEN earlier THEN s ELSE e END AS found_us FROM b""", "det"))
def nearest_other_event(spark, sf_dir):
    """Of each error the nearest event of another kind at its station."""
    left = views.detections(spark, sf_dir).select("station", "id", F.col("begin_us").alias("at_us"))
    right = views.events(spark, sf_dir).where("event_type <> 'error'").select(F.col("user_id").alias("station"), F.col("ts_us").alias("at_us"), "event_id")
    return timeline.nearest(left, right, "station", "event_id")


@query("SELECT event_id AS id, arg_min(i, (abs(i * 7.5 - value), i))::INTEGER AS nearest FROM events, range(0, 80) t(i) GROUP BY event_id")
def nearest_frequency(spark, sf_dir):
    grid = [7.5 * i for i in range(80)]
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), spectral.nearest_index(F.col("value"), grid).alias("nearest"))


@query(with_views("SELECT a.id, b.id AS audio_id, b.id IS NULL AS missing FROM rec a LEFT JOIN (SELECT begin_us, end_us, id FROM rec WHERE id % 7 <> 0) b ON a.begin_us = b.begin_us AND a.end_us = b.end_us", "rec"))
def link_segments_equi(spark, sf_dir):
    own = views.recordings(spark, sf_dir)
    audio = own.where("id % 7 <> 0").select("begin_us", "end_us", F.col("id").alias("audio_id"))
    return own.join(audio, ["begin_us", "end_us"], "left").select("id", "audio_id", F.col("audio_id").isNull().alias("missing"))


# --- overlap removal, gaps, islands ------------------------------------------------------------


@query(kept_sql("SELECT station, id, begin_us, end_us FROM kept"))
def remove_overlaps(spark, sf_dir):
    return timeline.remove_overlaps(views.recordings(spark, sf_dir), "station")


@query(kept_sql("SELECT station, NULL::BIGINT AS id, end_us AS begin_us, nxt AS end_us FROM (SELECT *, lead(begin_us) OVER (PARTITION BY station ORDER BY begin_us, end_us) AS nxt FROM kept) WHERE nxt > end_us"))
def fill_gaps(spark, sf_dir):
    return timeline.fill_gaps(timeline.remove_overlaps(views.recordings(spark, sf_dir), "station"), "station")


@query(with_views("""m AS (SELECT *, max(end_us) OVER (PARTITION BY station ORDER BY begin_us, end_us DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rec),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR begin_us >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY begin_us, end_us DESC, id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT station, min(begin_us) AS begin_us, max(end_us) AS end_us, count(*) AS n, sum(end_us - begin_us)::BIGINT AS busy_us FROM g GROUP BY station, island""", "rec"))
def coverage_islands(spark, sf_dir):
    return timeline.coverage_islands(views.recordings(spark, sf_dir), "station")


# --- segments -----------------------------------------------------------------------------------

BOUNDS = "b AS (SELECT station, min(begin_us) AS lo, max(end_us) AS hi FROM rec GROUP BY station), "


def grid_sql(duration: int, hop: int) -> str:
    return f"g AS (SELECT station, unnest(range(0, CAST(ceil((hi - lo) / {hop}.0) AS BIGINT))) AS wi, lo FROM b), win AS (SELECT station, wi, lo + wi * {hop} AS begin_us, lo + wi * {hop} + {duration} AS end_us FROM g)"


@query(with_views(BOUNDS + grid_sql(6 * HOUR, 6 * HOUR) + " SELECT station, wi AS \"window\", begin_us, end_us FROM win", "rec"))
def segments_total_tumbling(spark, sf_dir):
    return segments.windows_total(segments.total_bounds(views.recordings(spark, sf_dir), "station"), 6 * HOUR)


@query(with_views(BOUNDS + grid_sql(12 * HOUR, 9 * HOUR) + " SELECT station, wi AS \"window\", begin_us, end_us FROM win", "rec"))
def segments_total_sliding(spark, sf_dir):
    return segments.windows_total(segments.total_bounds(views.recordings(spark, sf_dir), "station"), 12 * HOUR, 0.25)


@query(kept_sql("SELECT station, strftime(make_timestamp(begin_us), '%Y_%m_%d_%H_%M_%S_%f') AS name, begin_us, end_us FROM kept"))
def segments_files(spark, sf_dir):
    kept = segments.windows_files(views.recordings(spark, sf_dir), "station")
    name = timestamps.format_name(F.timestamp_micros("begin_us"))
    return kept.select("station", name.alias("name"), "begin_us", "end_us")


ANCHOR = 2 * HOUR


@query(with_views(f"""
s AS (SELECT station, begin_us AS b, end_us AS e, row_number() OVER w AS rn, count(*) OVER (PARTITION BY station) AS n FROM rec WINDOW w AS (PARTITION BY station ORDER BY begin_us, end_us, id)),
f AS (SELECT station, rn, n, b AS a, e AS z, NULL::BIGINT AS oa, NULL::BIGINT AS oz FROM s WHERE rn = 1
  UNION ALL SELECT s.station, s.rn, s.n, CASE WHEN f.a + {ANCHOR} * (CAST(ceil((f.z - f.a) / {ANCHOR}.0) AS BIGINT) - 1) + {ANCHOR} >= s.b THEN f.a ELSE s.b END, s.e,
    CASE WHEN f.a + {ANCHOR} * (CAST(ceil((f.z - f.a) / {ANCHOR}.0) AS BIGINT) - 1) + {ANCHOR} >= s.b THEN NULL ELSE f.a END, f.z
  FROM f JOIN s ON s.station = f.station AND s.rn = f.rn + 1),
c AS (SELECT station, oa AS a, oz AS z FROM f WHERE oa IS NOT NULL UNION ALL SELECT station, a, z FROM f WHERE rn = n),
w AS (SELECT station, a, unnest(range(0, CAST(ceil((z - a) / {ANCHOR}.0) AS BIGINT))) AS wi FROM c WHERE z > a)
SELECT station, wi AS "window", a + wi * {ANCHOR} AS begin_us, a + wi * {ANCHOR} + {ANCHOR} AS end_us FROM w""", "rec", recursive=True))
def segments_file_anchored(spark, sf_dir):
    return segments.windows_file_anchored(views.recordings(spark, sf_dir), "station", ANCHOR)


POPULATED = BOUNDS + grid_sql(HOUR, HOUR) + ", " + KEPT + """,
p AS (SELECT w.station, w.begin_us, w.end_us, coalesce(sum(CASE WHEN k.id IS NOT NULL THEN least(w.end_us, k.end_us) - greatest(w.begin_us, k.begin_us) END), 0)::BIGINT AS populated_us, count(k.id) AS n_items
  FROM win w LEFT JOIN kept k ON w.station = k.station AND w.begin_us < k.end_us AND w.end_us > k.begin_us GROUP BY w.station, w.begin_us, w.end_us)
SELECT station, begin_us, end_us, populated_us, n_items, round(populated_us / (end_us - begin_us)::DOUBLE, 6) AS ratio FROM p"""


def _populated(spark, sf_dir):
    own = views.recordings(spark, sf_dir)
    return segments.populated_total(segments.total_bounds(own, "station"), timeline.remove_overlaps(own, "station"), "station", HOUR).drop("window")


@query(with_views(POPULATED, "rec", recursive=True))
def populated_ratio(spark, sf_dir):
    return _populated(spark, sf_dir)


@query(with_views(POPULATED + " WHERE round(populated_us / (end_us - begin_us)::DOUBLE, 6) > 0.25", "rec", recursive=True))
def drop_empty_segments(spark, sf_dir):
    return _populated(spark, sf_dir).where("ratio > 0.25")


@query(with_views(f"SELECT station, id, greatest(begin_us, {T0 + 48 * HOUR}) AS begin_us, least(end_us, {T0 + 96 * HOUR}) AS end_us FROM rec WHERE end_us >= {T0 + 48 * HOUR} AND begin_us < {T0 + 96 * HOUR}", "rec"))
def trim_begin_end(spark, sf_dir):
    return timeline.trim(views.recordings(spark, sf_dir), T0 + 48 * HOUR, T0 + 96 * HOUR)


@query(with_views("SELECT station, id, p::INTEGER AS part, begin_us + (end_us - begin_us) * p // 3 AS begin_us, begin_us + (end_us - begin_us) * (p + 1) // 3 AS end_us FROM rec, range(0, 3) t(p)", "rec"))
def split_equal(spark, sf_dir):
    return segments.split_equal(views.recordings(spark, sf_dir), 3)


@query(with_views("SELECT d.id, r.id AS recording_id, CAST(floor((greatest(d.begin_us, r.begin_us) - r.begin_us) * 48 / 1000000.0) AS BIGINT) AS start, CAST(round_even((least(d.end_us, r.end_us) - r.begin_us) * 48 / 1000000.0, 0) AS BIGINT) AS stop FROM det d JOIN rec r ON d.station = r.station AND d.begin_us < r.end_us AND d.end_us > r.begin_us", "rec", "det"))
def split_frames(spark, sf_dir):
    pairs = timeline.interval_join(views.detections(spark, sf_dir), views.recordings(spark, sf_dir), ["station"], JOIN_WIDTH)
    begin, end = timeline.clip(F.col("l_begin_us"), F.col("l_end_us"), F.col("r_begin_us"), F.col("r_end_us"))
    start, stop = segments.frame_bounds(F.col("r_begin_us"), begin, end, 48)
    return pairs.select(F.col("l_id").alias("id"), F.col("r_id").alias("recording_id"), start.alias("start"), stop.alias("stop"))


@query("SELECT event_id AS id, ntile(7) OVER (ORDER BY ts, event_id) - 1 AS batch FROM events")
def batch_ntile(spark, sf_dir):
    own = views.events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts_us")
    return segments.batches(own, ["ts_us", "id"], 7).select("id", "batch")


@query(with_views(f"SELECT station, id, {T0} + coalesce(sum(end_us - begin_us) OVER (PARTITION BY station ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_us FROM rec", "rec"))
def cumulative_begin(spark, sf_dir):
    own = views.recordings(spark, sf_dir).select("station", "id", (F.col("end_us") - F.col("begin_us")).alias("duration_us"))
    return segments.cumulative_begin(own, "station", "id", T0).select("station", "id", "begin_us")


# --- aggregates -----------------------------------------------------------------------------------


@query(with_views("c AS (SELECT station, CAST(round((end_us - begin_us) / 60000000.0) AS BIGINT) AS minutes, count(*) AS n FROM rec GROUP BY 1, 2) SELECT station, arg_min(minutes, (-n, minutes)) AS minutes FROM c GROUP BY station", "rec"))
def mode_duration(spark, sf_dir):
    minutes = F.round((F.col("end_us") - F.col("begin_us")) / MINUTE).cast("long")
    counted = views.recordings(spark, sf_dir).groupBy("station", minutes.alias("minutes")).count()
    return counted.groupBy("station").agg(F.min_by("minutes", F.struct(-F.col("count"), F.col("minutes"))).alias("minutes"))


@query("SELECT strftime(ts, '%Y_%m_%d_%H') AS name, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return views.events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy_MM_dd_HH").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query(with_views("SELECT station, min(begin_us) AS begin_us, max(end_us) AS end_us, count(DISTINCT id) AS n_files, bool_or(end_us = begin_us) AS any_empty, bool_and(end_us > begin_us) AS all_populated FROM rec GROUP BY station", "rec"))
def bounds_and_files(spark, sf_dir):
    empty = F.col("end_us") == F.col("begin_us")
    return views.recordings(spark, sf_dir).groupBy("station").agg(F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"), F.count_distinct("id").alias("n_files"), F.bool_or(empty).alias("any_empty"), F.bool_and(~empty).alias("all_populated"))


@query("SELECT user_id AS station, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS first_type FROM events GROUP BY user_id")
def first_match_lookup(spark, sf_dir):
    known = F.when(F.col("event_type") != "view", F.col("event_type"))
    place = F.when(known.isNotNull(), F.struct("ts", "event_id"))
    return views.events(spark, sf_dir).groupBy(F.col("user_id").alias("station")).agg(F.min_by(known, place).alias("first_type"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS hop, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def fft_groups(spark, sf_dir):
    hop = F.get_json_object("props", "$.k").cast("long") % 4
    return views.events(spark, sf_dir).groupBy("event_type", hop.alias("hop")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(with_views("SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, (row_number() OVER w - 1)::INTEGER AS place FROM rec WINDOW w AS (PARTITION BY station ORDER BY begin_us, id)", "rec"))
def neighbour_links(spark, sf_dir):
    found = ranges.neighbours(views.recordings(spark, sf_dir), "station", ["begin_us", "id"], "id")
    return found.select("id", F.col("previous").alias("previous_id"), F.col("next").alias("next_id"), F.col("place").cast("int").alias("place"))


# --- signals -------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("x").alias("n", "v")).select("id", "n", F.round("v", 6).alias("v"))


NORMS = "s AS (SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), a AS (SELECT id, n, v, v - avg(v) OVER (PARTITION BY id) AS c FROM s)"


@query(f"WITH {NORMS} SELECT id, n, round(c, 6) AS v FROM a")
def dc_reject(spark, sf_dir):
    return _rounded(signal.normalize(views.waveforms(spark, sf_dir), signal.DC_REJECT))


@query(f"WITH {NORMS} SELECT id, n, round(v / coalesce(nullif(max(abs(v)) OVER (PARTITION BY id), 0), 1), 6) AS v FROM a")
def peak_normalized(spark, sf_dir):
    return _rounded(signal.normalize(views.waveforms(spark, sf_dir), signal.PEAK))


@query(f"WITH {NORMS} SELECT id, n, round(c / coalesce(nullif(stddev_pop(v) OVER (PARTITION BY id), 0), 1), 6) AS v FROM a")
def zscore(spark, sf_dir):
    return _rounded(signal.normalize(views.waveforms(spark, sf_dir), signal.ZSCORE))


@query(f"WITH {NORMS} SELECT id, n, round(c / coalesce(nullif(max(abs(c)) OVER (PARTITION BY id), 0), 1), 6) AS v FROM a")
def combined_norm(spark, sf_dir):
    return _rounded(signal.normalize(views.waveforms(spark, sf_dir), signal.DC_REJECT | signal.PEAK))


@query(f"WITH {NORMS} SELECT id, round(avg(v), 6) AS mean, round(max(abs(v)), 6) AS peak, round(stddev_pop(v), 6) AS std FROM a GROUP BY id")
def norm_stats(spark, sf_dir):
    x = F.col("x")
    return views.waveforms(spark, sf_dir).select("id", F.round(signal.mean(x), 6).alias("mean"), F.round(signal.peak(x), 6).alias("peak"), F.round(signal.std_pop(x), 6).alias("std"))


CHAIN = signal.Instrument(sensitivity=0.5, peak_voltage=2.0, gain_db=6.0)


@query("SELECT event_id AS id, round(20 * log10((value + 1) * (2.0 / (0.5 * pow(10, 6.0 / 20))) / 1e-6), 6) AS level_db FROM events")
def calibrate_db(spark, sf_dir):
    level = 20 * F.log10(CHAIN.pressure(F.col("value") + 1) / F.lit(signal.PRESSURE_REFERENCE))
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.round(level, 6).alias("level_db"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'SPL_parameter' WHEN event_id % 3 = 1 THEN 'SPL_instrument' ELSE 'FS' END AS kind, round(10 * log10(value + 0.5) - 20 * log10(CASE WHEN event_id % 3 = 0 THEN 2.0 WHEN event_id % 3 = 1 THEN 1e-6 ELSE 1.0 END), 6) AS db FROM events")
def db_levels(spark, sf_dir):
    kind = F.col("event_id") % 3
    ref, name = signal.reference_level(F.when(kind == 0, 2.0), kind == 1)
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), name.alias("kind"), F.round(signal.decibels(F.col("value") + 0.5, ref), 6).alias("db"))


@query("WITH g AS (SELECT vec_id // 7 AS block, vec_id, embedding FROM embeddings WHERE vec_id % 7 NOT IN (0, 3)), f AS (SELECT DISTINCT block, unnest(range(0, 7 * 64)) AS n FROM g) SELECT f.block, count(*) AS n, count(CASE WHEN coalesce(CAST(g.embedding[f.n % 64 + 1] AS DOUBLE), 0) = 0 THEN 1 END) AS zeros, round(sum(coalesce(CAST(g.embedding[f.n % 64 + 1] AS DOUBLE), 0) * (f.n + 1)), 4) AS checksum FROM f LEFT JOIN g ON g.block = f.block AND g.vec_id % 7 = f.n // 64 GROUP BY f.block")
def gap_fill_zero(spark, sf_dir):
    from ..sources.wav import gap_filled

    own = views.waveforms(spark, sf_dir).where("id % 7 not in (0, 3)")
    items = own.select(F.floor(F.col("id") / 7).alias("block"), (F.col("id") % 7 * 64).cast("int").alias("offset"), "x")
    filled = gap_filled(items, F.lit(7 * 64), ["block"]).select("block", F.posexplode("x").alias("n", "v"))
    return filled.groupBy("block").agg(F.count("*").alias("n"), F.count(F.when(F.col("v") == 0, 1)).alias("zeros"), F.round(F.sum(F.col("v") * (F.col("n") + 1)), 4).alias("checksum"))


SECTIONS = signal.butterworth_sections(2, 8.0, "lowpass", 64.0)
_B0, _B1, _B2, _A1, _A2 = (repr(v) for v in SECTIONS[0])


@query(f"""WITH RECURSIVE s AS (SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
f AS (SELECT id, n, {_B0}::DOUBLE * v AS y, {_B1}::DOUBLE * v - {_A1}::DOUBLE * ({_B0}::DOUBLE * v) AS p, {_B2}::DOUBLE * v - {_A2}::DOUBLE * ({_B0}::DOUBLE * v) AS q FROM s WHERE n = 0
UNION ALL SELECT s.id, s.n, {_B0}::DOUBLE * s.v + f.p, {_B1}::DOUBLE * s.v - {_A1}::DOUBLE * ({_B0}::DOUBLE * s.v + f.p) + f.q, {_B2}::DOUBLE * s.v - {_A2}::DOUBLE * ({_B0}::DOUBLE * s.v + f.p) FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1)
SELECT id, n, round(y, 6) AS v FROM f""")
def butterworth_lowpass(spark, sf_dir):
    return _rounded(signal.filter_sections(views.waveforms(spark, sf_dir), SECTIONS))


@query("SELECT vec_id AS id, 48 AS n FROM embeddings")
def resample_counts(spark, sf_dir):
    return signal.resample(views.waveforms(spark, sf_dir), 64.0, 48.0).select("id", F.size("x").alias("n"))


# --- spectra -------------------------------------------------------------------------------------

FFT64 = spectral.Fft(tuple(spectral.hamming(64)), 32, 64.0, scale_to="magnitude")
FFT16 = spectral.Fft(tuple(spectral.hamming(16)), 8, 64.0)
FFT8 = spectral.Fft(tuple(spectral.hamming(8)), 8, 64.0)


def _hamming_sql(m: int, n: str = "n") -> str:
    return f"(0.54 - 0.46 * cos(2 * pi() * {n} / {m - 1}.0))"


def stft_sql(m: int, hop: int, low: int, high: int, gain: float = 1.0, source: str = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings", length: int = 64) -> str:
    """Squared magnitudes by the definition, as rows (id, p, k, power)."""
    return f"""z AS (SELECT id, p, n, coalesce(CASE WHEN p * {hop} - {m // 2} + n BETWEEN 0 AND {length - 1} THEN x[p * {hop} - {m // 2} + n + 1] END, 0) * {_hamming_sql(m)} * {gain!r}::DOUBLE AS v
  FROM ({source}) w, range({low}, {high}) a(p), range(0, {m}) b(n)),
power AS (SELECT id, p::INTEGER AS p, k::INTEGER AS k, pow(sum(v * cos(2 * pi() * k * n / {m}.0)), 2) + pow(sum(v * sin(2 * pi() * k * n / {m}.0)), 2) AS power FROM z, range(0, {m // 2 + 1}) c(k) GROUP BY id, p, k)"""


@query(f"WITH {stft_sql(64, 32, *FFT64.slices(64), gain=float(1 / spectral.hamming(64).sum()))} SELECT id, p, k, round(power, 6) AS power FROM power")
def stft_power(spark, sf_dir):
    return spectral.long_form(spectral.stft_power(views.waveforms(spark, sf_dir), FFT64)).select("id", "p", "k", F.round("power", 6).alias("power"))


WELCH_SQL = f"""seg AS (SELECT vec_id AS id, p, n, CAST(embedding[p * 8 + n + 1] AS DOUBLE) AS v FROM embeddings, range(0, 7) a(p), range(0, 16) b(n)),
dt AS (SELECT id, p, n, (v - avg(v) OVER (PARTITION BY id, p)) * {_hamming_sql(16)} AS v FROM seg),
px AS (SELECT id, p, k::INTEGER AS k, (pow(sum(v * cos(2 * pi() * k * n / 16.0)), 2) + pow(sum(v * sin(2 * pi() * k * n / 16.0)), 2)) * (CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / (64.0 * {float((spectral.hamming(16) ** 2).sum())!r}::DOUBLE) AS px FROM dt, range(0, 9) c(k) GROUP BY id, p, k)"""


@query(f"WITH {WELCH_SQL} SELECT id, k, k * 4.0::DOUBLE AS frequency, round(avg(px), 6) AS px FROM px GROUP BY id, k")
def welch_mean(spark, sf_dir):
    return spectral.welch(views.waveforms(spark, sf_dir), FFT16).withColumn("px", F.round("px", 6))


@query(f"WITH {WELCH_SQL} SELECT id, k, k * 4.0::DOUBLE AS frequency, round(median(px) / {spectral.median_bias(7)!r}::DOUBLE, 6) AS px FROM px GROUP BY id, k")
def welch_median(spark, sf_dir):
    return spectral.welch(views.waveforms(spark, sf_dir), FFT16, "median").withColumn("px", F.round("px", 6))


@query(f"WITH {WELCH_SQL} SELECT id % 10 AS station, round(avg(px) FILTER (k = 0), 6) AS f0, round(avg(px) FILTER (k = 4), 6) AS f4, round(avg(px) FILTER (k = 8), 6) AS f8 FROM px GROUP BY 1")
def welch_pivot(spark, sf_dir):
    px = spectral.welch(views.waveforms(spark, sf_dir), FFT16).withColumn("station", F.col("id") % 10)
    wide = px.groupBy("station").pivot("k", [0, 4, 8]).agg(F.avg("px"))
    return wide.select("station", *[F.round(F.col(f"`{k}`"), 6).alias(f"f{k}") for k in (0, 4, 8)])


_PART = "SELECT vec_id * 4 + c AS id, list_slice(CAST(embedding AS DOUBLE[]), (c * 16 + 1)::BIGINT, (c * 16 + 16)::BIGINT) AS x FROM embeddings, range(0, 4) t(c)"


@query(f"WITH {stft_sql(8, 8, *FFT8.slices(16), source=_PART, length=16)} SELECT id // 4 AS id, (id % 4)::INTEGER AS p, k, round(avg(power), 6) AS power FROM power GROUP BY 1, 2, 3")
def ltas(spark, sf_dir):
    return spectral.long_form(spectral.ltas(views.waveforms(spark, sf_dir), FFT8, bins=4)).select("id", "p", "k", F.round("power", 6).alias("power"))


@query(f"WITH {stft_sql(16, 8, *FFT16.slices(64))} SELECT id, p, k, round(power, 6) AS power FROM power")
def spectro_split_merge(spark, sf_dir):
    parts = spectral.split_stft(views.waveforms(spark, sf_dir), FFT16, 3)
    return spectral.merge_stft(parts).withColumn("power", F.round("power", 6))


SCALE = spectral.Scale((spectral.ScalePart(0.0, 0.5, 0.0, 8.0), spectral.ScalePart(0.5, 1.0, 8.0, 32.0, "log")))
_POINTS = ", ".join(f"({i}, {float(f)!r}::DOUBLE)" for i, f in enumerate(SCALE.map(9)))


@query(f"""WITH {stft_sql(16, 8, 2, 3)}, points(i, f) AS (VALUES {_POINTS}),
near AS (SELECT i, arg_min(k, (abs(k * 4.0 - f), k)) AS k FROM points, range(0, 9) t(k) GROUP BY i)
SELECT id, i::INTEGER AS i, round(power, 6) AS power FROM near JOIN power USING (k)""")
def scale_rescale(spark, sf_dir):
    one = spectral.stft_power(views.waveforms(spark, sf_dir), FFT16).where("p = 2")
    scaled = one.select("id", SCALE.rescale(F.col("power"), FFT16.frequencies).alias("power"))
    return scaled.select("id", F.posexplode("power").alias("i", "power")).withColumn("power", F.round("power", 6))


@query(f"""WITH {stft_sql(16, 8, *FFT16.slices(64))}, points(i, f) AS (VALUES {_POINTS}),
near AS (SELECT i, arg_min(k, (abs(k * 4.0 - f), k)) AS k FROM points, range(0, 9) t(k) GROUP BY i)
SELECT id, p, i::INTEGER AS i, round(power, 6) AS power FROM near JOIN power USING (k)""")
def scale_rescale_slices(spark, sf_dir):
    scaled = spectral.stft_power(views.waveforms(spark, sf_dir), FFT16).select("id", "p", SCALE.rescale(F.col("power"), FFT16.frequencies).alias("power"))
    return scaled.select("id", "p", F.posexplode("power").alias("i", "power")).withColumn("power", F.round("power", 6))


# --- text, time, annotations ------------------------------------------------------------------------


@query("SELECT event_id AS id, date_trunc('second', ts) AS stamp FROM events")
def parse_timestamp_templates(spark, sf_dir):
    own = views.events(spark, sf_dir)
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("7189."), F.date_format("ts", "yyMMddHHmmss"), F.lit(".wav"))).otherwise(F.concat(F.lit("a_"), F.date_format("ts", "yyyy-M-d_HH:mm:ss"), F.lit(".flac")))
    return own.select(F.col("event_id").alias("id"), timestamps.parse(name, ["7189.%y%m%d%H%M%S.wav", "_%Y-%-m-%-d_%H:%M:%S."]).alias("stamp"))


@query("SELECT event_id AS id, timezone('UTC', timezone('Europe/Paris', ts)) AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+0000' AS text FROM events")
def localize(spark, sf_dir):
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), timestamps.localize(F.col("ts"), "Europe/Paris").alias("utc"), timestamps.format_millis(F.col("ts")).alias("text"))


def _raw(spark, sf_dir) -> DataFrame:
    e = views.events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").cast("string").alias("annotation_id"), F.concat(F.col("ts").cast("string"), F.lit("+00:00")).alias("start_datetime"), F.concat(F.col("ts").cast("string"), F.lit("+00:00")).alias("end_datetime"),
        (k * 10).cast("string").alias("min_frequency"), (k * 10 + 5).cast("string").alias("max_frequency"), F.col("event_type").alias("annotation"),
        F.concat(k % 4, F.lit("/3")).alias("confidence_indicator_level"), F.when(k % 2 == 0, "SINGLE").otherwise("MULTIPLE").alias("signal_quantity"), F.lit("true").alias("signal_has_harmonics"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").alias("ana"), F.when(k % 5 == 0, "true").alias("ben"),
    )


DETECTED = "d AS (SELECT event_id AS annotation_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query(f"WITH {DETECTED} SELECT annotation_id, ts AS stamp, event_type AS label, 5.0::DOUBLE AS bandwidth, k % 4 AS level, 3 AS maximum, CASE WHEN k % 2 = 0 THEN true END AS harmonics, k % 4 > 3 AS bad FROM d")
def detections_nested(spark, sf_dir):
    d = det.parse(_raw(spark, sf_dir))
    return d.select(
        "annotation_id", F.col("begin").cast("timestamp_ntz").alias("stamp"), "label", (F.col("bounds.max_frequency") - F.col("bounds.min_frequency")).alias("bandwidth"),
        F.col("confidence.level.level").alias("level"), F.col("confidence.level.maximum").alias("maximum"), F.col("signal.has_harmonics").alias("harmonics"), (F.col("confidence.level.level") > F.col("confidence.level.maximum")).alias("bad"),
    )


@query(f"WITH {DETECTED} SELECT annotation_id, 'ana' AS verifier, k % 3 = 0 AS vote FROM d WHERE k % 3 < 2 UNION ALL SELECT annotation_id, 'ben', true FROM d WHERE k % 5 = 0")
def verification_unpivot(spark, sf_dir):
    return det.parse(_raw(spark, sf_dir)).select("annotation_id", F.explode("verifications").alias("verifier", "vote"))


@query(with_views("SELECT id, begin_us AS x_us, low AS y_hz, end_us - begin_us AS width_us, round(high - low, 6) AS height_hz, ['red', 'green', 'blue'][id % 3 + 1] AS colour FROM det WHERE high > 100", "det"))
def detection_boxes(spark, sf_dir):
    d = views.detections(spark, sf_dir).where("high > 100")
    boxed = d.select("id", *det.box(F.col("begin_us"), F.col("end_us"), F.col("low"), F.col("high")), det.colour(F.col("id"), ["red", "green", "blue"]).alias("colour"))
    return boxed.withColumn("height_hz", F.round("height_hz", 6))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS packed FROM events")
def json_roundtrip(spark, sf_dir):
    own = views.events(spark, sf_dir)
    parsed = F.from_json("props", "k BIGINT")["k"]
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return own.select(F.col("event_id").alias("id"), parsed.alias("k"), packed.alias("packed"))


@query("SELECT event_id AS id, printf('%02d:%02d:%02d', CAST(floor(value * 900) AS BIGINT) // 3600, CAST(floor(value * 900) AS BIGINT) % 3600 // 60, CAST(floor(value * 900) AS BIGINT) % 60) AS text FROM events")
def walltime_text(spark, sf_dir):
    return views.events(spark, sf_dir).select(F.col("event_id").alias("id"), timestamps.walltime(F.floor(F.col("value") * 900)).alias("text"))


# --- windows of a stream, in batch ----------------------------------------------------------------


@query("WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS b FROM events) SELECT event_type, b AS begin, b + INTERVAL 10 MINUTE AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def window_stream_counts(spark, sf_dir):
    return live.windowed_counts(views.events(spark, sf_dir), "ts", "event_type", "10 minutes", "5 minutes").withColumn("total", F.round("total", 4))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of every station with the share that recordings cover, empty ones left out."""
    return _populated(spark, sf_dir).where("ratio > 0")




from . import dataset_queries, long_queries  # noqa: E402, F401  they register their queries
