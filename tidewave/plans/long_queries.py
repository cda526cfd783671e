"""Queries in which one signal covers all recordings, worked on in pieces, each with the SQL that takes it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal, spectral
from ..operators import pieces, ranges
from ..operators.signals import Chain
from . import views
from .queries import FFT16, SECTIONS, _hamming_sql, query

BINS = 12


def _one_signal(spark, sf_dir) -> DataFrame:
    """All waveforms, one behind the other, each a piece."""
    own = views.waveforms(spark, sf_dir).withColumn("n", F.size("x").cast("long")).withColumn("_all", F.lit(0))
    placed = ranges.running_sum_before(own, "_all", ["id"], "n", "start")
    return placed.select(F.lit(0).cast("long").alias("id"), F.col("start").cast("long").alias("start"), F.lit(0).alias("channel"), "x")


#: The whole signal as rows (t, v), and its length.
WHOLE = """w AS (SELECT coalesce(sum(len(embedding)) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, embedding FROM embeddings),
s AS (SELECT start + n AS t, v FROM (SELECT start, unnest(range(0, len(embedding))) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM w)),
whole AS (SELECT count(*)::BIGINT AS n FROM s)"""

_B0, _B1, _B2, _A1, _A2 = (f"{v!r}::DOUBLE" for v in SECTIONS[0])

#: A filter as what it answers to a single 1: behind 400 samples its answer is below 1e-40.
FILTERED = f"""imp AS (SELECT 0 AS k, {_B0} AS y, {_B1} - {_A1} * {_B0} AS p, {_B2} - {_A2} * {_B0} AS q UNION ALL SELECT k + 1, p, q - {_A1} * p, -{_A2} * p FROM imp WHERE k < 400),
y AS (SELECT s.t + k AS t, sum(imp.y * s.v) AS y FROM s, imp, whole WHERE s.t + k < whole.n GROUP BY s.t + k)"""


@query(f"WITH RECURSIVE {WHOLE}, {FILTERED} SELECT t, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS v FROM y")
def long_chain(spark, sf_dir):
    """Filtered and standardised over the whole signal."""
    chain = Chain(sections=tuple(SECTIONS), normalization=signal.DC_REJECT | signal.ZSCORE)
    done = pieces.chain_pieces(_one_signal(spark, sf_dir), chain)
    return done.select("start", F.posexplode("x").alias("k", "v")).select((F.col("start") + F.col("k")).alias("t"), F.round("v", 6).alias("v"))


def _power_sql(frames: str, by: str) -> str:
    """Squared magnitudes of ``frames`` (by, n, v), as rows (by, k, power)."""
    return f"""power AS (SELECT {by}, k::INTEGER AS k, pow(sum(v * cos(2 * pi() * k * n / 16.0)), 2) + pow(sum(v * sin(2 * pi() * k * n / 16.0)), 2) AS power FROM {frames}, range(0, 9) c(k) GROUP BY {by}, k)"""


@query(f"""WITH {WHOLE}, z AS (SELECT p, b.n, coalesce(s.v, 0) * {_hamming_sql(16, "b.n")} AS v FROM (SELECT unnest(range(0, (n - 1 + 8) // 8 + 1)) AS p FROM whole) a CROSS JOIN range(0, 16) b(n) LEFT JOIN s ON s.t = p * 8 - 8 + b.n),
{_power_sql("z", "p")} SELECT p, k, round(power, 6) AS power FROM power""")
def long_stft(spark, sf_dir):
    """The slices of the whole signal; those over the borders of pieces too."""
    return pieces.stft_power_pieces(_one_signal(spark, sf_dir), FFT16).select("p", F.posexplode("power").alias("k", "power")).withColumn("power", F.round("power", 6))


@query(f"""WITH {WHOLE}, g AS (SELECT p, b.n, s.v FROM (SELECT unnest(range(0, (n - 16) // 8 + 1)) AS p FROM whole) a CROSS JOIN range(0, 16) b(n) JOIN s ON s.t = p * 8 + b.n),
z AS (SELECT p, n, (v - avg(v) OVER (PARTITION BY p)) * {_hamming_sql(16)} AS v FROM g), {_power_sql("z", "p")}
SELECT k, k * 4.0::DOUBLE AS frequency, round(avg(power) * (CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / (64.0 * {float((spectral.hamming(16) ** 2).sum())!r}::DOUBLE), 6) AS px FROM power GROUP BY k""")
def long_welch(spark, sf_dir):
    """Welch's estimate of the whole signal, summed where its pieces are."""
    return pieces.welch_pieces(_one_signal(spark, sf_dir), FFT16).select("k", "frequency", F.round("px", 6).alias("px"))


@query(f"""WITH RECURSIVE {WHOLE}, part(p, a, z, share) AS (SELECT k, n * k // {BINS}, n * (k + 1) // {BINS}, 1.0::DOUBLE FROM whole, range(0, {BINS}) r(k)
UNION ALL SELECT p, a + (z - a) * k // {BINS}, a + (z - a) * (k + 1) // {BINS}, share / {BINS} FROM part, range(0, {BINS}) r(k) WHERE (z - a - 1 + 8) // 16 + 1 > {BINS}),
leaf AS (SELECT p, a, z, share, (z - a - 1 + 8) // 16 + 1 AS slices FROM part WHERE z > a AND (z - a - 1 + 8) // 16 + 1 <= {BINS}),
f AS (SELECT p, a, z, share / slices AS share, unnest(range(0, slices)) AS i FROM leaf),
y AS (SELECT p, a, share, i, b.n, coalesce(s.v, 0) * {_hamming_sql(16, "b.n")} AS v FROM f CROSS JOIN range(0, 16) b(n) LEFT JOIN s ON s.t = a + i * 16 - 8 + b.n AND s.t >= a AND s.t < z),
{_power_sql("y", "p, a, share, i")} SELECT p::INTEGER AS p, k, round(sum(power * share), 6) AS power FROM power GROUP BY p, k""")
def long_ltas(spark, sf_dir):
    """Long-term averages of the whole signal, in twelve bins; parts beyond 500 samples are cut further over tasks."""
    found = pieces.ltas_pieces(_one_signal(spark, sf_dir), FFT16, BINS, part=500)
    return found.select("p", F.posexplode("power").alias("k", "power")).withColumn("power", F.round("power", 6))
