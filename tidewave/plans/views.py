"""The tables as timelines: the frames that the queries start from, and the same for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, id, begin_us, end_us): each event lasts ``value`` minutes."""
    length = F.round(F.col("value") * 60_000_000).cast("long")
    return events(spark, sf_dir).select(F.col("user_id").alias("station"), F.col("event_id").alias("id"), F.col("ts_us").alias("begin_us"), (F.col("ts_us") + length).alias("end_us"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, id, begin_us, end_us, low, high): errors last ``value`` seconds."""
    own = events(spark, sf_dir).where("event_type = 'error'")
    length = F.round(F.col("value") * 1_000_000).cast("long")
    low = F.get_json_object("props", "$.k").cast("double") * 10
    return own.select(
        F.col("user_id").alias("station"), F.col("event_id").alias("id"), F.col("ts_us").alias("begin_us"), (F.col("ts_us") + length).alias("end_us"), low.alias("low"), (low + F.col("value")).alias("high")
    )


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x): 64 samples at 64 Hz."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


SQL = {
    "rec": "SELECT user_id AS station, event_id AS id, epoch_us(ts) AS begin_us, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS end_us FROM events",
    "det": "SELECT user_id AS station, event_id AS id, epoch_us(ts) AS begin_us, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS end_us, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 AS low, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 + value AS high FROM events WHERE event_type = 'error'",
    "wav": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings",
    "samples": "SELECT vec_id AS id, unnest(range(0, len(embedding))) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"
