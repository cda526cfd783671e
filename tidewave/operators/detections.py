"""Annotations: CSV reading, nested rows, verification votes, predicates and boxes."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of annotation files; any other column is a verifier's vote.
TEXT = ("dataset", "project", "filename", "annotation", "annotator", "annotator_expertise", "type", "confidence_indicator_label", "confidence_indicator_level", "comments", "signal_quantity", "signal_trend", "created_at_phase")
NUMBERS = ("start_time", "end_time", "start_frequency", "end_frequency", "min_frequency", "max_frequency", "signal_start_frequency", "signal_end_frequency")
WHOLE = ("annotation_id", "is_update_of_id", "is_box", "signal_relative_min_frequency_count", "signal_relative_max_frequency_count", "signal_steps_count", "signal_frequency_jumps")
FLAGS = ("signal_is_intensity_too_low", "signal_does_overlap_other_signals", "signal_has_harmonics", "signal_sidebands", "signal_subharmonics", "signal_deterministic_chaos")
TIMES = ("start_datetime", "end_datetime")
REQUIRED = ("min_frequency", "max_frequency", *TIMES)
#: The type of each known column.
KINDS = {c: kind for kind, names in (("string", TEXT), ("double", NUMBERS), ("int", WHOLE), ("boolean", FLAGS), ("timestamp", TIMES)) for c in names} | {"annotation_id": "long", "is_update_of_id": "long"}
KNOWN = tuple(KINDS)


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files by their first line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("header"))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("path").collect():  # as many rows as paths were given
        found.setdefault(r["header"], []).append(unquote(r["path"]))
    return found


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as text columns, united by name; columns that a file lacks are null. Files with one header are one scan, however many they are; empty
    files count as none."""
    frames = [spark.read.option("header", True).csv(own) for own in headers(spark, paths).values()]
    if not frames:
        raise ValueError("no file has a header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def level(text: Column) -> Column:
    """``n/m`` as (level, maximum)."""
    part = F.split(text, "/")
    n, m = F.get(part, F.lit(0)).try_cast("int"), F.get(part, F.lit(1)).try_cast("int")
    return F.when(n.isNotNull() & m.isNotNull(), F.struct(n.alias("level"), m.alias("maximum")))


def votes(df: DataFrame) -> Column:
    """The columns that are no known ones, as a map from verifier to vote, without nulls."""
    others = [c for c in df.columns if c not in KNOWN]
    if not others:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))
    entries = F.array(*[F.struct(F.lit(c), F.col(f"`{c}`").cast("boolean")) for c in others])
    return F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull())


def parse(raw: DataFrame) -> DataFrame:
    """Typed, nested detections. Raises where a required column is missing; columns that are absent
    otherwise are null. Signal parameters are read only for single signals."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def col(name: str) -> Column:
        return F.col(name).cast(KINDS[name]) if name in raw.columns else F.lit(None).cast(KINDS[name])

    signal = F.struct(
        *[col(c).alias(c.removeprefix("signal_")) for c in ("signal_start_frequency", "signal_end_frequency")],
        *[col(c).alias(c.removeprefix("signal_")) for c in WHOLE if c.startswith("signal_")],
        *[col(c).alias(c.removeprefix("signal_")) for c in FLAGS],
        col("signal_trend").alias("trend"),
    )
    return raw.select(
        F.coalesce(col("dataset"), col("project")).alias("dataset"),
        col("filename").alias("filename"),
        col("annotation_id").alias("annotation_id"),
        F.to_timestamp("start_datetime").alias("begin"),
        F.to_timestamp("end_datetime").alias("end"),
        F.struct(col("min_frequency").alias("min_frequency"), col("max_frequency").alias("max_frequency")).alias("bounds"),
        col("annotation").alias("label"),
        F.struct(col("annotator").alias("name"), col("annotator_expertise").alias("expertise")).alias("annotator"),
        F.struct(col("confidence_indicator_label").alias("label"), level(col("confidence_indicator_level")).alias("level")).alias("confidence"),
        col("type").alias("type"),
        F.when(col("signal_quantity") == "SINGLE", signal).alias("signal"),
        votes(raw).alias("verifications"),
        col("comments").alias("comments"),
        col("created_at_phase").alias("phase"),
    )


def invalid(detections: DataFrame) -> DataFrame:
    """Rows that break a bound: times or frequencies out of order, negative, or a level past its maximum."""
    b, l = F.col("bounds"), F.col("confidence.level")
    wrong = (F.col("end") < F.col("begin")) | (b["min_frequency"] < 0) | (b["max_frequency"] < b["min_frequency"]) | (l["level"] > l["maximum"])
    return detections.where(F.coalesce(wrong, F.lit(False)))


def require_valid(detections: DataFrame) -> DataFrame:
    """The detections, if none breaks a bound; else the first that does is told."""
    wrong = invalid(detections).limit(1).collect()
    if wrong:
        raise ValueError(f"not a valid detection: {wrong[0].asDict(recursive=True)}")
    return detections


def select(detections: DataFrame, label: str | None = None, kind: str | None = None, confident: bool = False) -> DataFrame:
    """Detections with a label, of a type (WEAK, POINT, BOX), and, if wanted, of the highest confidence that their level allows."""
    kept = detections if label is None else detections.where(F.col("label") == label)
    kept = kept if kind is None else kept.where(F.col("type") == kind)
    level = F.col("confidence.level")
    return kept.where(level["level"] == level["maximum"]) if confident else kept


def describe(detection_id: Column, begin: Column, end: Column, low: Column, high: Column) -> Column:
    text = F.concat(begin.cast("string"), F.lit(" - "), end.cast("string"), F.lit(" ["), low.cast("string"), F.lit(" Hz - "), high.cast("string"), F.lit(" Hz]"))
    return F.coalesce(detection_id.cast("string"), text)


def box(begin_us: Column, end_us: Column, low: Column, high: Column) -> list[Column]:
    """Lower left corner, width and height."""
    return [begin_us.alias("x_us"), low.alias("y_hz"), (end_us - begin_us).alias("width_us"), (high - low).alias("height_hz")]


def colour(index: Column, palette: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in palette]), (index % len(palette)).cast("int"))
