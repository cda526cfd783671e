"""Runs one transform of a project from the command line: ``python -m tidewave.plans.export --project F --name N --outputs audio welch``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .project import MODES, Project, Transform, flags


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--project", required=True)
    p.add_argument("--name", required=True)
    p.add_argument("--outputs", nargs="+", required=True, choices=["audio", "spectrum", "welch", "spectrogram"])
    p.add_argument("--mode", default="files", choices=MODES)
    p.add_argument("--duration-us", type=int)
    p.add_argument("--overlap", type=float, default=0.0)
    p.add_argument("--sample-rate", type=float)
    p.add_argument("--normalization", type=int, default=1)
    p.add_argument("--fft", type=json.loads, help="as JSON: win, hop, fs, mfft, scale_to")
    p.add_argument("--nb-ltas-time-bins", type=int)
    p.add_argument("--channels", type=int, nargs="*")
    p.add_argument("--butterworth", type=json.loads, help="as JSON: order, cut, kind")
    p.add_argument("--instrument", type=json.loads, help="as JSON")
    p.add_argument("--db-ref", type=float)
    p.add_argument("--detrend", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--source", default="original")
    p.add_argument("--partitions", type=int)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = vars(parser().parse_args(arguments))
    project, source, partitions = a.pop("project"), a.pop("source"), a.pop("partitions")
    a["outputs"], a["channels"] = flags(*a["outputs"]), tuple(a["channels"]) if a["channels"] else None
    spark = spark or SparkSession.builder.appName("export").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return Project(spark, project).run(Transform(**a), source, partitions)


if __name__ == "__main__":
    print("\n".join(main()))
