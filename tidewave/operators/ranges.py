"""Rows in order without one global window: sorted ranges, numbered and written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``, else the warehouse; a temporary
    one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{tempfile.gettempdir()}/tidewave-scratch"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidewave_scratch"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tidewave-{tag}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps see the same rows; deleted when the driver ends."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Adds ``_part`` (the range of sorted rows that a row is in) and ``_at`` (rises along all ranges), written once, as
    sampled ranges need not come out alike twice."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")


def numbered(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Adds the number of each row in order, from 0: its number in its range, and the rows of the ranges before."""
    held = placed(df, order)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("_at")) - 1
    # one row per range
    return held.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def neighbours(df: DataFrame, key: str, order: list[Column | str], value: str) -> DataFrame:
    """Adds ``previous`` and ``next`` (the ``value`` of the key's neighbouring rows in order) and ``place`` (from 0): inside ranges, and
    at their borders from the ranges before and after."""
    held = placed(df, [F.col(key), *order])
    ends = held.groupBy(key, "_part").agg(F.min_by(value, "_at").alias("_first"), F.max_by(value, "_at").alias("_last"), F.count("*").alias("_n"))
    parts = W.partitionBy(key).orderBy("_part")
    ends = ends.select(key, "_part", F.lag("_last").over(parts).alias("_p"), F.lead("_first").over(parts).alias("_f"), F.coalesce(F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    inside = W.partitionBy(key, "_part").orderBy("_at")
    found = held.withColumns({"previous": F.lag(value).over(inside), "next": F.lead(value).over(inside), "place": F.row_number().over(inside) - 1})
    joined = found.join(ends, [key, "_part"])
    return joined.withColumns({"previous": F.coalesce("previous", "_p"), "next": F.coalesce("next", "_f"), "place": F.col("place") + F.col("_c")}).drop("_part", "_at", "_p", "_f", "_c")


def running_sum_before(df: DataFrame, key: str, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the key: inside ranges, and carried from range to range, so that
    a key with very many rows is spread over ranges."""
    held = placed(df, [F.col(key), *order])
    sums = held.groupBy(key, "_part").agg(F.sum(value).alias("_sum"))
    carry = sums.select(key, "_part", F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(key, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn(name, inside).join(carry, [key, "_part"]).withColumn(name, F.col(name) + F.col("_carry")).drop("_part", "_at", "_carry")
