"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_materialised, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


#: Parts into which the edges of a node are dealt where they are joined with its minimum.
SALTS = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours; a hub costs one partial minimum per task, and its edges
    meet the minimum in several tasks."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node that an edge (``u``, ``v``) names; the root is the least node.

    Alternates large-star and small-star steps until the edges no longer change: then each node
    points at its root. The number of steps is logarithmic in the number of nodes, each step moves
    each edge once, and no component is ever gathered in one place. Edges with a null end are ignored;
    loops only name their node; an empty table gives an empty result. Each step is written to the
    shared folder, so a lost executor costs the rest of one step.
    """
    clean = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    held = materialise(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(held.where("u = v")).distinct()
        star = _with_least(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).distinct()
        after_frame = materialise(small, "edges")
        drop_materialised(held)
        held, after = after_frame, _state(after_frame)
        if after == before:
            break
        before = after
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
