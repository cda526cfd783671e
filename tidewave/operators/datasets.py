"""Sets of data as tables: common and default parameters, slices, equality, links and groups by transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered


def mode_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column): the most frequent value of each key, the smallest of several; nulls do not count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def first_known(df: DataFrame, keys: list[str], column: str, order: list[str]) -> DataFrame:
    """(keys, column): the first value that is not null, in order."""
    place = F.when(F.col(column).isNotNull(), F.struct(*order))
    return df.groupBy(*keys).agg(F.min_by(column, place).alias(column))


def with_defaults(df: DataFrame, keys: list[str], common: list[str], first: list[str] = [], order: list[str] = []) -> DataFrame:
    """Fills nulls of the ``common`` columns by the most frequent value of their key, and of the ``first`` columns by the first one in order."""
    out = df
    for c in common:
        out = out.join(mode_of(df, keys, c).withColumnRenamed(c, "_own"), keys, "left").withColumn(c, F.coalesce(c, "_own")).drop("_own")
    for c in first:
        out = out.join(first_known(df, keys, c, order).withColumnRenamed(c, "_own"), keys, "left").withColumn(c, F.coalesce(c, "_own")).drop("_own")
    return out.select(df.columns)


def with_parameters(df: DataFrame, **values) -> DataFrame:
    """Sets the named parameters of all rows."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def inconsistent(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n_<column>): the keys where some column has more than one value, null counting as none."""
    counted = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    several = F.lit(False)
    for c in columns:
        several = several | (F.col(f"n_{c}") > 1)
    return counted.where(several)


def require_one(df: DataFrame, column: str):
    """The one value of a column (null if it has none); several are refused."""
    held = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(2).collect()]
    if len(held) > 1:
        raise ValueError(f"{column} has several values, such as {held[0]} and {held[1]}")
    return held[0] if held else None


def take(df: DataFrame, order: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """Rows [first, last) in order, with their ``place``; bounds below 0 count from the end."""
    rows = numbered(df, list(order))
    if first < 0 or (last is not None and last < 0):
        total = rows.count()
        first, last = max(0, first + total) if first < 0 else first, (max(0, last + total) if last < 0 else last) if last is not None else None
    kept = rows.where(F.col("place") >= first)
    return kept if last is None else kept.where(F.col("place") < last)


def filled(ratio: Column, threshold: float = 0.0) -> Column:
    """Whether the populated ``ratio`` is above the threshold; never null."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    return F.coalesce(ratio > threshold, F.lit(False))


def drop_empty(df: DataFrame, ratio: Column, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows whose populated ``ratio`` is above the threshold, and the others."""
    kept = filled(ratio, threshold)
    return df.where(kept), df.where(~kept)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur more often on one side: the columns, and ``surplus`` (above 0: more in ``a``). Nulls equal nulls."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the columns differ")
    every = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    return every.groupBy(*a.columns).agg(F.sum("_d").alias("surplus")).where("surplus <> 0")


def write_slice(df: DataFrame, path: str, order: list[str], name: str = "name", first: int = 0, last: int | None = None) -> None:
    """Writes rows [first, last) in order as Parquet; a name that occurs twice among them, or a path that exists, is refused."""
    rows = take(df, order, first, last).drop("place")
    twice = rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['n']} rows have the name {twice[0][0]!r}")
    rows.write.mode("errorifexists").parquet(path)


def equal(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()


def renamed(name: Column, default: Column, suffix: Column | str | None = None) -> Column:
    """An explicit name, else the default one, joined with a suffix by an underscore."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    own = F.coalesce(F.when(name != "", name), default)
    return own if suffix is None else F.concat_ws("_", own, F.when(suffix != "", suffix))


def link(data: DataFrame, audio: DataFrame, on: list[str] = ["begin_us", "end_us"], rate: str | None = None) -> DataFrame:
    """Joins each row of ``data`` to the one of ``audio`` with equal bounds. Rows without one are refused, and so are
    rates (column ``rate`` on both sides) that differ."""
    own = audio.select(*on, *[F.col(c).alias(f"audio_{c}") for c in audio.columns if c not in on])
    missing = data.join(own.select(on), on, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no audio has the bounds of {missing[0].asDict()}")
    linked = data.join(own, on)
    if rate and not linked.where(F.col(rate) != F.col(f"audio_{rate}")).isEmpty():
        raise ValueError("the rates of data and audio differ")
    return linked


def transform_groups(data: DataFrame, parameters: list[str], name: str = "name") -> DataFrame:
    """One row for each distinct set of transform parameters, with the sorted names of its data."""
    return data.groupBy(*parameters).agg(F.sort_array(F.collect_set(name)).alias("names"))


def by_membership(data: DataFrame, groups: DataFrame, name: str = "name", members: str = "names") -> DataFrame:
    """Each row of ``data`` with the parameters of the first group (by its parameters) that lists its name; names that no
    group lists have null parameters."""
    rest = [c for c in groups.columns if c != members]
    listed = groups.select(F.explode(members).alias(name), F.struct(*rest).alias("_g")).groupBy(name).agg(F.min("_g").alias("_g"))
    return data.join(listed, name, "left").select(*data.columns, *[F.col("_g").getField(c).alias(c) for c in rest])


def merged(stored: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The union of two catalogues; where both have a key, what is stored wins."""
    return stored.unionByName(held.join(stored.select(key), key, "left_anti"))


def single_window(bounds: DataFrame) -> DataFrame:
    """Without a duration: one window over the whole range of each row."""
    return bounds.withColumn("window", F.lit(0).cast("long"))
