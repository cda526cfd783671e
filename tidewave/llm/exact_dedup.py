"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised text, an external sort places equal texts side by
side, and each row is compared in full with its neighbour. The sort key is a bounded prefix of the
text, then its SHA-256, then the text itself, so that the sampled splitters stay small however long
the texts are.

A text with very many copies would fill one range. Such texts are counted beforehand with map-side
partial sums; there are at most ``4 * partitions`` of them by definition of the bound, so their
list (digest, count, survivor) is broadcast. Their rows are written once with a number each, which as a salt in the sort key
spreads them over several ranges, rows alike in all columns too, and tells apart which of such rows stays. Copies in
several ranges can't be neighbours, so those of a hot digest are compared in full
beforehand, each with the least and greatest text of its task and these with each other; a digest with
two texts is not salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialise, shuffle_partitions, table

PREFIX_CHARS = 48


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """Groups rows whose normalised texts are identical and names the row of each group that stays.

    ``keep`` is ``smallest`` or ``largest`` and says which identifier survives; ``normalise`` maps a
    text column to the column that is compared (default: no change).

    Returns one row per input row: ``row`` (a struct of all input columns, whatever their names),
    ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    Defined results: a null text counts as empty; null identifiers come after all others, so such a
    row stays only if its whole group has none; of rows repeated with the same identifier and text
    exactly one stays; an empty table gives an empty result; texts are compared whole.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"), F.col(text_col).isNull().alias("no_text"), F.col(id_col).alias("id"), text.alias("t")) if normalise is None else docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), F.lit(False).alias("no_text"), F.col(id_col).alias("id"), text.alias("t")
    )
    rows = rows.withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    # parts rows with one identifier by what else they hold, alike whenever it is computed
    whole = F.to_json("rest") if "map<" in rows.schema["rest"].dataType.simpleString() else F.col("rest")
    rows = rows.withColumn("mark", F.xxhash64(whole))

    bound = max(32, docs.count() // (4 * parts))
    best, named = (F.max, F.col("id").isNotNull()) if keep == "largest" else (F.min, F.col("id").isNull())
    survivor = best(F.struct(named.alias("named"), "id", "mark", "num"))
    often = rows.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") >= bound).select("sha")
    # both lists hold at most 4 * parts rows: more groups of that size do not fit into the table
    often = materialise(often, "often")
    key = ["prefix", "sha"]
    own = ["hot_n", "hot_id", "hot_num"]
    rows = rows.withColumn("num", F.lit(None).cast("long"))
    cold = rows.withColumns({"hot_n": F.lit(None).cast("long"), "hot_id": F.lit(None).cast(rows.schema["id"].dataType), "hot_num": F.lit(None).cast("long")})
    # a salt that is 0 for all would be folded away, and rows dealt by it dealt anew for the windows
    if often.isEmpty():
        rows = cold
    else:
        many = materialise(rows.join(F.broadcast(often), "sha").withColumn("num", F.monotonically_increasing_id()), "many")
        hot = many.groupBy("sha").agg(F.count("*").alias("hot_n"), survivor.alias("s"), (F.min("t") == F.max("t")).alias("same"))
        hot = hot.where("same").select("sha", "hot_n", F.col("s.id").alias("hot_id"), F.col("s.num").alias("hot_num"))
        many = many.join(F.broadcast(materialise(hot, "hot")), "sha", "left").select(*rows.columns, *own)
        rows = cold.join(F.broadcast(often), "sha", "left_anti").select(*rows.columns, *own).unionByName(many)
        key = [*key, "salt"]
    salt = F.when(F.col("hot_n").isNotNull(), F.pmod(F.col("num"), F.ceil(F.col("hot_n") / bound))).otherwise(F.lit(0))
    rows = rows.withColumn("prefix", F.substring("t", 1, PREFIX_CHARS)).withColumn("salt", salt.cast("long"))

    by = W.partitionBy(*key, "t")
    order = [F.col("id").desc_nulls_last(), F.col("mark").desc()] if keep == "largest" else [F.col("id").asc_nulls_last(), F.col("mark")]
    sorted_rows = rows.repartitionByRange(*key)
    found = (
        sorted_rows.withColumn("rank", F.row_number().over(by.orderBy(*order)))
        .withColumn("run_id", F.first("id").over(by.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("run_n", F.count("*").over(by))
    )
    keep_id = F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).otherwise(F.col("run_id"))
    return found.select(
        _row(docs, text_col, normalise).alias("row"),
        F.col("sha").alias("text_sha256"),
        keep_id.alias("keep_id"),
        F.coalesce("hot_n", "run_n").cast("long").alias("group_size"),
        F.when(F.col("hot_n").isNotNull(), F.col("num") == F.col("hot_num")).otherwise(F.col("rank") == 1).alias("kept"),
    )


def _row(docs: DataFrame, text_col: str, normalise) -> Column:
    """The input row, put together again from the sorted text and the rest."""
    if normalise is not None:
        return F.col("rest")
    whole = F.when(~F.col("no_text"), F.col("t"))
    return F.struct(*[whole.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = content_sort_dedup(docs, keep="largest")
    return out.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
