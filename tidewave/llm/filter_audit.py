"""Audit of how document filters interact: what each order of them removes, and what each is worth over all orders.

A document is reduced to the mask of the filters that it fails; a part of the corpus to the counts of its masks (at
most 32). These give the part's removal polynomial, the multilinear extension of "how many documents go if
these filters are applied": ``f(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i))``. Its
values at the corners of the cube tell the survivors of any set of filters, so an order's steps are differences of corner
values. The Shapley value of a filter is the integral of its partial derivative along the diagonal, taken
with exact rationals; times 5! it is the sum of what the filter removes over all orders.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
#: Bit of the one condition that looks at other documents.
COPY = 16
#: Tasks over which documents without an identifier are dealt where labels are looked up.
NAMELESS = 1 << 20


def own_mask(text: Column, words: Column) -> Column:
    """The conditions that a text fails by itself, as bits: A 1, B 2, C 4, D 8."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(``part``, ``mask``, ``n``, ``good``, ``toxic``): documents of each part by the filters that they fail.

    Texts leave their first task as digests. Copies are counted before they meet: rows by identifier, then by digest
    and part, so that a text that a third of the rows hold is a few rows from there on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, SPACE, -1), "").alias("words"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), own_mask(F.col("text"), F.col("words")).alias("own"))
    # rows without an identifier have no label; their own salt keeps them from one place
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha", "part"), F.lit(NAMELESS)) + 1).otherwise(0).cast("int")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")).withColumn("salt", F.lit(0))
    marked = rows.withColumn("salt", salt).join(known, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "bad")})
    kinds = ["sha", "part", "own", "good", "bad"]
    each = marked.groupBy("id", "salt", *kinds).agg(F.count("*").alias("n"))
    named = F.col("id").isNotNull()
    alike = each.groupBy(*kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("n_named"), F.min(F.when(named, F.struct("id", "n"))).alias("least"))
    # a document is a copy if its identifier is above the least one of its text, wherever that one is
    often = alike.groupBy("sha").agg(F.min("least.id").alias("first"), F.sum("n").alias("all")).where("all > 1").select("sha", "first")
    whole = alike.join(often, "sha", "left")
    copies = F.when(F.col("first").isNull(), 0).otherwise(F.col("n_named") - F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    both = whole.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).withColumn("mask", F.explode(F.array(F.col("own"), F.col("own") + COPY)))
    n = F.when(F.col("mask") >= COPY, F.col("copies")).otherwise(F.col("n") - F.col("copies"))
    counts = both.withColumn("here", n).groupBy("part", "mask").agg(F.sum("here").alias("n"), F.sum(F.col("here") * F.col("good")).alias("good"), F.sum(F.col("here") * F.col("bad")).alias("toxic"))
    return counts.select("part", "mask", *[F.col(c).cast("long") for c in ("n", "good", "toxic")])


class RemovalPolynomial:
    """Multilinear polynomial of how many documents a set of filters removes; variables are the bits of a mask."""

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        self.coefficient = {}
        for term in range(1, 1 << filters):
            holding = sum(n for mask, n in counts.items() if mask & term == term)
            self.coefficient[term] = holding if term.bit_count() % 2 else -holding

    def corner(self, chosen: int) -> int:
        """How many documents go if the filters ``chosen`` are applied."""
        return sum(a for term, a in self.coefficient.items() if term & chosen == term)

    def shapley(self, bit: int) -> Fraction:
        """The integral over t from 0 to 1 of the derivative by one variable where all variables are t."""
        by_power = [0] * self.filters
        for term, a in self.coefficient.items():
            if term & bit:
                by_power[term.bit_count() - 1] += a
        return sum((Fraction(a, power + 1) for power, a in enumerate(by_power)), Fraction(0))


def orders(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """For one part, from (documents, good, toxic) by mask: a row for each order of the filters and each step in it."""
    polynomials = [RemovalPolynomial({m: c[k] for m, c in counts.items()}, len(letters)) for k in range(3)]
    everything = (1 << len(letters)) - 1
    total = sum(c[0] for c in counts.values())
    gone = [[p.corner(chosen) for chosen in range(everything + 1)] for p in polynomials]
    worth = {}
    for i in range(len(letters)):
        scaled = polynomials[0].shapley(1 << i) * factorial(len(letters))
        if scaled.denominator != 1:
            raise ArithmeticError("a sum over all orders is a whole number")
        worth[i] = scaled.numerator
    out = []
    for order in permutations(range(len(letters))):
        before, name = 0, "".join(letters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (g[after] - g[before] for g in gone)
            unique = gone[0][everything] - gone[0][everything ^ 1 << i]
            out.append((name, step, total - gone[0][after], removed, gone[0][1 << i] - removed, unique, good, toxic, worth[i]))
            before = after
    return out


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(batches):
    import pyarrow as pa

    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            rows = orders({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks})
            columns = [[part] * len(rows), *zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, each of the 120 orders of the filters A to E and each step: what is kept after it, what it removes, what it would
    have removed (``redundant``), documents that fail this filter alone, good and toxic documents removed here, and the filter's
    removals summed over all orders (``shapley``).

    A: under 200 words; B: distinct words under half of the words; C: over 2 % of the code points are A to Z; D: holds one of
    ``#$%&*|``; E: the text is also that of a smaller identifier anywhere in the table. Words are runs without white space (ASCII).

    Defined results: a null text counts as empty (it fails A only, or A and E); a null part counts as the empty part; a row
    without an identifier is no copy and makes no row a copy, and has no label; repeated rows count each, and share
    their identifier's labels, where one label of several is enough; of rows with the least identifier of a text none is a copy;
    texts are looked at whole; other columns are not looked at; an empty table gives an empty result.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 each
    return parts.mapInArrow(_audit, OUT)


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM x v, x w, x x, x y, x z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
s AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & b <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM r
"""
