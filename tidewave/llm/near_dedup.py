"""Near duplicates by a chosen-path similarity join of shingle sets.

Documents with equal sets are folded into one class first. A class is a sketch of 256 minwise tokens (their last
bytes), and goes down several independent trees. A node of a tree is a path of chosen tokens, which its classes share;
the path alone chooses the next ``branches`` positions of the sketch, and each class goes to the children
that its own tokens there name. Only the number of classes at a node is gathered, so nodes are as many rows as classes
stand in them. A small node below a small node is compared exhaustively, and so is one that a
branching does not thin out any more, as its classes are alike. With two branches a link at the threshold stays together
in a tree with at least the chance ``c = 1 - (1 - t * c) ** 2``, 0.9375 for t = 0.8, however deep the tree gets, so
the trees that a target recall asks for are a fixed number.

Exhaustive comparison never makes all pairs of a large group: its members are dealt to blocks, a few pivots stand in every
block, and what the blocks link is joined. Only members outside the largest component of their group that way
are then compared with all its blocks. First sketches (six standard deviations below the threshold), then whole sets
are compared like this; links are confirmed on whole sets only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, log

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import drop_materialised, materialise, table
from ._text import WordHashes, steps
from .jaccard_join import BROADCAST_ROWS, BUCKET_BLOCK, SET_BLOCK, ForestParameters, _forest, _groups, _shared_counts, shingles, signatures

SLOTS = 256
#: Members of a large group that stand in each of its blocks, about.
PIVOTS = 16
#: Levels after which nodes are compared whatever their size.
DEEPEST = 24


@dataclass(frozen=True)
class ChosenPathParameters:
    words: int = 2
    threshold: float = 0.8
    branches: int = 2
    first_levels: int = 3
    small: int = 8
    few: int = 200_000
    target_recall: float = 0.99999

    @property
    def together(self) -> float:
        """Chance that a link at the threshold stays together in one tree of any depth."""
        c = 1.0
        for _ in range(1_000):
            c = 1 - (1 - self.threshold * c) ** self.branches
        return c

    @property
    def trees(self) -> int:
        """Trees that reach the target recall."""
        c = self.together
        if c <= 0.01:
            raise ValueError("too few branches for this threshold: links would part on the way down")
        return 1 if c >= 1 else ceil(log(1 - self.target_recall) / log(1 - c))

    @property
    def alike(self) -> float:
        """A child that keeps this share of its parent is not thinned out any more."""
        return 0.9 * self.threshold

    @property
    def compared(self) -> ForestParameters:
        return ForestParameters(words=self.words, threshold=self.threshold, trees=SLOTS // 8, label=8)


class AsciiWords(WordHashes):
    """Words parted by ASCII white space, with A-Z lower-cased and no other character changed."""

    def of(self, texts: list[str]):
        words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.fromiter((self[w] for ws in words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
        return flat, sizes


def _sign(p: ChosenPathParameters):
    def run(batches):
        import pyarrow as pa

        hashes = AsciiWords()
        for marks, texts in steps(batches):
            ids, hashed = zip(*((m["doc_id"], m["text_hash"]) for m in marks))
            sets = shingles(hashes, texts, p.words)
            sketches = signatures(sets, SLOTS).astype(np.uint8)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array(hashed, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sketches], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set_key", "size", "sketch"])

    return run


def _place(column: str):
    """Identifiers to join on; a null one shares the place of the least number there is, and the texts part them."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))


def classes(docs: DataFrame, p: ChosenPathParameters, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, set_key, size) and classes of equal sets (node, set_key, rep: least identifier, first: a row of the class, size, sketch)."""
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(rows.mapInArrow(_sign(p), "doc_id long, text_hash long, set_key binary, size long, sketch binary"), "signed")
    row = F.struct(_place("doc_id").alias("place"), "text_hash")
    kinds = signed.where("size > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(row).alias("first"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    return signed.select("doc_id", "set_key", "size"), materialise(kinds.withColumn("node", F.monotonically_increasing_id()), "classes")


def tree_nodes(kinds: DataFrame, p: ChosenPathParameters) -> DataFrame:
    """(``group``, ``node``, ``m``): the classes at the ends of all trees, where ``m`` of them, two at least, meet. Ends that hold the
    same classes are one group."""
    sketches = kinds.select("node", "sketch")

    def grown(at: DataFrame) -> DataFrame:
        """The children of each row's node that its tokens name."""
        slot = F.pmod(F.xxhash64("path", "branch"), F.lit(SLOTS)).cast("int")
        both = at.withColumn("branch", F.explode(F.array(*[F.lit(k) for k in range(p.branches)]))).withColumn("slot", slot)
        return both.withColumn("parent", F.col("path")).withColumn("path", F.xxhash64("path", "branch", F.expr("substring(sketch, slot + 1, 1)"))).drop("branch", "slot")

    at = sketches.withColumn("path", F.explode(F.array(*[F.lit(k).cast("long") for k in range(p.trees)]))).withColumn("above", F.lit(None).cast("long"))
    for _ in range(p.first_levels - 1):
        at = grown(at)
    ends: list[DataFrame] = []
    levels: list[DataFrame] = []
    for level in range(p.first_levels, DEEPEST + 1):
        children = materialise(grown(at).drop("sketch"), f"level{level}")
        marks = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in range(2)]
        full = children.groupBy("path").agg(F.count("*").alias("m"), F.xxhash64(F.count("*"), *marks).alias("group")).where("m > 1")
        met = materialise(children.join(full, "path"), f"met{level}")
        drop_materialised(children)
        levels.append(met)
        if levels[:-1]:
            # a node that a child does not thin out is compared itself, once, in place of its children
            alike = met.where(F.col("m") >= F.ceil(p.alike * F.col("above"))).select("parent").distinct()
            ends.append(rest.join(alike.withColumnRenamed("parent", "path"), "path", "left_semi").select("group", "node", "m"))
            met = met.join(alike, "parent", "left_anti")
        # most small nodes hold classes that met by chance, so those of a small node only are compared
        end = F.coalesce((F.col("m") <= p.small) & (F.col("above") <= p.small), F.lit(False)) if level < DEEPEST else F.lit(True)
        ends.append(met.where(end).select("group", "node", "m"))
        rest = met.where(~end)
        left = rest.count()
        if left <= p.few:
            # further levels would cost more than comparing what is left
            ends.append(rest.select("group", "node", "m"))
            break
        at = rest.select("node", "path", F.col("m").alias("above")).join(sketches, "node")
    out = materialise(reduce(DataFrame.unionByName, ends).distinct(), "ends")
    for met in levels:
        drop_materialised(met)
    return out


def _forests(p: ChosenPathParameters, payload: str):
    """(key, i, node, root) of the members of each (key, i, j): the root is the least node that links inside it reach. Of groups that lie in one place
    only members with another root are told."""
    least = int(np.ceil(p.compared.screen * SLOTS))

    def roots_of_sketches(rows) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)

    def linked(rows, a: int, b: int, sketches: np.ndarray | None) -> np.ndarray:
        if sketches is not None:
            own = sketches[a:b]
            return _forest(lambda i, others: (own[others] == own[i]).sum(axis=1) >= least, b - a)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column(payload).slice(a, b - a).to_pylist()]
        sizes, shared = np.array([len(x) for x in sets]), _shared_counts(sets)
        link = shared >= p.threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        return _forest(lambda i, others: link[i, others], b - a)

    def run(batches):
        import pyarrow as pa

        for rows, cuts in _groups(batches, 3):
            nodes, whole = rows.column("node").to_numpy(), rows.column("whole").to_numpy()
            root = np.arange(len(nodes))
            sketches = roots_of_sketches(rows) if payload == "sketch" else None
            ends = np.append(cuts[cuts < len(nodes)], len(nodes))
            sizes = np.diff(ends)
            if sketches is not None:
                # pairs, most of all groups, at once
                twos = ends[:-1][sizes == 2]
                alike = (sketches[twos] == sketches[twos + 1]).sum(axis=1) >= least
                root[twos[alike] + 1] = twos[alike]
            for a, size in zip(ends[:-1].tolist(), sizes.tolist()):
                if size > 2 or size == 2 and sketches is None:
                    root[a : a + size] = a + linked(rows, a, a + size, sketches)
            told = np.flatnonzero(~whole | (root != np.arange(len(nodes))))
            key, i = (rows.column(k).to_numpy()[told] for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(i, pa.int32()), pa.array(nodes[told]), pa.array(nodes[root[told]])], names=["key", "i", "node", "root"])

    return run


def linked_within(frame: DataFrame, block: int, kernel, payload: str, disjoint: bool) -> DataFrame:
    """(``node``, ``root``) of the members (``node``) of groups (``key``, of ``m`` members) that links inside their groups join to others; the root
    is the least node that links reach. ``kernel``: as ``_forests``. ``disjoint``: no node is in two groups.

    A group of up to ``block`` members is compared in one place. A larger one is dealt to blocks, each with the group's pivots; those joined to
    the first pivot are one component, and the members outside it, if any, meet all blocks of the group. A group whose
    members are alike thus moves a number of rows in proportion to its members.
    """
    n = F.ceil(F.col("m") / block).cast("int")
    big = F.col("m") > block
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    pivot = big & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.ceil(F.col("m") / PIVOTS)) == 0)

    def compared(rows: DataFrame) -> DataFrame:
        ready = rows.select("key", "i", "j", "whole", "node", payload).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        return ready.mapInArrow(kernel, "key long, i int, node long, root long")

    first = frame.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))))
    found = materialise(compared(first.withColumn("j", F.lit(0)).withColumn("whole", ~big)), "found")
    edges = found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    large = materialise(frame.where(big).select("key", "node", "m", pivot.alias("pivot")), "large")
    if large.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if disjoint else connected_components(edges)
    groups = large.groupBy("key", "m").agg(F.min(F.when(F.col("pivot"), F.col("node"))).alias("pivot"))
    blocks = found.join(groups.select("key", "pivot"), "key")
    main = blocks.where("node = pivot").select("key", "i", F.col("root").alias("main"))
    inside = blocks.join(main, ["key", "i"], "left").groupBy("key", "node").agg(F.max(F.coalesce(F.col("root") == F.col("main"), F.lit(False))).alias("inside"))
    left = materialise(inside.where(~F.col("inside")).select("key", "node"), "left")
    counted = left.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("left_blocks")).join(groups.select("key", "m"), "key")
    all_rows = large.select("key", "node").join(counted, "key").select("key", "node", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), own.alias("j"))
    left_rows = left.join(counted, "key").select("key", "node", F.pmod(F.xxhash64("node", F.lit("left")), F.col("left_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    # one that stands on both sides of a place comes there once
    pairs = all_rows.unionByName(left_rows).distinct().withColumn("whole", F.lit(True)).join(frame.where(big).select("key", "node", payload), ["key", "node"])
    more = compared(pairs).select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not disjoint:
        return connected_components(edges.unionByName(more))
    # a group in one place is known already
    placed = found.join(groups.select("key"), "key", "left_anti").select("node", "root")
    rest = found.where("node <> root").join(groups.select("key"), "key", "left_semi").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return placed.unionByName(connected_components(rest.unionByName(more)))


def _candidates(kinds: DataFrame, p: ChosenPathParameters) -> DataFrame:
    """(``node``, ``key``, ``m``): groups of classes whose sketches, step by step, may be linked."""
    ends = tree_nodes(kinds, p).join(kinds.select("node", "sketch"), "node").withColumnRenamed("group", "key")
    parts = materialise(linked_within(ends, BUCKET_BLOCK, _forests(p, "sketch"), "sketch", disjoint=False), "parts")
    return parts.join(parts.groupBy("root").agg(F.count("*").alias("m")), "root").select("node", F.col("root").alias("key"), "m")


def _with_sets(docs: DataFrame, wanted: DataFrame, p: ChosenPathParameters, id_col: str, text_col: str) -> DataFrame:
    """The wanted classes with their shingles, from one row of each."""

    def to_sets(batches):
        import pyarrow as pa

        hashes = AsciiWords()
        for ids, texts in steps(batches):
            sets = shingles(hashes, texts, p.words)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])

    few = wanted.count() <= BROADCAST_ROWS
    named = wanted.select("first.place", "first.text_hash").distinct()
    rows = docs.select(_place(id_col).alias("place"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = rows.join(F.broadcast(named) if few else named, ["place", "text_hash"], "left_semi").select("place", "text")
    sets = found.mapInArrow(to_sets, "set_key binary, shingles binary").groupBy("set_key").agg(F.min("shingles").alias("shingles"))
    return materialise(wanted.join(sets, "set_key").select("node", "key", "m", "shingles"), "sets")


def near_duplicates(docs: DataFrame, p: ChosenPathParameters = ChosenPathParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` (size of its set of ``words``-word shingles), ``component_id`` (least identifier that
    links reach from it, itself included) and ``kept`` (it is that one).

    Words are parted by ASCII white space, A-Z are lower-cased. Defined results: a text of fewer words is one shingle;
    null texts and texts without words have no shingles and are linked with nothing; very long texts are taken whole; rows
    are told by their text, so that several texts under one identifier are linked each for itself, and rows without an identifier
    like others (``component_id`` is null, and they are kept, where nothing linked has one); of repeated rows with the
    least identifier all are kept; other columns are not looked at; an empty table gives an empty result.
    """
    members, kinds = classes(docs, p, id_col, text_col)
    wanted = materialise(_candidates(kinds, p).join(kinds.select("node", "set_key", "first"), "node"), "wanted")
    sets = _with_sets(docs, wanted, p, id_col, text_col)
    roots = linked_within(sets, SET_BLOCK, _forests(p, "shingles"), "shingles", disjoint=True)
    # the least node of a component is among its members as well
    roots = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "roots")
    linked = roots.join(kinds.select("node", "set_key", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    reached = linked.join(least, "root").select("set_key", F.struct("least").alias("reach"))
    known = kinds.select("set_key", "rep").join(reached, "set_key", "left")
    named = known.select("set_key", F.when(F.col("reach").isNull(), F.col("rep")).otherwise(F.col("reach.least")).alias("component_id"))
    out = members.where("size > 0").join(named, "set_key").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    out = out.unionByName(members.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) c ON c.x = w.doc_id
"""
