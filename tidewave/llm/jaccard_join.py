"""Similarity join of documents on word n-grams: MinHash LSH forest, then exact verification.

A document is the set of its five-word shingles. Documents with equal sets are folded into one
class first, whatever their number and identifiers, so copies never meet each other as pairs. Each class has a
MinHash label in every tree of the forest; the classes whose labels in a tree begin alike are those below one node
of its prefix trie. The prefix is shortened from the whole label until the recall reaches its target: one trie,
at its full depth, gives the similarities of the pairs of a stated query set (classes whose identifier is divisible
by 20) with all classes, each weighted by the inverse of its chance to be seen there; from them follows the
share of links that the forest finds at each length, and the longest prefix that reaches the target is taken.
As the nodes of a shorter prefix contain those of every longer one, only that length's nodes are visited.

Pairs are never written out, as a group of near copies has a square number of them. Inside a bucket, sketches of
the MinHash values tell which members may reach the threshold (six standard deviations below it),
and only a spanning forest of these pairs leaves the bucket. Every pair at the threshold lies in one component of
the forests; components are cut into blocks, each pair of blocks compares its whole shingle sets
exactly, and only link counts and a spanning forest of the links leave it. Buckets and components of any size
are spread over tasks by pairs of blocks; a member of a group of m goes to m / 256 of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import materialise, table
from ._text import WordHashes, mix, steps

#: A candidate list up to this many rows (16 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Members of a block; buckets up to SMALL_BUCKET members are compared many at a time.
BUCKET_BLOCK, SET_BLOCK, SMALL_BUCKET = 1024, 256, 16
#: Pairs at the threshold that are taken for granted where the prefix length is chosen.
DOUBT = 10.0
#: Shingles that stand side by side in one dense matrix.
COLUMNS = 16_384


@dataclass(frozen=True)
class ForestParameters:
    words: int = 5
    threshold: float = 0.8
    trees: int = 32
    label: int = 8
    target_recall: float = 0.99999

    def recall(self, depth: int) -> float:
        """Chance that a pair at the threshold shares a prefix of this length in some tree."""
        return 1 - (1 - self.threshold**depth) ** self.trees

    @property
    def depth(self) -> int:
        """The longest prefix that reaches the target recall if all links lie at the threshold."""
        depth = self.label
        while depth > 1 and self.recall(depth) < self.target_recall:
            depth -= 1
        return depth

    def measured(self, similar: dict[int, int]) -> tuple[int, float]:
        """The longest prefix with the target recall, and that recall, for pairs seen in one trie at full depth:
        numbers by equal MinHash values of ``trees * label``. ``DOUBT`` pairs at the threshold are added to them, so that few
        pairs can't speak for all."""
        s = np.append(np.maximum(self.threshold, np.array(sorted(similar)) / (self.trees * self.label)), self.threshold)
        weight = np.append(np.array([similar[k] for k in sorted(similar)]) / s[:-1] ** self.label, DOUBT)
        for depth in range(self.label, 0, -1):
            recall = float((weight * (1 - (1 - s**depth) ** self.trees)).sum() / weight.sum())
            if recall >= self.target_recall or depth == 1:
                return depth, recall

    @property
    def screen(self) -> float:
        n = self.trees * self.label
        return max(0.0, self.threshold - 6 * (self.threshold * (1 - self.threshold) / n) ** 0.5)


def shingles(hashes: WordHashes, texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words is one shingle of all
    its words; a text without words has none."""
    flat, sizes = hashes.of(texts)
    ends = np.cumsum(sizes)
    out = []
    h = np.zeros(max(0, len(flat) - words + 1), dtype=np.uint64)
    for j in range(words):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += flat[j : j + len(h)]
    h = mix(h)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if size >= words:
            out.append(np.unique(h[end - size : end - words + 1]))
        elif size:
            short = np.append(flat[end - size : end], np.uint64(size)).tobytes()
            out.append(np.array([xxhash.xxh3_64_intdigest(short)], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` 32-bit MinHash values of each set; an empty set has zeros."""
    out = np.zeros((len(sets), n), dtype="<u4")
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        held = np.empty_like(flat)
        for j, a in enumerate(_multipliers(n)):
            np.multiply(flat, a, out=held)
            out[full, j] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return out


def _sign(p: ForestParameters):
    n = p.trees * p.label

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for marks, texts in steps(batches):
            ids, hashed = zip(*((m["doc_id"], m["text_hash"]) for m in marks))
            sets = shingles(hashes, texts, p.words)
            signed = signatures(sets, n)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashed, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in signed], pa.binary()), pa.array([s.astype(np.uint8).tobytes() for s in signed], pa.binary())],
                names=["doc_id", "text_hash", "set_key", "size", "signature", "sketch"],
            )

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def classes(docs: DataFrame, p: ForestParameters, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, text_hash, set_key) and classes (node, rep, copies, set_key, size, signature, sketch: one byte of
    each MinHash value), both materialised. ``node`` numbers the classes; ``rep`` is the least identifier."""
    marked = _rows(docs, id_col, text_col).select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("mark"), "text")
    signed = materialise(marked.mapInArrow(_sign(p), "doc_id long, text_hash long, set_key binary, size long, signature binary, sketch binary"), "signatures")
    kinds = signed.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("signature").alias("signature"), F.min("sketch").alias("sketch"))
    return signed.select("doc_id", "text_hash", "set_key"), materialise(kinds.withColumn("node", F.monotonically_increasing_id()), "classes")


def _groups(batches, keys: int):
    """Runs of rows with equal leading ``keys`` columns, across the borders of sorted Arrow batches."""
    import pyarrow as pa

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if not held.num_rows:
            continue
        key = [held.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        if len(new):
            yield held.slice(0, int(new[-1])), np.concatenate([[0], new]).astype(np.int64)
            held = held.slice(int(new[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows], dtype=np.int64)


def _forest(near, n: int) -> np.ndarray:
    """The least member of each member's component, by breadth-first search over ``near(i, others)``."""
    root = np.full(n, -1)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        queue = [first]
        left = np.flatnonzero(root < 0)
        while queue and len(left):
            found = near(queue.pop(), left)
            root[left[found]] = first
            queue += left[found].tolist()
            left = left[~found]
    return root


def _blocks(frame: DataFrame, size: str, block: int, key: list[str], carried: list[str]) -> DataFrame:
    """Deals each group (``key``, of ``size`` members) to its pairs of blocks; a row goes to each pair that its block is in."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    ready = frame.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    pair = ready.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *carried)
    return pair.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "node")


def _alike(p: ForestParameters):
    """Spanning forests of the pairs in a bucket whose sketches reach the screen."""
    n = p.trees * p.label
    least = int(np.ceil(p.screen * n))

    def run(batches):
        import pyarrow as pa

        for rows, cuts in _groups(batches, 3):
            nodes = rows.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, n)
            ends = np.append(cuts[cuts < len(nodes)], len(nodes))
            sizes = np.diff(ends)
            us, vs = [], []
            # small buckets, by their number of members, all at once
            for size in np.unique(sizes[sizes <= SMALL_BUCKET]):
                first = ends[:-1][sizes == size]
                for x in range(size):
                    for y in range(x + 1, size):
                        good = (sketch[first + x] == sketch[first + y]).sum(axis=1) >= least
                        us.append(nodes[first[good] + y])
                        vs.append(nodes[first[good] + x])
            for at, size in zip(ends[:-1][sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
                own = sketch[at : at + size]
                root = _forest(lambda i, others, own=own: (own[others] == own[i]).sum(axis=1) >= least, size)
                moved = np.flatnonzero(root != np.arange(size))
                us.append(nodes[at + moved])
                vs.append(nodes[at + root[moved]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _similar(p: ForestParameters):
    """How many pairs of a query and another member of a bucket have how many equal values, from the screen on."""
    n = p.trees * p.label
    least = int(np.ceil(p.threshold * n))

    def run(batches):
        import pyarrow as pa

        seen = np.zeros(n + 1, dtype=np.int64)
        for rows, cuts in _groups(batches, 3):
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, n)
            query, own = (rows.column(c).to_numpy() for c in ("query", "own"))
            same = rows.column("i").to_numpy() == rows.column("j").to_numpy()
            ends = np.append(cuts[cuts < len(query)], len(query))
            for a, b in zip(ends[:-1], ends[1:]):
                for q in np.flatnonzero(query[a:b]) + a:
                    alike = (sketch[a:b] == sketch[q]).sum(axis=1)
                    # a pair of one block meets in that block alone, one of two blocks where these two meet
                    other = np.ones(b - a, dtype=bool) if same[q] else own[a:b] != own[q]
                    other[q - a] = False
                    seen += np.bincount(alike[other], minlength=n + 1)
        kept = np.flatnonzero(seen * (np.arange(n + 1) >= least))
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(seen[kept])], names=["alike", "pairs"])

    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, len(values), COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, len(values) - low)), dtype=np.float32)
        dense[owner[a:b], place[a:b] - low] = 1
        out += dense @ dense.T
    return out


def _verify(p: ForestParameters):
    """Exact link counts between the members of a pair of blocks, and a spanning forest of the links."""

    def run(batches):
        import pyarrow as pa

        for rows, cuts in _groups(batches, 3):
            ends = np.append(cuts[cuts < rows.num_rows], rows.num_rows)
            out = []
            for at, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                part = rows.slice(at, end - at)
                nodes, own, copies = (part.column(c).to_numpy() for c in ("node", "own", "copies"))
                sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("shingles").to_pylist()]
                sizes = np.array([len(x) for x in sets])
                shared = _shared_counts(sets)
                link = shared >= p.threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
                np.fill_diagonal(link, False)
                if part.column("i")[0].as_py() != part.column("j")[0].as_py():
                    link &= own[:, None] != own[None, :]
                root = _forest(lambda i, others, link=link: link[i, others], len(nodes))
                out.append((nodes, link @ copies, link.sum(axis=1), nodes[root]))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "near", "classes", "root"])

    return run


def _below(own: DataFrame, tree, depth: int, carried: list[str], trees: int) -> DataFrame:
    """Classes by the node of their labels' prefix (``prefix``, of ``m`` classes), where it holds more than one."""
    label = F.expr(f"substring(signature, tree * int(length(signature) / {trees}) + 1, {4 * depth})")
    trie = own.select("node", "signature", tree.alias("tree")).select("node", F.xxhash64("tree", label).alias("prefix"))
    full = trie.groupBy("prefix").agg(F.count("*").alias("m")).where("m > 1")
    return trie.join(full, "prefix").join(own.select("node", *carried), "node")


def prefix_length(kinds: DataFrame, p: ForestParameters) -> tuple[int, float]:
    """The prefix length that the classes ask for, and the recall expected of it."""
    own = kinds.where(F.col("size") > 0).withColumn("query", F.coalesce(F.col("rep") % 20 == 0, F.lit(False)))
    met = _below(own, F.lit(0), p.label, ["sketch", "query"], p.trees)
    seen = _blocks(met, "m", BUCKET_BLOCK, ["prefix"], ["sketch", "query"]).mapInArrow(_similar(p), "alike long, pairs long")
    rows = seen.groupBy("alike").agg(F.sum("pairs").alias("pairs")).collect()  # one row per number of equal values
    return p.measured({r["alike"]: r["pairs"] for r in rows})


def link_counts(docs: DataFrame, kinds: DataFrame, p: ForestParameters, id_col: str, text_col: str) -> DataFrame:
    """Materialised rows (``node``, ``near``, ``classes``, ``root``), several per class: partial counts of
    linked rows and classes, and a class that it is connected to by links."""
    depth, _ = prefix_length(kinds, p)
    own = kinds.where(F.col("size") > 0)
    shared = _below(own, F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))), depth, ["sketch"], p.trees)
    edges = _blocks(shared, "m", BUCKET_BLOCK, ["prefix"], ["sketch"]).mapInArrow(_alike(p), "u long, v long")
    parts = materialise(connected_components(edges), "parts")
    sized = parts.join(parts.groupBy("root").agg(F.count("*").alias("m")), "root").select("node", F.col("root").alias("part"), "m")

    def to_sets(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for ids, texts in steps(batches):
            sets = shingles(hashes, texts, p.words)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])

    # rows with the identifier of a class in hand; of several texts under one identifier the key tells which is meant
    wanted = materialise(own.join(sized, "node").select("node", "part", "m", "rep", "copies", "set_key"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    # a null identifier shares its place with the least number there is; the keys part them
    place = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63))).alias("place")
    ids = wanted.select(place("rep")).distinct()
    rows = _rows(docs, id_col, text_col).select(place("doc_id"), "text")
    found = rows.join(F.broadcast(ids) if few else ids, "place", "left_semi").mapInArrow(to_sets, "set_key binary, shingles binary")
    sets = materialise(found.groupBy("set_key").agg(F.min("shingles").alias("shingles")), "sets")
    ready = wanted.select("node", "part", "m", "copies", "set_key").join(sets, "set_key").drop("set_key")
    return materialise(_blocks(ready, "m", SET_BLOCK, ["part"], ["copies", "shingles"]).mapInArrow(_verify(p), "node long, near long, classes long, root long"), "links")


def jaccard_groups(docs: DataFrame, p: ForestParameters = ForestParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash`` (xxhash64 of its text), ``class_no`` (a number of all that it is
    connected to by links), ``class_id`` (the least identifier among these), ``copy_id`` (least identifier with the same shingle set), ``n_links`` (other rows at the threshold
    or above, copies included) and ``n_class_links`` (other classes of copies at the threshold).

    Defined results: null and empty texts have no shingles and form one class of copies without
    links; texts shorter than a shingle match only texts of the same words; case and white space do
    not count; very long texts are compared whole; a row is told by its text, so rows with a null identifier are linked
    like others (``class_id`` and ``copy_id`` are null where no linked row has an identifier), several texts
    under one identifier are rows of their own, and equal rows are copies; other columns, whatever their names,
    are not looked at; an empty table gives an empty result.
    """
    members, kinds = classes(docs, p, id_col, text_col)
    found = link_counts(docs, kinds, p, id_col, text_col)
    counted = found.groupBy("node").agg(F.sum("near").alias("near"), F.sum("classes").alias("classes"))
    roots = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = roots.join(kinds.select("node", "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = named.join(least, "root").select("node", F.col("root").alias("linked"), "class_id")
    known = kinds.select("node", "set_key", "rep", "copies").join(counted, "node", "left").join(linked, "node", "left")
    known = known.select("set_key", F.coalesce("linked", "node").alias("class_no"), F.when(F.col("linked").isNotNull(), F.col("class_id")).otherwise(F.col("rep")).alias("class_id"), "rep", "copies", "near", "classes")
    full = members.join(known, "set_key")
    return full.select(
        "doc_id",
        "text_hash",
        "class_no",
        "class_id",
        F.col("rep").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("classes", F.lit(0)).cast("long").alias("n_class_links"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("text_hash", "class_no")
