"""Benchmark passages inside documents, found by q-gram lemma filtering and banded alignment.

Texts are lower-cased and their white space is collapsed to single spaces. A benchmark item of m
characters may occur with k = floor(error_rate * m) edits. By the q-gram lemma such an occurrence
shares at least m + 1 - q * (k + 1) q-grams with the item, all on diagonals (document position less
item position) that differ by at most k. Diagonals are therefore counted in bands of 2 (k + 1),
each overlapping the next by half, so that every occurrence lies whole in one band. Bands that reach the bound
are verified by banded alignment, which gives the edit distance and the place.

The benchmark does not grow with the corpus. It is broadcast in blocks of bounded size; a larger
benchmark takes more passes over the documents, not more memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._text import _steps, release, steps

HITS = "doc_id long, item_id long, edits int, start long, end long"
BITMAP_BITS = 22
MAX_CELLS = 20_000_000


@dataclass(frozen=True)
class LemmaParameters:
    """``q`` is lowered for items so short that the lemma would ask for no shared q-gram; the budget of edits is
    ``error_rate`` of the length for every item."""

    q: int = 8
    error_rate: float = 0.1
    block_chars: int = 4_000_000

    def __post_init__(self) -> None:
        if self.q < 2 or not 0 <= self.error_rate < 1:
            raise ValueError("q must be at least 2 and error_rate in [0, 1)")

    def budget(self, m: int, q: int | None = None) -> int:
        """Edits allowed in an item of ``m`` characters."""
        return int(self.error_rate * m)

    def gram(self, m: int) -> int:
        """The q-gram length for an item of ``m`` characters: with it the lemma asks for one shared q-gram at least."""
        return min(self.q, m // (self.budget(m) + 1))


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, put together from those of 1, 2, 4, ... characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    part, size, done, h = codes, 1, 0, None
    while True:
        if q & size:
            piece = part[done : done + n]
            if h is None:
                h = piece.copy()
            else:
                h *= np.uint64(pow(base, size, 1 << 64))
                h += piece
            done += size
        if done == q:
            break
        step = part[:-size] * np.uint64(pow(base, size, 1 << 64))
        step += part[size:]
        part, size = step, 2 * size
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, free_start: bool) -> tuple[int, int]:
    """Least edits of the whole pattern against a stretch of the text, and where it ends.

    Only diagonals ``low`` to ``high`` (text position less pattern position) are computed. With
    ``free_start`` the stretch may begin anywhere, else at the start of the text.
    """
    width, far = high - low + 1, len(pattern) + len(text) + 1
    at = np.arange(width, dtype=np.int64)
    diagonal = at + low
    # beyond the text stand characters that match nothing, which cost what leaving out the pattern's costs
    before, behind = max(0, -low), max(0, len(pattern) + high - len(text))
    padded = np.concatenate([np.full(before, -1), text.astype(np.int64), np.full(behind, -1)])
    codes = pattern.astype(np.int64).tolist()
    row = np.zeros(width, dtype=np.int64) if free_start else np.where(diagonal >= 0, diagonal, far)
    for i, code in enumerate(codes):
        best = row + (padded[i + low + before : i + low + before + width] != code)
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        best -= at
        np.minimum.accumulate(best, out=best)
        best += at
        row = best
    k = int(np.argmin(row))
    return int(row[k]), min(len(text), len(pattern) + low + k)


def verify(item: np.ndarray, doc: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the item's best occurrence on the diagonals, or None beyond the budget."""
    if len(item) <= len(doc) and (at := doc.tobytes().find(item.tobytes())) >= 0 and at % doc.itemsize == 0:
        return 0, at // doc.itemsize, at // doc.itemsize + len(item)
    edits, end = banded_distance(item, doc, low - budget, high + budget, True)
    if edits > budget:
        return None
    # backwards from the end, where the occurrence must stop, to find its start
    _, length = banded_distance(item[::-1], doc[max(0, end - len(item) - budget) : end][::-1], -budget, budget, False)
    return edits, end - length, end


class _Index:
    """q-grams of one block of items that share a q."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, p: LemmaParameters):
        self.q, self.items = q, items
        self.size = np.array([len(c) for _, c in items])
        self.budget = np.array([p.budget(len(c)) for _, c in items])
        self.least = self.size + 1 - q * (self.budget + 1)
        grams = [_grams(c, q) for _, c in items]
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.gram, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.item, self.place = item[order], place[order]
        self.maybe = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.maybe[self.gram >> np.uint64(64 - BITMAP_BITS)] = True

    def hits(self, codes: np.ndarray):
        """Document position, item and item position of shared q-grams, in stretches of bounded size."""
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.maybe[grams >> np.uint64(64 - BITMAP_BITS)])
        k = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        found = self.gram[k] == grams[at]
        at, k = at[found], k[found]
        n = self.last[k] - self.first[k]
        where = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[where], self.place[where]

    def occurrences(self, codes: np.ndarray, starts: np.ndarray):
        """(document, item, edits, start, end) over documents laid end to end at ``starts``."""
        at, item, place = self.hits(codes)
        doc = np.searchsorted(starts, at, side="right") - 1
        group = doc * len(self.items) + item
        if len(starts) * len(self.items) <= MAX_CELLS:
            # all bands of a document and item together must reach the bound as well
            enough = np.bincount(group)[group] >= self.least[item]
            at, item, place, doc, group = at[enough], item[enough], place[enough], doc[enough], group[enough]
        step = self.budget[item] + 1
        diagonal = at - starts[doc] - place
        cell = np.floor_divide(diagonal, step)
        # a place of the item counts once in a band, and each hit lies in two bands; document and item, the band and the place
        # stay columns of their own, as their product may not fit into 64 bits
        groups, bands, places = np.concatenate([group, group]), np.concatenate([cell, cell - 1]), np.concatenate([place, place])
        order = np.lexsort((places, bands, groups))
        groups, bands, places = groups[order], bands[order], places[order]
        other = np.ones(len(groups), dtype=bool)
        other[1:] = (groups[1:] != groups[:-1]) | (bands[1:] != bands[:-1])
        new = other.copy()
        new[1:] |= places[1:] != places[:-1]
        first = np.flatnonzero(other)
        count = np.diff(np.append(np.cumsum(new)[first], new.sum() + 1))
        kept = first[count >= self.least[groups[first] % len(self.items)]]
        best: dict[tuple[int, int], tuple] = {}
        for who, band in zip(groups[kept].tolist(), bands[kept].tolist()):
            d, i = divmod(who, len(self.items))
            k = int(self.budget[i])
            low = band * (k + 1)
            text = codes[starts[d] : starts[d + 1] - 1]
            # only the stretch that the band can reach is aligned
            cut = max(0, low - k)
            reach = text[cut : max(cut, low + 3 * k + 2 + int(self.size[i]) + k)]
            got = verify(self.items[i][1], reach, low - cut, low - cut + 2 * k + 1, k)
            if got and ((d, i) not in best or (got[0], got[1] + cut) < best[d, i][:2]):
                best[d, i] = (got[0], got[1] + cut, got[2] + cut)
        return [(d, self.items[i][0], *v) for (d, i), v in best.items()]


def _indexes(items: list[tuple[int, str]], p: LemmaParameters) -> list[_Index]:
    """One index for each length of q-grams."""
    by_q: dict[int, list] = {}
    for item, text in items:
        codes = _codes(text)
        by_q.setdefault(p.gram(len(codes)), []).append((item, codes))
    return [_Index(own, q, p) for q, own in sorted(by_q.items())]


def _found(indexes: list[_Index], texts: list[str]) -> list[tuple]:
    """(place of the text, item, edits, start, end)."""
    norm = [normalise(t) for t in texts]
    # a private-use separator keeps q-grams from crossing documents
    codes = _codes("\U0010fffd".join(norm) + "\U0010fffd")
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in norm])]).astype(np.int64)
    return [hit for index in indexes for hit in index.occurrences(codes, starts)]


def _search(p: LemmaParameters, block):
    """The function for mapInArrow that finds the block's items in documents."""

    def run(batches):
        import pyarrow as pa

        indexes = _indexes(block.value, p)
        for ids, texts in steps(batches):
            out = [(ids[d], *rest) for d, *rest in _found(indexes, texts)]
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "edits", "start", "end"])

    return run


def _blocks(benchmark: DataFrame, p: LemmaParameters, item_col: str, text_col: str) -> list[list]:
    """The items, normalised, in blocks of bounded size; the benchmark does not grow with the corpus."""
    blocks: list[list] = [[]]
    size = 0
    own = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t")
    for item, text in own.toLocalIterator():
        text = normalise(text or "")
        if not text:
            continue
        if size + len(text) > p.block_chars and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((item, text))
        size += len(text)
    return [b for b in blocks if b]


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: LemmaParameters = LemmaParameters(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds no item, with all their columns. Each row is judged by its own
    text, whatever its identifier."""
    place, out = docs.columns.index(text_col), docs

    def without(block):
        def run(batches):
            import pyarrow as pa

            release()
            indexes = _indexes(block.value, p)
            for batch in batches:
                own = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(place).cast(pa.string())], names=["i", "t"])
                clean = np.ones(batch.num_rows, dtype=bool)
                for at, texts in _steps([own]):
                    clean[[at[d] for d, *_ in _found(indexes, texts)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in _blocks(benchmark, p, item_col, item_text_col):
        out = out.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, p: LemmaParameters = LemmaParameters(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that occurs in it: edits, and the best occurrence's
    start and end in code points of the normalised document.

    Defined results: null or empty documents hold nothing; null or blank items occur nowhere; an
    item and a document without identifiers are searched like others and give null identifiers;
    repeated rows give repeated results; of equal occurrences the first counts; either table may be
    empty; documents are searched whole; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = [rows.mapInArrow(_search(p, spark.sparkContext.broadcast(b)), HITS) for b in _blocks(benchmark, p, item_col, item_text_col)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], HITS)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
