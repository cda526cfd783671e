"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of pairs of neighbours and of pairs with one word between them,
hashed into a fixed number of coordinates. Training follows the proximal leader with a learning rate
per coordinate and an L1 penalty, so nearly all weights are exactly zero; the rest, at most one per
coordinate, travel to the executors as a small broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc32_of_id, table
from ._text import WordHashes, _steps, mix, release, steps

#: Marks around a word that carry no meaning here.
MARKS = b".,;:!?|#$%&*()[]{}<>\"'`~_+=/\\-"


@dataclass(frozen=True)
class FtrlParameters:
    """``max_train_docs`` bounds the sample of labelled documents that training reads (a hash of the
    identifier chooses them); every document is scored."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    max_train_docs: int = 20_000


def _clean(word: bytes) -> bytes:
    return word.strip(MARKS) or word


def features(hashes: WordHashes, texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of the texts, and the position of the text that each is from."""
    flat, sizes = hashes.of(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    shift = np.uint64(64 - bits)
    one = mix(flat + np.uint64(1 << 32)) >> shift
    two = mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:] + np.uint64(2 << 40)) >> shift
    skip = mix(flat[:-2] * np.uint64(0xD6E8FEB86659FD93) + flat[2:] + np.uint64(3 << 40)) >> shift
    near, far = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    index = np.concatenate([one, two[near], skip[far]]).astype(np.int64)
    return index, np.concatenate([doc, doc[:-1][near], doc[:-2][far]])


def train(rows: list[tuple[np.ndarray, int]], p: FtrlParameters) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights, and the intercept."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    positive = sum(y for _, y in rows)
    bias, bias_n = float(np.log((positive + 0.1) / (len(rows) - positive + 9.9))) if rows else -4.6, 1.0
    for _ in range(p.epochs):
        for index, y in rows:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + root) / p.alpha + p.l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            n[index] = ni + g * g
            z[index] = zi + g - (np.sqrt(ni + g * g) - root) / p.alpha * w
            bias_n += g * g
            bias -= p.alpha / (p.beta + np.sqrt(bias_n)) * g
    kept = np.flatnonzero(np.abs(z) > p.l1)
    weights = (np.sign(z[kept]) * p.l1 - z[kept]) / ((p.beta + np.sqrt(n[kept])) / p.alpha + p.l2)
    return kept, weights, bias


def fit(docs: DataFrame, labels: DataFrame, p: FtrlParameters, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Trains in one task on at most ``max_train_docs`` labelled documents."""
    spark = docs.sparkSession
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total = max(1, own.count())
    share = min(1.0, 0.95 * p.max_train_docs / total)
    place = F.xxhash64("id", F.lit("toxicity"))
    chosen = own.where(F.pmod(place, F.lit(1 << 20)) < int(share * (1 << 20))).limit(p.max_train_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # chosen holds at most max_train_docs short rows; repeated documents count once
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit("order")), "id").select("y", "text")

    def learn(batches):
        import pyarrow as pa

        hashes, seen = WordHashes(_clean), []
        for ys, part in steps(batches):
            index, doc = features(hashes, part, p.bits)
            cuts = np.searchsorted(doc[order := np.argsort(doc, kind="stable")], np.arange(1, len(part)))
            seen += [(np.unique(x).astype(np.int32), int(y)) for x, y in zip(np.split(index[order], cuts), ys)]
        at, w, bias = train(seen, p)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], names=["at", "w"])

    model = rows.mapInArrow(learn, "at long, w double").toPandas()  # at most 2 ** bits + 1 rows
    bias = model.loc[model["at"] < 0, "w"]
    model = model[model["at"] >= 0]
    return model["at"].to_numpy(), model["w"].to_numpy(), float(bias.iloc[0]) if len(bias) else -4.6


def _totals(hashes: WordHashes, texts: list[str], dense: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Scores of texts by the weights of their distinct features."""
    index, doc = features(hashes, texts, bits)
    live = np.flatnonzero(dense[index])
    pair = np.unique((doc[live] << bits) | index[live])
    total = bias + np.bincount(pair >> bits, weights=dense[pair & ((1 << bits) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def keep_clean(docs: DataFrame, labels: DataFrame, p: FtrlParameters = FtrlParameters(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` does not predict to be toxic, with all their columns. Each row is judged by its
    own text, whatever its identifier."""
    at, w, bias = fit(docs, labels.select(id_col, label_col), p, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast((at, w, bias))
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        at, w, bias = model.value
        dense = np.zeros(1 << p.bits)
        dense[at] = w
        hashes = WordHashes(_clean)
        release()
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(place).cast(pa.string())], names=["i", "t"])
            scores = [_totals(hashes, texts, dense, bias, p.bits) for _, texts in _steps([own])]
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5)) if scores else batch

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, p: FtrlParameters = FtrlParameters(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str | None = None) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) for every row of ``docs``.

    Defined results: a null or empty text has the score of the intercept; labels that are null or
    have no identifier are ignored, of several labels of one document the highest counts; documents
    with a null identifier are scored like others; repeated rows are scored each; very long texts are scored whole; other
    columns, whatever their names, are not looked at; without labelled rows all scores are 0.01; an empty table gives an
    empty result. Scores depend on the text alone.
    """
    labels = labels.withColumnRenamed(label_id_col, id_col) if label_id_col else labels
    at, w, bias = fit(docs, labels.select(id_col, label_col), p, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast((at, w, bias))

    def score(batches):
        import pyarrow as pa

        at, w, bias = model.value
        dense = np.zeros(1 << p.bits)
        dense[at] = w
        hashes = WordHashes(_clean)
        for ids, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_totals(hashes, texts, dense, bias, p.bits))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
