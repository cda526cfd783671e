"""Best-fit packing of tokenised documents into training sequences.

Each piece is a vector (tokens, one document, attention cost = tokens squared) and each open
sequence a vector of residual capacities. Pieces go in decreasing length to the feasible sequence
whose residual vector scores best: the smallest weighted norm of what would stay free, or the largest weighted dot
product of the demand and what would be used (the residual's complement; the product with the residual itself would
choose the emptiest sequence). A sequence takes a piece only if every capacity allows it.

Tokenising runs where the rows are; only lengths and checksums leave it. Pieces are then dealt to
bins of bounded size by a hash of their identity, and each bin is packed by itself. The number of
bins follows the number of pieces, so no task grows with the input; each bin leaves at most a few
sequences partly filled out of thousands.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, table
from ._text import steps

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
CACHE_WORDS = 500_000
#: Characters whose chunks are looked up at once: few enough for the processor's caches, enough to fill lines of new words.
CHARS_AT_ONCE = 300_000


@dataclass(frozen=True)
class PackingLimits:
    """Capacities of one sequence and the weights of their residuals in the score.

    With the defaults the token capacity binds first: at most 4096 tokens hold at most 4096
    documents, and their squared lengths sum to at most 4096 squared.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0 * 4096.0
    weights: tuple[float, float, float] = (1.0, 0.02, 0.05)
    score: str = "norm"
    pieces_a_bin: int = 16_000

    def __post_init__(self) -> None:
        if self.score not in ("norm", "dot"):
            raise ValueError("score must be norm or dot")
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("capacities must be positive")
        if self.attention < self.tokens**2:
            raise ValueError("the attention capacity must admit one full piece")


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins characters across it, so ids are
    kept by the white-space-separated chunk. A new chunk is lower-cased (A-Z only) and parted from
    the ASCII marks that follow an ASCII letter, since the tokenizer parts them there itself; what is
    left is encoded. Words of Latin letters are single pieces for the tokenizer, each ending in the
    one id with an end-of-word mark, and are encoded many to a line. The caches stop growing at
    their bounds, which changes no result.
    """

    _TAIL = b".,;:!?|#$%&*()[]{}<>\"~_+=/\\@^-"
    _ASCII = frozenset(b"abcdefghijklmnopqrstuvwxyz")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Empties the caches, which would otherwise stay in the worker beside those of other operators."""
        self.chunks.clear()
        self.stems.clear()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha() and max(t) < "\u0250"]
        out: dict[bytes, bytes] = {}
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(part):
                raw, start = ids.tobytes(), 0
                for i, end in zip(part, cuts.tolist()):
                    out[words[i]] = raw[start:end]
                    start = end
        rest = [i for i in range(len(words)) if words[i] not in out]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[words[i]] = np.asarray(e.ids, dtype="<u4").tobytes()
        return out

    def _parts(self, chunk: bytes) -> tuple[bytes, bytes]:
        if b"<|" in chunk:  # may hold a special token, which is found before anything is parted
            return chunk, b""
        low = chunk.lower()
        stem = low.rstrip(self._TAIL)
        if stem and stem[-1] in self._ASCII:
            return stem, low[len(stem) :]
        return low, b""

    def _new(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that aren't kept yet; they are kept from now on while the bound allows it."""
        new = {c: self._parts(c) for c in chunks}
        wanted = {p for pair in new.values() for p in pair if p}
        known = self.stems
        fresh = self._encode([w for w in wanted if w not in known])
        if len(known) + len(fresh) <= CACHE_WORDS:
            known.update(fresh)
        else:
            fresh |= {w: known[w] for w in wanted if w in known}
            known = fresh
        found = {c: known[stem] + (known[tail] if tail else b"") for c, (stem, tail) in new.items()}
        if len(self.chunks) + len(found) <= CACHE_WORDS:
            self.chunks.update(found)
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = size = 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= CHARS_AT_ONCE or i == len(texts):
                out += self._some(texts[at:i])
                at, size = i, 0
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        chunks = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        flat = list(chain.from_iterable(chunks))
        ids = list(map(self.chunks.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            found = self._new({flat[i] for i in missing})
            for i in missing:
                ids[i] = found[flat[i]]
        ends = list(accumulate(map(len, chunks), initial=0))
        return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder, so that later tasks needn't load the tokenizer again."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, limits: PackingLimits, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """One row per piece: every document's ids, then ``end_id``, cut only where longer than a sequence."""
    cap = limits.tokens

    def pieces(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_ids(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        try:
            for ids, texts in steps(batches):
                out: list[tuple] = []
                for doc, raw in zip(ids, encode(texts)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * cap)):
                        cut = raw[at : at + 4 * cap]
                        out.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                doc, k, start, length, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:
            encode.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, limits: PackingLimits) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each piece, and the number of sequences.

    Pieces are taken by decreasing length, ties by position. Sequences with equal residual vectors
    are alike, so only distinct residual vectors are scored and one sequence of each is taken.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=float)
    weight = np.asarray(limits.weights, dtype=float)
    n = len(lengths)
    seq, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    # open residual vectors, one row per distinct vector; seqs[row] lists the sequences that have it
    free = np.empty((64, 3))
    rows, seqs, index = 0, [], {}
    used = 0
    fill: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        want = float(lengths[i])
        demand = np.array([want, 1.0, want * want])
        best = -1
        if rows:
            view = free[:rows]
            fits = np.flatnonzero((view[:, 0] >= want) & (view[:, 1] >= 1) & (view[:, 2] >= demand[2]))
            if len(fits):
                left = view[fits]
                if limits.score == "norm":
                    score = (((left - demand) / cap) ** 2) @ weight
                    best = int(fits[np.argmin(score)])
                else:
                    # the product of the demand and the used shares, which a small residual makes large
                    score = ((1 - (left - demand) / cap) * (demand / cap)) @ weight
                    best = int(fits[np.argmax(score)])
        if best < 0:
            s, before = used, tuple(cap)
            used += 1
            fill.append(0)
        else:
            s, before = seqs[best].pop(), tuple(free[best])
            if not seqs[best]:  # the last row takes the place of the emptied one
                del index[before]
                rows -= 1
                if best != rows:
                    free[best], seqs[best] = free[rows], seqs[rows]
                    index[tuple(free[best])] = best
                seqs.pop()
        seq[i], offset[i] = s, fill[s]
        fill[s] += int(want)
        after = (before[0] - want, before[1] - 1, before[2] - demand[2])
        if after[0] >= 1 and after[1] >= 1 and after[2] >= 1:
            at = index.get(after)
            if at is None:
                if rows == len(free):
                    free = np.concatenate([free, np.empty_like(free)])
                free[rows] = after
                index[after] = rows
                seqs.append([s])
                rows += 1
            else:
                seqs[at].append(s)
    return seq, offset, used


def pack(pieces: DataFrame, limits: PackingLimits = PackingLimits()) -> DataFrame:
    """Packs rows of ``PIECE_SCHEMA``; adds ``sequence_id`` and ``offset`` (gapless from 0).

    Defined results: an empty table gives an empty result; repeated rows are packed as often as they
    occur; pieces without an identifier are packed like others; a piece longer than the token
    capacity is refused, as ``tokenise_pieces`` never makes one.
    """
    total = pieces.count()
    bins = max(1, -(-total // limits.pieces_a_bin))

    def one(key, pdf):
        lengths = pdf["length"].to_numpy()
        if len(lengths) and lengths.max() > limits.tokens:
            raise ValueError("a piece is longer than a sequence")
        order = np.lexsort((pdf["ids_crc32"].to_numpy(), pdf["piece"].to_numpy(), pdf["doc_id"].fillna(-1).to_numpy()))
        pdf = pdf.iloc[order]
        seq, offset, _ = best_fit(pdf["length"].to_numpy(), limits)
        return pdf.drop(columns="bin").assign(sequence_id=seq + (int(key[0]) << 32), offset=offset)

    # the position keeps repeated rows and rows without an identifier from meeting in one bin
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("bin", F.pmod(place, F.lit(bins)).cast("long"))
    return dealt.groupBy("bin").applyInPandas(one, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: PackingLimits = PackingLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises and packs whole documents; a null text counts as empty and still has its end token."""
    return pack(materialise(tokenise_pieces(docs, tokenizer_path, limits, id_col, text_col), "pieces"), limits)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
