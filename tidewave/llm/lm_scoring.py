"""Language-model scores by online logistic context mixing.

A text, lower-cased in A-Z, is coded byte by byte in its order and closed by an end mark. A byte (or the end
mark) is a path of bits in a binary code whose frequent symbols have short paths. Six predictors give a probability
for every bit, each by counts of the bits that followed a context of the running text: the last one to six
bytes, across the borders of words. A gate picks a set of weights by how much the predictors have seen and
how far the path has come; the weighted sum in the logistic domain is refined by an adaptive probability map.
The sum of the bits' logarithms is the score.

All predictions of a position follow from its last six symbols and its own, seven symbols of nine bits: a key of
63 bits, which is a hash of the contexts without collisions. So counting, learning and scoring go by the
distinct keys and not by positions. Texts lie in chunks. A chunk sends its distinct keys with their numbers in training
texts to shares of the table, dealt by the hash of the last three symbols, so that a share holds all
counts of the contexts from three symbols on; those of one and two symbols have at most 258 * 258 * 257
entries and are broadcast. Each share learns weights and map online over its keys in a fixed order, each as often as it
occurs and without its own occurrence; they are averaged over the shares, every share scores its keys with them, and each
chunk gets the scores of its keys back, as 16-bit floats (a key's logarithm is off by 1/2048 of itself at most, up or
down alike). Counts of words for the base score travel the same way. The table
grows with the corpus and is never held in one place. Keys travel packed, sorted and as differences.
"""

from __future__ import annotations

import gc
import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc32_of_id, drop_materialised, materialise, table
from ._text import mix

ORDERS = 6
#: The end mark and what stands before a text; symbols below are bytes.
END, BEFORE = 256, 257
WORDS, KEYS = 0, 1
#: The orders of which a share has all counts begin here; lower ones are broadcast.
OWN = 3
#: Bytes of a chunk, positions for each share of the table, most shares, and chunks whose keys are merged at once.
CHUNK, SHARE, MOST_SHARES, MERGED = 4_500_000, 16_000_000, 4_096, 512
DEPTHS, LEVELS, BUCKETS, BLOCK = 12, 20, 33, 1 << 14

U = np.uint64


@dataclass(frozen=True)
class MixingParameters:
    """``prior`` is added to both counts of a bit; ``rate`` is the first step of the weights, whose steps shrink with the
    gradients seen; ``batch`` keys are learnt from at once."""

    prior: float = 0.4
    rate: float = 0.1
    batch: int = 4_096


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


class Code:
    """A binary code of the symbols from how often they occur: frequent ones have short paths.

    By symbol and depth: ``bit`` and ``node`` (the inner node where the bit is decided); ``length`` and ``rank``
    (the place among all symbols from left to right); ``common``, by two ranks, is the length of the shared path.
    """

    def __init__(self, counts: np.ndarray):
        size = END + 1
        heap = [(int(n) + 1, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for inner in range(size, 2 * size - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (inner, 0), (inner, 1)
            heapq.heappush(heap, (a + b, inner))
        paths = []
        for s in range(size):
            path, at = [], s
            while at in parent:
                up, bit = parent[at]
                path.append((up - size, bit))
                at = up
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        depth = int(self.length.max())
        self.bit, self.node = np.zeros((size, depth), dtype=np.int8), np.zeros((size, depth), dtype=np.int64)
        for s, p in enumerate(paths):
            self.node[s, : len(p)], self.bit[s, : len(p)] = zip(*p)
        bits = [tuple(b for _, b in p) for p in paths]
        self.symbol = np.array(sorted(range(size), key=bits.__getitem__))
        self.rank = np.argsort(self.symbol)
        padded = np.where(np.arange(depth) < self.length[:, None], self.bit, -1)[self.symbol]
        self.common = np.argmin(np.concatenate([padded[:, None] == padded[None], np.zeros((size, size, 1), bool)], axis=2), axis=2).astype(np.int16)


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE, _STEP = 0x9E3779B97F4A7C15, 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2**64."""
    low = np.cumprod(np.concatenate([[U(1)], np.full(_STEP - 1, U(base))]))
    high = np.cumprod(np.concatenate([[U(1)], np.full(n // _STEP, U(pow(base, _STEP, 1 << 64)))]))
    return (high[:, None] * low).ravel()[:n]


class Laid:
    """Texts laid end to end: the key of each position and the text that it belongs to; the same for hashes of the words."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes + ORDERS + 1)
        self.raw = np.frombuffer(b"".join([x for t in texts for x in (b"\0" * ORDERS, t, b"\0")]), dtype=np.uint8)
        flat = self.raw.astype(np.uint16)
        flat[ends - 1] = END
        for k in range(ORDERS):
            flat[ends - 2 - sizes - k] = BEFORE
        self.flat, self.sizes = flat, sizes
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)

    def keys(self) -> np.ndarray:
        """Seven symbols: the latest before the position stands highest, the position's own lowest."""
        out, at = np.empty(len(self.owner), dtype=np.uint64), 0
        for a in range(0, len(self.flat) - ORDERS, 1 << 16):
            flat = self.flat[a : a + (1 << 16) + ORDERS].astype(np.uint64)
            two = flat[1:] << U(9)
            two |= flat[:-1]
            four = two[2:] << U(18)
            four |= two[:-2]
            six = four[2:] << U(18)
            six |= two[:-4]
            every = six[:-1] << U(9)
            every |= flat[ORDERS:]
            every = every[self.flat[a + ORDERS : a + ORDERS + len(every)] != BEFORE]
            out[at : at + len(every)] = every
            at += len(every)
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and of the ends, which are 0, and the text that each is from."""
        space = _SPACE[self.raw]
        space[self.flat > 255] = True
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # a text begins after spaces and ends with one
        begin, end = edge[::2], edge[1::2]
        run = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        value = self.raw.astype(np.uint64)
        value += U(1)
        value *= _powers(_BASE, len(self.raw))
        np.cumsum(value, out=run[1:])
        back = pow(_BASE, -1, 1 << 64)
        undo = _powers(back, _STEP)[begin % _STEP] * _powers(pow(back, _STEP, 1 << 64), len(self.raw) // _STEP + 1)[begin // _STEP]
        flat = mix((run[end] - run[begin]) * undo + (end - begin).astype(np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
        texts = len(self.sizes)
        stops = np.cumsum(self.sizes + ORDERS + 1)
        owner = np.searchsorted(stops, begin, side="right")
        return np.concatenate([flat, np.zeros(texts, dtype=np.uint64)]), np.concatenate([owner, np.arange(texts)])


def _planes(data: np.ndarray) -> bytes:
    """Compressed, all first bytes before all second bytes, and so on."""
    import pyarrow as pa

    width = data.dtype.itemsize
    return pa.compress(np.ascontiguousarray(data).view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True)


def _unplaned(m: int, data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=width * m, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, m).T).view(kind).ravel()


def _pack(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=keys.dtype.type(0)))


def _unpack(m: int, data: bytes, kind="<u8") -> np.ndarray:
    return np.cumsum(_unplaned(m, data, kind), dtype=kind)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def tally(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs in training texts (0: only in others)."""
    own, n = _counted(keys[trained])
    other, _ = _counted(keys[~trained])
    return _summed(np.concatenate([own, other]), np.concatenate([n, np.zeros(len(other), dtype=np.int64)]))


def share_of(kind: int, keys: np.ndarray, shares: int) -> np.ndarray:
    part = keys >> U(9 * (ORDERS + 1 - OWN)) if kind == KEYS else keys
    return ((mix(part) >> U(32)) * U(shares) >> U(32)).astype(np.uint16)


_ROW = "row long, doc_id long, train boolean, text string"


def _chunks(batches):
    """One row (``chunk``, ``size``, ``data``: its rows as a compressed Arrow stream) per chunk of rows; a longer text is a chunk of its own."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def packed(rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        size = rows.num_rows + (pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0)
        return pa.RecordBatch.from_arrays([pa.array([rows.column("row")[0].as_py()], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "data"])

    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > CHUNK:
                yield packed(pa.Table.from_batches([*held, batch.slice(at, i - at)]))
                at, size, held = i, 0, []
            size += n + 1
        if at < len(lengths):
            held.append(batch.slice(at))
    if held:
        yield packed(pa.Table.from_batches(held))


def _rows_of(data: bytes) -> tuple[list[int], list[int], np.ndarray, list[bytes]]:
    """Rows, identifiers, training flags and lower-cased texts of a chunk; a null text counts as empty."""
    import pyarrow as pa

    columns = pa.ipc.open_stream(data).read_all().to_pydict()
    return columns["row"], columns["doc_id"], np.array(columns["train"], dtype=bool), [lowered(x or "") for x in columns["text"]]


_SENT = "kind int, share int, chunk long, m long, codes binary, n binary"


def _tally(shares: int):
    """The distinct keys and words of each chunk with their numbers in its training texts, by share of the table."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, train, texts = _rows_of(data.as_py())
                laid = Laid(texts)
                for kind in (WORDS, KEYS):
                    keys, owner = laid.words() if kind == WORDS else (laid.keys(), laid.owner)
                    codes, n = tally(keys, train[owner])
                    share = share_of(kind, codes, shares)
                    order = np.argsort(share, kind="stable")
                    codes, n, ends = codes[order], n[order], np.searchsorted(share[order], np.arange(shares + 1))
                    full = [i for i in range(shares) if ends[i + 1] > ends[i]]
                    cuts = [slice(ends[i], ends[i + 1]) for i in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([c.stop - c.start for c in cuts], pa.int64()), pa.array([_pack(codes[c]) for c in cuts], pa.binary()), pa.array([_planes(n[c].astype("<u4")) for c in cuts], pa.binary())],
                        names=[x.split()[0] for x in _SENT.split(", ")],
                    )

    return run


_MERGED = "kind int, share int, part int, m long, codes binary, n binary, chunks array<struct<chunk:bigint,m:bigint,places:binary>>"


def _merge(key, rows):
    """The keys that some chunks sent to a share, once, and the place of each chunk's keys among them."""
    import pyarrow as pa

    sizes, chunks = rows.column("m").to_pylist(), rows.column("chunk").to_pylist()
    codes = np.concatenate([_unpack(m, d.as_py()) for m, d in zip(sizes, rows.column("codes"))])
    n = np.concatenate([_unplaned(m, d.as_py(), "<u4") for m, d in zip(sizes, rows.column("n"))]).astype(np.int64)
    order = np.argsort(codes)
    codes = codes[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    place = np.empty(len(codes), dtype=np.uint32)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    codes, n = codes[first], np.add.reduceat(n[order], first)
    ends = np.cumsum([0, *sizes])
    sent = [{"chunk": c, "m": m, "places": _pack(place[a:b])} for c, m, a, b in zip(chunks, sizes, ends, ends[1:])]
    kind, share, part = (k.as_py() for k in key)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("chunk", pa.int64()), ("m", pa.int64()), ("places", pa.binary())])))
    names = ["kind", "share", "part", "m", "codes", "n", "chunks"]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((kind, share, part, len(codes), _pack(codes), _planes(n), sent), kinds)], names=names)


_TABLE = "kind int, share int, m long, codes binary, n binary, total long, distinct long"


def _table(key, rows):
    """One share of the table: every key of the corpus, and its number in training texts."""
    import pyarrow as pa

    sizes = rows.column("m").to_pylist()
    codes, n = _summed(np.concatenate([_unpack(m, d.as_py()) for m, d in zip(sizes, rows.column("codes"))]), np.concatenate([_unplaned(m, d.as_py(), "<i8") for m, d in zip(sizes, rows.column("n"))]))
    row = (key[0].as_py(), key[1].as_py(), len(codes), _pack(codes), _planes(n), int(n.sum()), int((n > 0).sum()))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[x.split()[0] for x in _TABLE.split(", ")])


def _low(batches):
    """Numbers of the last two symbols with the next one (as ``code``), by share."""
    import pyarrow as pa

    for batch in batches:
        for m, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            keys, n = _unpack(m, codes.as_py()), _unplaned(m, n.as_py(), "<i8")
            code, n = _summed((keys >> U(45)) << U(9) | keys & U(511), n)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])


class Predictors:
    """Counts of all contexts of the given keys, read path by path: ``at(depth)``."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], code: Code, prior: float):
        self.code, self.prior = code, prior
        self.symbol = (keys & U(511)).astype(np.int64)
        rank = code.rank[self.symbol].astype(np.uint64)
        self.pairs, self.counts, self.pair = [], [], []
        low_keys, low_n = low
        low_ranked = (low_keys >> U(9)) << U(9) | code.rank[(low_keys & U(511)).astype(np.int64)].astype(np.uint64)
        for order in range(1, ORDERS + 1):
            own = (keys >> U(9 * (ORDERS + 1 - order))) << U(9) | rank
            if order < OWN:
                shown = low_ranked if order == 2 else (low_ranked >> U(18)) << U(9) | low_ranked & U(511)
                pairs, count = _summed(shown, low_n)
                pair = np.searchsorted(pairs, own)
            else:
                at = np.argsort(own)
                ordered = own[at]
                new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(at) else np.empty(0, dtype=bool)
                first = np.flatnonzero(new)
                pairs, count = ordered[first], np.add.reduceat(n[at], first) if len(at) else n
                pair = np.empty(len(at), dtype=np.int64)
                pair[at] = np.cumsum(new) - 1
            self.pairs.append(pairs)
            self.counts.append(count)
            self.pair.append(pair.astype(np.int32))

    def _paths(self, order: int):
        """For each depth, by pair: how often its context went on along its path so far, and one bit further."""
        pairs, n = self.pairs[order], self.counts[order]
        context, rank = pairs >> U(9), (pairs & U(511)).astype(np.int64)
        length = self.code.length[self.code.symbol][rank]
        alive = np.arange(len(pairs))

        def total(depth: int) -> np.ndarray:
            """Sums over the pairs of a context whose paths agree so far; they are neighbours."""
            r, c = rank[alive], context[alive]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (c[1:] != c[:-1]) | (self.code.common[r[:-1], r[1:]] < depth)
            first = np.flatnonzero(new)
            return np.repeat(np.add.reduceat(n[alive], first), np.diff(np.append(first, len(alive)))) if len(alive) else n[alive]

        before, depth = total(0), 0
        while len(alive):
            after = total(depth + 1)
            here, further = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            here[alive], further[alive] = before, after
            yield here, further
            kept = length[alive] > depth + 1
            alive, before, depth = alive[kept], after[kept], depth + 1

    def depths(self, without: int = 0):
        """For each depth: the positions of keys whose path is that long, their inputs, gates, bits and nodes.

        Inputs are in favour of the bit that came. ``without``: how many of a key's own occurrences are taken out.
        """
        walks = [self._paths(order) for order in range(ORDERS)]
        depth, length = 0, self.code.length[self.symbol]
        alive = np.arange(len(self.symbol))
        while len(alive):
            x = np.empty((len(alive), ORDERS), dtype=np.float32)
            level = []
            for order, walk in enumerate(walks):
                here, further = next(walk)
                own = np.maximum(further - without, 0)
                value = np.log((own + self.prior) / (here - further + self.prior)).astype(np.float32)
                pair = self.pair[order][alive]
                x[:, order] = value[pair]
                if order in (3, 5):
                    seen = np.log2(own + (here - further) + 1).astype(np.int8)
                    level.append((np.minimum(4, seen) if order == 5 else np.minimum(3, seen // 3))[pair])
            symbol = self.symbol[alive]
            gate = min(depth, DEPTHS - 1) * LEVELS + level[1].astype(np.int64) * 4 + level[0]
            yield alive, x, gate, self.code.bit[symbol, depth], self.code.node[symbol, depth]
            depth += 1
            alive = alive[length[alive] > depth]


class Mixer:
    """Weights by gate, and the adaptive probability map by node."""

    def __init__(self, values: np.ndarray | None = None):
        if values is None:
            grid = np.tile(np.linspace(-8, 8, BUCKETS), (END, 1))
            values = np.concatenate([np.full(DEPTHS * LEVELS * ORDERS, 0.25), 1 / (1 + np.exp(-grid)).ravel()])
        cut = DEPTHS * LEVELS * ORDERS
        self.weights = values[:cut].reshape(-1, ORDERS).copy()
        self.map = values[cut:].reshape(END, BUCKETS).copy()
        self.seen = np.full_like(self.weights, 1e-4)

    def values(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.map.ravel()])

    def predict(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, node: np.ndarray):
        """The mixed probability of the bits that came, the refined one, and where the map was read."""
        t = np.einsum("nj,nj->n", self.weights[gate], x)
        np.clip(t, -7.999, 7.999, out=t)
        p = 1 / (1 + np.exp(-t))
        # the map speaks of bits that are one
        place = (np.where(bit == 1, t, -t) + 8) * ((BUCKETS - 1) / 16)
        low = place.astype(np.int64)
        part = place - low
        cell = node * BUCKETS + low
        flat = self.map.reshape(-1)
        one = flat[cell] * (1 - part) + flat[cell + 1] * part
        return p, np.clip((p + np.where(bit == 1, one, 1 - one)) / 2, 1e-6, 1 - 1e-6), cell, part

    def learn(self, x, gate, bit, node, weight, rate: float) -> None:
        p, _, cell, part = self.predict(x, gate, bit, node)
        pull = (1 - p) * weight
        mass = np.bincount(gate, weights=weight, minlength=len(self.weights))
        hit = mass > 0
        for j in range(ORDERS):
            slope = np.bincount(gate, weights=pull * x[:, j], minlength=len(self.weights))[hit] / mass[hit]
            self.seen[hit, j] += slope * slope
            self.weights[hit, j] += rate * slope / np.sqrt(self.seen[hit, j])
        flat = self.map.reshape(-1)
        for shift, share in ((0, 1 - part), (1, part)):
            w = np.bincount(cell + shift, weights=weight * share, minlength=len(flat))
            y = np.bincount(cell + shift, weights=weight * share * bit, minlength=len(flat))
            at = np.flatnonzero(w)
            flat[at] += (y[at] / w[at] - flat[at]) * np.minimum(0.5, w[at] / (w[at] + 200.0))


def learnt(keys: np.ndarray, n: np.ndarray, low, code: Code, p: MixingParameters) -> Mixer:
    """Weights and map after one pass over the keys, in the order of their hashes, each as often as it occurred."""
    mixer = Mixer()
    # the counts are those of all keys; only the keys that occurred are learnt from
    said = Predictors(keys, n, low, code, p.prior)
    turn = np.empty(len(keys), dtype=np.int64)
    turn[np.argsort(mix(keys + U(1)))] = np.arange(len(keys))
    for alive, x, gate, bit, node in said.depths(1):
        own = np.flatnonzero(n[alive] > 0)
        own = own[np.argsort(turn[alive[own]])]
        for at in range(0, len(own), p.batch):
            cut = own[at : at + p.batch]
            mixer.learn(x[cut], gate[cut], bit[cut], node[cut], n[alive[cut]].astype(float), p.rate)
    return mixer


def scored(keys: np.ndarray, n: np.ndarray, low, code: Code, p: MixingParameters, mixer: Mixer) -> np.ndarray:
    """The log10 probability of each key's symbol after its context."""
    out = np.zeros(len(keys))
    for alive, x, gate, bit, node in Predictors(keys, n, low, code, p.prior).depths():
        for at in range(0, len(alive), BLOCK):
            cut = slice(at, at + BLOCK)
            out[alive[cut]] += np.log10(mixer.predict(x[cut], gate[cut], bit[cut], node[cut])[1])
    return out


def _shares(batches):
    for batch in batches:
        for m, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            yield m, codes.as_py(), _unpack(m, codes.as_py()), _unplaned(m, n.as_py(), "<i8")


def _learn(shared, p: MixingParameters):
    def run(batches):
        import pyarrow as pa

        for _, _, keys, n in _shares(batches):
            if n.any():
                values = learnt(keys, n, *shared.value, p).values()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values), pa.array([float(n.sum())] * len(values))], names=["k", "value", "mass"])

    return run


def _score(shared, mixed: np.ndarray, p: MixingParameters):
    def run(batches):
        import pyarrow as pa

        mixer = Mixer(mixed)
        for batch in batches:
            for i, (m, codes, keys, n) in enumerate(_shares([batch.select([0, 1, 2])])):
                said = _planes(scored(keys, n, *shared.value, p, mixer).astype("<f2"))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(3)[i].as_py()], pa.int32()), pa.array([m], pa.int64()), pa.array([codes], pa.binary()), pa.array([said], pa.binary())], names=["share", "size", "known", "said"])

    return run


_ANSWER = "chunk long, kind int, share int, m long, said binary"


def _answer(batches):
    """To each chunk, what a share says of the keys that the chunk sent, in their order."""
    import pyarrow as pa

    names = [x.split()[0] for x in _ANSWER.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    for batch in batches:
        for kind, share, m, codes, chunks, size, known, said in zip(*(batch.column(c) for c in ("kind", "share", "m", "codes", "chunks", "size", "known", "said"))):
            own, size = _unpack(m.as_py(), codes.as_py()), size.as_py()
            at = np.searchsorted(_unpack(size, known.as_py()), own)
            value = _unplaned(size, said.as_py(), "<i8" if kind.as_py() == WORDS else "<f2")[at]
            out = [(c["chunk"], kind.as_py(), share.as_py(), c["m"], _planes(value[_unpack(c["m"], c["places"], "<u4")])) for c in chunks.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)


_SCORED = "doc_id long, n_tokens long, n_known long, base double, score double, bytes long"


def _finish(shares: int):
    """Sums over each text of a chunk, by the answers of all shares."""

    def run(chunk, answers):
        import pyarrow as pa

        parts: dict[tuple[int, int], np.ndarray] = {}
        for kind, share, m, said in zip(answers.column("kind").to_pylist(), answers.column("share").to_pylist(), answers.column("m").to_pylist(), answers.column("said")):
            parts[kind, share] = _unplaned(m, said.as_py(), "<i8" if kind == WORDS else "<f2")

        def values(kind: int, keys: np.ndarray) -> np.ndarray:
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            codes, n = keys[first], np.diff(np.append(first, len(keys)))
            del keys, first
            by_share = np.argsort(share_of(kind, codes, shares), kind="stable")
            said = np.concatenate([parts[kind, i] for i in range(shares) if (kind, i) in parts])
            value = np.empty(len(codes), dtype=said.dtype)
            value[by_share] = said
            out = np.empty(len(order), dtype=said.dtype)
            out[order] = np.repeat(value, n)
            return out

        out = []
        for data in chunk.column("data"):
            _, docs, _, texts = _rows_of(data.as_py())
            laid = Laid(texts)
            flat, owner = laid.words()
            n = values(WORDS, flat)
            said = values(KEYS, laid.keys())
            sums = lambda o, w=None: np.bincount(o, weights=w, minlength=len(texts))
            columns = [pa.array(docs, pa.int64()), pa.array(sums(owner)), pa.array(sums(owner, n > 0).astype(np.int64)), pa.array(sums(owner, np.log10(n + 1))), pa.array(sums(laid.owner, said)), pa.array([len(t) for t in texts], pa.int64())]
            out.append(pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")]))
        return pa.Table.from_batches(out)

    return run


def _forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffles of frames that are gone once the JVM has collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, train: str, p: MixingParameters = MixingParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (log10
    probability by counts of tokens with one added), ``score`` (log10 probability of the whole
    lower-cased text by the mixed model) and ``bits_per_byte`` (null for empty texts).

    Learns from the documents whose Boolean column ``train`` is true (null counts as false); a training document
    is scored with its own counts in the table, as in the base score. Words are told apart by hashes of 64 bits.

    Defined results: a null text counts as empty and is scored as an end mark; rows are scored each,
    whatever their identifiers; without training documents the untrained model scores all; an empty
    table gives an empty result; texts are read whole; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(train), F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks, "chunk long, size long, data binary"), "lm-chunks")
    size, n_chunks = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shares, parts = min(MOST_SHARES, max(1, -(-size // SHARE))), max(1, -(-n_chunks // MERGED))
    sent = chunks.select("chunk", "data").mapInArrow(_tally(shares), _SENT).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    merged = materialise(sent.groupBy("kind", "share", "part").applyInArrow(_merge, _MERGED), "lm-merged")
    del sent
    _forget_shuffles(spark)
    whole = materialise(merged.select("kind", "share", "m", "codes", "n").groupBy("kind", "share").applyInArrow(_table, _TABLE), "lm-table")
    words, keys = whole.where(F.col("kind") == WORDS), whole.where(F.col("kind") == KEYS).select("m", "codes", "n", "share")
    n_all, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    # at most 258 * 258 * 257 rows, whatever the corpus
    low = keys.select("m", "codes", "n").mapInArrow(_low, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    low_keys, low_n = low["code"].to_numpy().astype(np.uint64), low["n"].to_numpy().astype(np.int64)
    code = Code(np.bincount((low_keys & U(511)).astype(np.int64), weights=low_n, minlength=END + 1))
    shared = spark.sparkContext.broadcast(((low_keys, low_n), code))
    learning = keys.select("m", "codes", "n").mapInArrow(_learn(shared, p), "k int, value double, mass double")
    means = learning.groupBy("k").agg((F.sum(F.col("value") * F.col("mass")) / F.sum("mass")).alias("value")).orderBy("k").collect()
    mixed = np.array([r["value"] for r in means]) if means else Mixer().values()
    said = keys.mapInArrow(_score(shared, mixed, p), "share int, size long, known binary, said binary").select(F.lit(KEYS).alias("kind"), "share", "size", "known", "said")
    counted = words.select("kind", "share", F.col("m").alias("size"), F.col("codes").alias("known"), F.col("n").alias("said"))
    spoken_of = materialise(said.unionByName(counted), "lm-said")
    drop_materialised(whole)
    _forget_shuffles(spark)
    asked = merged.select("kind", "share", "m", "codes", "chunks").join(spoken_of, ["kind", "share"])
    answers = asked.mapInArrow(_answer, _ANSWER)
    done = chunks.select("chunk", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(shares), _SCORED)
    return done.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n_all + distinct + 1)))).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(7)) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    scored_rows = score_documents(docs, "train")
    return scored_rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
