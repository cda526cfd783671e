"""Python-side helpers for operators that work on Arrow batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import xxhash

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None

TEXT_CHARS_A_STEP = 4_000_000
#: Words that a worker remembers; beyond that they are hashed anew, with the same results.
CACHE_WORDS = 200_000


def release() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, where its C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def steps(batches) -> Iterator[tuple[list, list[str]]]:
    """Identifiers and texts (columns 0 and 1) in steps of bounded text; a null text counts as empty."""
    release()
    yield from _steps(batches)
    release()


def _steps(batches) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        at, size = 0, 0
        held: list[str] = []
        for i in range(len(ids)):
            held.append(texts[i].as_py() or "")
            size += len(held[-1])
            if size >= TEXT_CHARS_A_STEP:
                yield ids[at : i + 1], held
                at, size, held = i + 1, 0, []
        if held:
            yield ids[at:], held


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __init__(self, clean=None):
        super().__init__()
        self.clean = clean

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(self.clean(word) if self.clean else word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the lower-cased texts, and the number of words of each text."""
        words = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.fromiter((self[w] for ws in words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
        return flat, sizes


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
