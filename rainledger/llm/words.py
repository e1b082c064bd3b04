"""Words of texts as 64-bit numbers, for use inside Spark tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hashes a Python worker remembers; beyond that it starts anew. Larger tables are slower: they miss the processor's caches.
CACHE_WORDS = 50_000
#: Longer words are hashed each time: text without blanks is one long word.
KNOWN_BYTES = 64

#: Upper to lower for A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


#: The C library's way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: What each kind of work remembers in a worker.
_REMEMBERED: list[dict] = [_HASHES]


def forget(but: dict | None = None) -> None:
    """Free the remembered hashes, what other work remembers ``but`` one, and all unused memory."""
    for kept in _REMEMBERED:
        if kept is not but:
            kept.clear()
    give_back()


def remember_only(own: dict = _HASHES) -> None:
    """For a task that begins: its worker may hold what an earlier stage remembers, which would stay beside its own."""
    if all(kept is not own for kept in _REMEMBERED):
        _REMEMBERED.append(own)
    forget(own)


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; NULL as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def word_hashes(text: bytes) -> np.ndarray:
    """One number per word; words are split at ASCII white space, with A-Z as a-z."""
    words = text.translate(LOWER).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on each bit of the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number per run of ``size`` words, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mixed(total * _STEP + hashes[k : k + n])
    return total


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct numbers of a text's word shingles; of a shorter text, its whole sequence as one."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return windows(np.append(hashes, np.uint64(len(hashes))), len(hashes) + 1)
    return np.unique(windows(hashes, size))
