"""Words of whole Arrow batches as 64-bit hashes, without a Python object for each word.

A chunk is a run of consecutive rows of a batch, about ``CHUNK`` bytes of text; a longer text is
a chunk of its own. Every array below covers one chunk, so memory follows the chunk or the longest
text and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_U = np.uint64


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


LETTER = _letters(20240501)
STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of bytes outside of the given separators; all separators are ASCII, so UTF-8 stays whole.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_a : _b + 1] = False
# A-Z are lower-cased before words are taken.
ALNUM[65:91] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 2)
        for k, p in enumerate((STEP, STEP_INVERSE)):
            full = np.full(size, _U(p))
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Chunk:
    """first: row of the batch; data: bytes; at: byte offsets of the texts."""

    first: int
    data: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Chunk(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    """start, end: byte positions of the words in the chunk; hash: of the words; at: word offsets of the texts."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray


def words(chunk: Chunk, is_word: np.ndarray = SPACED) -> Words:
    data, n = chunk.data, len(chunk.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(chunk.rows + 1, np.int64))
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[chunk.at] = True  # words end with their text
    opens, closes = edge[:n] & inside, edge[1:] & inside
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[LOWER[data]] * power[:n], out=total[1:])
    return Words(start, end, mix((total[end] - total[start]) * inverse[start]), np.searchsorted(start, chunk.at))


_SLOT = _letters(77)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that start at each position; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _SLOT[j]
    return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a sequence shorter than a gram; sequences of different length differ."""
    return mix(np.array([(hashes * _SLOT[: len(hashes)]).sum(dtype=np.uint64) + _U(len(hashes))], np.uint64))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle, no words are none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return whole(hashes) if len(hashes) < k else np.unique(grams(hashes, k))
