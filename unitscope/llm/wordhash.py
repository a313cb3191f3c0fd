"""Words and word shingles of Arrow text columns as numpy hashes, a whole batch at a time.

A word's hash is the sum of mixed pairs of a byte and its place in the word, and a shingle's that of mixed words at their places, so
that no rule of letters or words (as a polynomial modulo 2**64 has them) makes different texts alike. The cost does not depend
on how many words or documents the batch has. Hashes are equal in every process and run. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(salt)) | np.uint64(1)


_PLACE = seeds(64, 77)


@lru_cache(maxsize=4)
def _alphabet(kind: str) -> np.ndarray:
    """Value of each byte; 0 separates words. A-Z are as a-z. 'space': split at white space; 'alnum': keep digits, letters, non-ASCII."""
    byte = np.arange(256)
    if kind == "space":
        apart = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    else:
        apart = ~((byte >= 0x80) | ((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x41) & (byte <= 0x5A)) | ((byte >= 0x61) & (byte <= 0x7A)))
    lower = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    return np.where(apart, np.uint64(0), seeds(256, 5)[lower])


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `most` bytes; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, where each text's words start (one more entry than texts), and each word's first and end byte."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = _alphabet(kind)[data]
    inside = value != 0
    joined = np.zeros(n + 1, bool)
    joined[1:n] = inside[:-1] & inside[1:]
    joined[offsets] = False
    first = np.flatnonzero(inside & ~joined[:-1])
    end = np.flatnonzero(inside & ~joined[1:]) + 1
    sizes = end - first
    starts = np.cumsum(sizes) - sizes
    own = value[inside]
    own += (np.arange(len(own), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)) * _BASE
    own = (own ^ (own >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(29)
    hashes = mix(np.add.reduceat(own, starts) + sizes.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(first, offsets), first, end


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words of each text, in order, and where each text's runs start.

    A text with fewer words, but one at least, has its whole sequence as its one shingle."""
    counts = np.diff(starts)
    sizes = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_starts = np.concatenate([[0], np.cumsum(sizes)])
    short = np.flatnonzero((counts > 0) & (counts < size))
    # All runs over the batch, then those that stay inside one text.
    n = len(hashes)
    out = np.zeros(out_starts[-1], np.uint64)
    if n >= size:
        run = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            run += mix(hashes[k : n - size + 1 + k] * _PLACE[k])
        text = np.repeat(np.arange(len(counts)), counts)
        inside = text[: n - size + 1] == text[size - 1 :]
        mask = np.ones(len(out), bool)
        mask[out_starts[short]] = False
        out[mask] = mix(run[inside])
    for t in short:
        own = hashes[starts[t] : starts[t + 1]]
        out[out_starts[t]] = mix(mix(own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, out_starts
