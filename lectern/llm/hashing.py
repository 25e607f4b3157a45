"""Word, shingle and n-gram fingerprints over whole Arrow batches of texts, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the temporary arrays (about 40 bytes for each byte of text).
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240531))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_POWER = np.uint64(_rng.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1))
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_LENGTH = np.uint64(_rng.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1))
_PERMUTE = _rng.integers(0, 1 << 64, 512, dtype=np.uint64) | np.uint64(1)

# A-Z hash as a-z.
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit over the word (the public splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and the last ends; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (bytes between ASCII white space, A-Z as a-z), and the index of each text's first word.

    A word's hash is a polynomial over random byte values modulo 2**64, then mixed.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE)))
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
        at = starts[a:b] - lo
        sizes = np.diff(np.append(at, hi - lo))
        place = np.arange(hi - lo) - np.repeat(at, sizes)
        powers = np.cumprod(np.full(int(place.max()) + 1, _POWER, np.uint64))
        value = _BYTE[data[lo:hi]] * powers[place]
        value[~solid[lo:hi]] = 0
        out[a:b] = np.add.reduceat(value, at)
        a = b
    return mix(out), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text in order, and the index of each text's first shingle.

    A text of 1 to ``k - 1`` words has one shingle, the whole of it; one without words has none.
    """
    count = np.diff(first)
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.append(0, np.cumsum(sizes))
    out = np.empty(begin[-1], np.uint64)
    full = np.flatnonzero(count >= k)
    if len(words) >= k and len(full):
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * _PLACE[j]
        rolled = mix(rolled + np.uint64(k) * _LENGTH)
        source = np.arange(sizes[full].sum()) + np.repeat(first[full] - np.append(0, np.cumsum(sizes[full]))[:-1], sizes[full])
        target = np.arange(sizes[full].sum()) + np.repeat(begin[full] - np.append(0, np.cumsum(sizes[full]))[:-1], sizes[full])
        out[target] = rolled[source]
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = words[first[i] : first[i + 1]]
        out[begin[i]] = mix((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)) * _LENGTH)[0]
    return out, begin


def minwise(hashes: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """For each non-empty text a row of minwise values (uint32), one for each random order of the shingles; empty texts get zeros."""
    out = np.zeros((len(begin) - 1, coordinates), np.uint32)
    some = np.flatnonzero(np.diff(begin))
    group = 0
    while group < len(some):
        # texts together while they hold at most 64 Ki shingles, so that the temporaries stay in cache
        last = max(group + 1, int(np.searchsorted(begin[some], begin[some[group]] + (1 << 16))))
        rows = some[group:last]
        part = hashes[begin[rows[0]] : begin[rows[-1] + 1]]
        at = begin[rows] - begin[rows[0]]
        for c in range(coordinates):
            out[rows, c] = np.minimum.reduceat(((part * _PERMUTE[c]) >> np.uint64(32)).astype(np.uint32), at)
        group = last
    return out


def distinct_sets(hashes: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i in range(len(begin) - 1):
        yield np.unique(hashes[begin[i] : begin[i + 1]])


def row_groups(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, one row at least."""
    texts = batch.column(column).cast(pa.large_string())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(ends, ends[a] + limit)) - 1))
        yield batch.slice(a, b - a)
        a = b
