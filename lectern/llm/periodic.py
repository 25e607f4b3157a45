"""Periodic runs of words, found by block convolution.

At scale B = 1, 2, 4, ... the words of a text are cut into aligned blocks of B. A run of period q, B <= q < 2B, with at
least four periods holds a whole aligned block near its begin, and that block occurs again q words later. So each block
is compared with the window of 2B words behind it: the sums of squared differences of word codes at all distances from
B to 2B - 1 come from one correlation by a number-theoretic transform modulo ``PRIME``. Codes have so few bits that no
sum reaches the prime, hence sums are exact integers, and zero means no mismatch of codes. Each such distance is a
seed: it is extended to both sides while words are equal, which also settles whether the words behind equal codes are
equal. Seeds inside a run of a smaller period, and inside a stretch that was extended for the same distance, give
nothing new.

A block goes through the transform only if each of its words, and of the next block's, occurs again at a distance
below 2B. In a run of four periods they all do, so this loses nothing; in other prose few blocks do.

All texts of an Arrow slice are treated as one sequence in which words of different texts always differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import hashing as H

#: A prime of the form c * 2**23 + 1, and a generator of its units.
PRIME, GENERATOR = 998244353, 3
#: The shortest run, in words and in periods.
LEAST, PERIODS = 6, 4
#: Numbers in a transform at a time.
CELLS = 1 << 20
NEVER = np.iinfo(np.int64).max >> 1

RUNS = "array<struct<start:long,length:long,period:long>>"


@lru_cache(maxsize=256)
def _powers(root: int, count: int) -> np.ndarray:
    """1, root, root**2, ... modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:count]


def forward(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two of numbers below the prime); results in bit-reversed order."""
    prime, size = np.uint64(PRIME), rows.shape[1]
    x = rows.astype(np.uint64)
    while size > 1:
        half = size // 2
        pairs = x.reshape(len(x), -1, 2, half)
        u, v = pairs[:, :, 0].copy(), pairs[:, :, 1]
        turn = _powers(pow(GENERATOR, (PRIME - 1) // size, PRIME), half)
        difference = (u + (prime - v)) * turn % prime
        pairs[:, :, 0] = (u + v) % prime
        pairs[:, :, 1] = difference
        size = half
    return x


def backward(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``."""
    prime, length = np.uint64(PRIME), rows.shape[1]
    x, size = rows.astype(np.uint64), 2
    while size <= length:
        half = size // 2
        pairs = x.reshape(len(x), -1, 2, half)
        turn = _powers(pow(GENERATOR, PRIME - 1 - (PRIME - 1) // size, PRIME), half)
        u, v = pairs[:, :, 0].copy(), pairs[:, :, 1] * turn % prime
        pairs[:, :, 0] = (u + v) % prime
        pairs[:, :, 1] = (u + (prime - v)) % prime
        size *= 2
    return x * np.uint64(pow(length, PRIME - 2, PRIME)) % prime


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each block of B codes and its window of 2B codes: the sum of squared differences at each of the B first places.

    The codes have to be small: B times the square of the largest is below the prime.
    """
    width = blocks.shape[1]
    turned = np.zeros(windows.shape, np.int64)
    turned[:, -np.arange(width) % windows.shape[1]] = blocks
    both = backward(forward(turned) * forward(windows) % np.uint64(PRIME))[:, :width].astype(np.int64)
    total = np.zeros((len(windows), windows.shape[1] + 1), np.int64)
    np.cumsum(windows * windows, axis=1, out=total[:, 1:])
    return (blocks * blocks).sum(axis=1)[:, None] + total[:, width : 2 * width] - total[:, :width] - 2 * both


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements from the begin are equal."""
    size = min(len(a), len(b))
    lo, step = 0, 64
    while lo < size:
        hi = min(size, lo + step)
        differ = a[lo:hi] != b[lo:hi]
        if differ.any():
            return lo + int(differ.argmax())
        lo, step = hi, step * 2
    return size


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """``start, length, period`` of all runs of a sequence of word numbers, as rows by start and period; no run is longer than ``longest``."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.full(n, NEVER)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: list[tuple[int, int, int]] = []
    block, farthest = 1, again
    while PERIODS * block <= longest:
        bits = (29 - block.bit_length() + 1) // 2
        near = farthest < 2 * block
        at = np.flatnonzero(near[:-1] & near[1:]) * block
        if len(at):
            # the end of the known run that covers a block farthest; a seed inside it has that run's period
            end = np.zeros(len(farthest) + 1, np.int64)
            for start, length, _ in found:
                if length >= 2 * block:
                    lo, hi = -(-start // block), (start + length) // block
                    np.maximum(end[lo:hi], start + length, out=end[lo:hi])
            at = at[end[at // block] < at + 3 * block - 1]
            tested: dict[int, tuple[int, int]] = {}
            group = max(1, CELLS // (2 * block))
            for lo in range(0, len(at), group):
                for place, distance in _seeds(words, at[lo : lo + group], block, (1 << bits) - 1):
                    if place + distance + block <= end[place // block]:
                        continue
                    begin, stop = tested.get(distance, (0, 0))
                    if begin <= place and place + block <= stop:
                        continue
                    right = place + _equal_ahead(words[place:], words[place + distance :])
                    if right < place + block:  # equal codes, other words
                        continue
                    left = place - _equal_ahead(words[:place][::-1], words[distance : place + distance][::-1])
                    tested[distance] = left, right
                    if right + distance - left >= max(LEAST, PERIODS * distance):
                        found.append((left, right + distance - left, distance))
        block *= 2
        if len(farthest) % 2:
            farthest = np.append(farthest, NEVER)
        farthest = np.maximum(farthest[0::2], farthest[1::2])
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _seeds(words: np.ndarray, at: np.ndarray, block: int, mask: int) -> Iterator[tuple[int, int]]:
    """Places of blocks and the distances from ``block`` on at which no code differs, by place."""
    inside = np.minimum(at[:, None] + np.arange(3 * block), len(words) - 1)
    codes = words[inside] & mask
    i, shift = np.nonzero(squared_differences(codes[:, :block], codes[:, block:]) == 0)
    place, distance = at[i], block + shift
    fits = place + distance + block <= len(words)
    return zip(place[fits].tolist(), distance[fits].tolist(), strict=True)


def _slice_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs and collapsed texts of a slice of documents."""
    data, offsets = H.text_bytes(batch.column("text"))
    solid = ~H._SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    number = np.zeros(0, np.int64)
    if len(starts):
        bounds = np.append(0, np.cumsum(ends - starts))
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[solid]))]).dictionary_encode()
        document = np.repeat(np.arange(len(count)), count)
        number = document * len(own.dictionary) + own.indices.to_numpy().astype(np.int64)
    rows = runs(number, int(count.max())) if len(starts) else np.zeros((0, 3), np.int64)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    # the bytes of the words that stay, each with the blank behind it
    size = np.where(ends < len(data), ~edge[ends], False).astype(np.int64) + ends - starts
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts[kept]] += 1
    mask[starts[kept] + size[kept]] -= 1
    chosen = np.flatnonzero(np.cumsum(mask[:-1], dtype=np.int8) > 0)
    out = data[chosen]
    out[~solid[chosen]] = 0x20
    cuts = np.searchsorted(chosen, offsets)
    whole = out.tobytes()
    texts = [whole[a:b].rstrip(b" ") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    owner = np.searchsorted(first, rows[:, 0], side="right") - 1
    ends_of = np.searchsorted(owner, np.arange(len(count) + 1)).astype(np.int32)
    fields = [pa.array(rows[:, 0] - first[owner]), pa.array(rows[:, 1]), pa.array(rows[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(ends_of), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), listed, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, n_words, runs, collapsed``.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of consecutive words with
    smallest period q and length of at least ``max(LEAST, PERIODS * q)`` that no neighbouring word extends keeping that
    period; ``runs`` has ``start, length, period`` in words, by start, then period. ``collapsed`` is the text without
    the words that some run holds after its first period, joined by single blanks.

    Null and empty texts, and texts without words, have no words, no runs and an empty ``collapsed``. Every row is
    treated alone, so null or repeated ids and repeated texts change nothing; an empty table gives an empty result;
    other columns are ignored. A long text is one sequence, whole; its memory is some ten times its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.row_groups(whole, "text"):
                yield _slice_runs(batch)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic runs cut to one period: ``text`` without the repetitions, other columns as they are.

    A text without runs stays as it is, white space included; null stays null. Clashing names, nulls, repeated rows and
    empty tables as in ``periodic_runs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.row_groups(whole, "text"):
                texts = batch.column("text")
                done = _slice_runs(pa.RecordBatch.from_arrays([texts, texts], ["doc_id", "text"]))
                changed = pc.greater(pc.list_value_length(done.column("runs")), 0)
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pc.if_else(changed, done.column("collapsed"), texts.cast(pa.string())))

    return docs.mapInArrow(run, docs.schema)
