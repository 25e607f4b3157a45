"""The postings of a shard of chunks with their largest contributions by block, and the best hits of queries in it.

Chunks of a shard are in classes of similar length, and a block holds a term's postings in one class: what a term can
add to a chunk is bounded by the largest impact in its block. A query first scores the chunks with the largest
contributions of its terms; the k-th best of them is a score to reach. Then it takes its terms one after the other, from
the one that can add most, and drops each chunk as soon as its score and the blocks of the terms that are left can't
reach the k-th best score any more. Postings of dropped chunks are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of chunk lengths: two for each power of two.
CLASSES = 64
#: Of each term, and of the terms that can add most, so many are looked at for the score to reach.
TOP_POSTINGS, TOP_TERMS = 64, 12


#: Texts whose words are held at a time.
TEXTS = 512


def counted(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows with ``words``, blanks between them, get ``dl``, the number of words, and in place of the words ``terms`` and ``tfs``: the numbers of those in ``numbers``, and how often each occurs. Rows without words go."""
    width = max(1, len(numbers))
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            # a text without words is split into one empty word
            batch = batch.filter(pc.not_equal(batch.column("words"), ""))
            lists = pc.split_pattern(batch.column("words"), " ")
            words, row = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.array([numbers.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
            own = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            keys, tf = np.unique((row * width + own)[own >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * width), pa.int32())
            rest = {n: batch.column(n) for n in batch.schema.names if n != "words"}
            dl = pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64())
            terms, tfs = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (keys % width, tf))
            yield pa.RecordBatch.from_pydict({**rest, "dl": dl, "terms": terms, "tfs": tfs})


def unpacked(rows: pa.Table, k1: float, b: float) -> pa.Table:
    """The postings of a shard from ``rows(field, chunk_id, dl, avgdl, terms, tfs)``, one for each field of a chunk."""
    rows = rows.combine_chunks()
    lists = rows.column("terms").combine_chunks()
    of = pc.list_parent_indices(lists)
    tf, dl = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (rows.column("tfs").combine_chunks().flatten(), rows.column("dl").combine_chunks().take(of)))
    average = rows.column("avgdl").combine_chunks().take(of).to_numpy(zero_copy_only=False)
    impact = tf / (tf + k1 * (1 - b + b * dl / average))
    field, chunk = (rows.column(c).combine_chunks().dictionary_encode().take(of) for c in ("field", "chunk_id"))
    return pa.table({"field": field, "term": lists.flatten(), "chunk_id": chunk, "dl": pa.array(dl.astype(np.int64)), "impact": pa.array(impact)})


class Shard:
    """``postings(field, term, chunk_id, dl, impact)`` of the chunks of a shard; ``impact`` is the share of a term's weight that a chunk gets, ``dl`` the words of the field."""

    def __init__(self, postings: pa.Table) -> None:
        fields = postings.column("field").combine_chunks().dictionary_encode()
        terms = postings.column("term").combine_chunks().dictionary_encode()
        chunks = postings.column("chunk_id").combine_chunks().dictionary_encode()
        self.fields = fields.dictionary.to_pylist()
        self.chunks = chunks.dictionary
        impact = postings.column("impact").to_numpy()
        field, term, chunk = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (fields, terms, chunks))
        number = field * max(1, len(terms.dictionary)) + term
        order = np.lexsort((chunk, number))
        self.chunk, self.impact, key = chunk[order], impact[order], number[order]
        self.start = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
        names, heads = terms.dictionary.to_pylist(), order[self.start[:-1]]
        self.place = {(self.fields[field[at]], names[term[at]]): i for i, at in enumerate(heads.tolist())}
        lengths = np.zeros(len(self.chunks), np.int64)
        np.maximum.at(lengths, chunk, postings.column("dl").to_numpy().astype(np.int64))
        self.kind = np.minimum(2 * np.log2(np.maximum(lengths, 1)), CLASSES - 1).astype(np.int64)
        used, self.kind = np.unique(self.kind, return_inverse=True)
        own = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        self.peaks = np.zeros((len(self.start) - 1, len(used)))
        np.maximum.at(self.peaks, (own, self.kind[self.chunk]), self.impact)
        #: Postings that were looked at, for tests and tuning.
        self.read = 0

    def _combined(self, scores: np.ndarray, matched: np.ndarray, need: int, tie: float) -> np.ndarray:
        """The best field plus ``tie`` times the others, of the fields with enough terms; minus infinity without one."""
        able = matched >= need
        own = np.where(able, scores, 0.0)
        best = own.max(axis=0)
        return np.where(able.any(axis=0), best + tie * (own.sum(axis=0) - best), -np.inf)

    def _reached(self, lists: list[tuple[int, int, int, float]], need: int, k: int, tie: float, allowed: np.ndarray | None) -> float:
        """The k-th best score of the allowed chunks in which the terms that can add most have their largest impacts."""
        some = []
        for i, *_ in lists[:TOP_TERMS]:
            chunk, impact = self.chunk[self.start[i] : self.start[i + 1]], self.impact[self.start[i] : self.start[i + 1]]
            if allowed is not None:
                chunk, impact = chunk[allowed[chunk]], impact[allowed[chunk]]
            part = np.argpartition(-impact, TOP_POSTINGS)[:TOP_POSTINGS] if len(chunk) > TOP_POSTINGS else np.arange(len(chunk))
            some.append(chunk[part])
        chosen = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
        if len(chosen) < k:
            return -np.inf
        scores, matched = np.zeros((len(self.fields), len(chosen))), np.zeros((len(self.fields), len(chosen)), np.int64)
        for i, f, times, weight in lists:
            at, there = self._find(i, chosen)
            scores[f, there] += weight * self.impact[at]
            matched[f, there] += times
        now = self._combined(scores, matched, need, tie)
        return float(np.partition(now, len(now) - k)[len(now) - k])

    def _find(self, i: int, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of term ``i`` for those of ``chunks`` (ascending) that have one, and the places of these."""
        a, b = self.start[i], self.start[i + 1]
        at = np.searchsorted(self.chunk[a:b], chunks)
        there = np.flatnonzero(at < b - a)
        there = there[self.chunk[a + at[there]] == chunks[there]]
        self.read += len(there)
        return a + at[there], there

    def best(self, terms: list[tuple[str, str, int, float]], need: int, k: int | None, tie: float, slack: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and scores of the hits of a query with ``terms`` (field, term, times, weight): all of them, or those that can be among the best ``k``, where scores that differ by less than ``slack`` may be equal. Only ``allowed`` chunks count, if given."""
        n, field = len(self.chunks), {f: i for i, f in enumerate(self.fields)}
        lists = [(self.place[f, t], field[f], times, weight) for f, t, times, weight in terms if (f, t) in self.place]
        lists.sort(key=lambda x: -x[3] * self.peaks[x[0]].max())
        scores, matched = np.zeros((len(field), n)), np.zeros((len(field), n), np.int64)
        if k is None or n <= k or not lists:
            for i, f, times, weight in lists:
                a, b = self.start[i], self.start[i + 1]
                scores[f, self.chunk[a:b]] += weight * self.impact[a:b]
                matched[f, self.chunk[a:b]] += times
                self.read += b - a
            total = self._combined(scores, matched, need, tie)
            hits = np.flatnonzero(np.isfinite(total) if allowed is None else np.isfinite(total) & allowed)
            return hits, total[hits]
        # what the terms from one on can add to a chunk of each class, and how many terms they are in each field
        adds = np.array([weight * self.peaks[i] for i, _, _, weight in lists])
        tails = np.append(np.cumsum(adds[::-1], axis=0)[::-1], np.zeros((1, adds.shape[1])), axis=0)
        times = np.zeros((len(lists) + 1, len(field)), np.int64)
        for j in range(len(lists) - 1, -1, -1):
            times[j] = times[j + 1]
            times[j, lists[j][1]] += lists[j][2]
        least = self._reached(lists, need, k, tie, allowed)
        alive = np.arange(n) if allowed is None else np.flatnonzero(allowed)
        for j, (i, f, own, weight) in enumerate(lists):
            if j:
                able = scores[:, alive].sum(axis=0) + tails[j][self.kind[alive]] >= least - slack
                if need > 1:
                    able &= (matched[:, alive] + times[j][:, None] >= need).any(axis=0)
                alive = alive[able]
                if j % 8 == 0 and len(alive) > k:
                    now = self._combined(scores[:, alive], matched[:, alive], need, tie)
                    least = max(least, float(np.partition(now, len(now) - k)[len(now) - k]))
            else:
                alive = alive[tails[0][self.kind[alive]] >= least - slack]
            at, there = self._find(i, alive)
            scores[f, alive[there]] += weight * self.impact[at]
            matched[f, alive[there]] += own
        total = self._combined(scores[:, alive], matched[:, alive], need, tie)
        fine = np.isfinite(total)
        hits, total = alive[fine], total[fine]
        if len(hits) > k:
            near = total >= np.partition(total, len(total) - k)[len(total) - k] - slack
            hits, total = hits[near], total[near]
        return hits, total


class Filters:
    """Which chunks of a shard the filters of a query let pass. ``rows`` has ``chunk_id`` and the attributes, ``asked`` arrays of allowed values by the same names; an empty array doesn't filter. ``unless`` is a value of an attribute that passes only if the query filters that attribute."""

    def __init__(self, shard: Shard, rows: pa.Table, asked: pa.Table, attributes: tuple[str, ...], unless: tuple[str, str]) -> None:
        place = pc.index_in(rows.column("chunk_id").combine_chunks(), value_set=shard.chunks).to_numpy(zero_copy_only=False)
        self.codes, self.values = {}, {}
        for a in attributes:
            column = rows.column(a).combine_chunks().dictionary_encode(null_encoding="encode")
            self.values[a] = {v: i for i, v in enumerate(column.dictionary.to_pylist())}
            self.codes[a] = np.zeros(len(shard.chunks), np.int64)
            self.codes[a][place] = column.indices.to_numpy(zero_copy_only=False)
        self.asked, self.unless, self.size = asked, unless, len(shard.chunks)

    def __call__(self, i: int) -> np.ndarray:
        """The chunks that pass the filters in row ``i`` of ``asked``."""
        passed = np.ones(self.size, bool)
        for a, codes in self.codes.items():
            wanted = self.asked.column(a)[i].as_py()
            if wanted:
                passed &= np.isin(codes, [self.values[a][v] for v in wanted if v in self.values[a]])
            elif a == self.unless[0] and self.unless[1] in self.values[a]:
                passed &= codes != self.values[a][self.unless[1]]
        return passed


def ranked(shard: Shard, asked: pa.Table, k: int | None, tie: float, slack: float, filters: Filters | None = None) -> pa.Table:
    """``query_id, chunk_id, score`` of the queries in ``asked(query_id, field, term, qtf, weight, need)``; with ``k`` the hits of each that may be among its best ``k``."""
    ids = asked.column("query_id").combine_chunks().dictionary_encode()
    number = ids.indices.to_numpy(zero_copy_only=False)
    rows = list(zip(*(asked.column(c).to_pylist() for c in ("field", "term", "qtf", "weight", "need")), strict=True))
    by_query: dict[int, list[int]] = {}
    for i, q in enumerate(number.tolist()):
        by_query.setdefault(q, []).append(i)
    queries, chunks, scores = [], [], []
    for q, own in by_query.items():
        hits, values = shard.best([rows[i][:4] for i in own], rows[own[0]][4], k, tie, slack, None if filters is None else filters(own[0]))
        queries.append(np.full(len(hits), q))
        chunks.append(hits)
        scores.append(values)
    taken = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (queries, chunks)]
    return pa.table({"query_id": ids.dictionary.take(pa.array(taken[0])), "chunk_id": shard.chunks.take(pa.array(taken[1])), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})
