"""Language of whole texts by bit-sliced Bloom filters over byte n-grams.

One table of cells holds the filters of all languages: bit L of a cell belongs to language L; a cell has one word for
each 64 languages, in blocks that are looked up one after the other. A language's filter holds every n-gram of its
training texts. The cells of an n-gram, ANDed, are a bit mask of the languages that (may) contain it. Counting each
bit over a text gives the n-grams that each language claims; n_L claims out of n are corrected for the filter's false
positive rate f_L (the share of cells with bit L, to the power of the number of hashes): (n_L - n f_L) / (1 - f_L).
The largest decides; among equals that with the most n-grams that no other language claims.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.sources.store import bounded, cut

N = 4
#: Cells are 2**20 at least, and 16 for each n-gram of the richest language up to 2**22; fuller filters have a higher false positive rate, which is corrected for.
CELL_BITS = (20, 22)
#: Training bound: documents sampled for each language (in expectation).
DOCS_PER_LANGUAGE = 1500
#: Languages in one word of a cell.
WORD = 64
#: Longer texts are taken apart at the next blank, and their counts added up.
PIECE = 1 << 20
UNDETERMINED = "und"

_HASHES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
# bytes of anything but ASCII letters and multi-byte characters become a blank
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte 4-grams (uint32) of each text between blanks, lower-cased, and where each text's grams begin. Each text has three at least; those of blanks only are 0."""
    padded = pc.utf8_lower(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()).fill_null(""), pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())))
    data, offsets = H.text_bytes(padded)
    data = _FOLD[data]
    wide = np.zeros(len(data) + N, np.uint32)
    wide[: len(data)] = data
    grams = wide[: len(data)] | wide[1 : len(data) + 1] << np.uint32(8) | wide[2 : len(data) + 2] << np.uint32(16) | wide[3 : len(data) + 3] << np.uint32(24)
    # the last three would run into the next text; blanks only tell nothing
    for back in range(1, N):
        grams[offsets[1:] - back] = 0
    grams[grams == np.uint32(0x20202020)] = 0
    return grams, offsets


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts with very long ones in pieces, and the row that each piece belongs to."""
    sizes = np.array(pc.fill_null(pc.utf8_length(texts.cast(pa.large_string())), 0))
    if not len(sizes) or sizes.max() <= PIECE:
        return texts, np.arange(len(sizes))
    out, owner = [], []
    for i, n in enumerate(sizes):
        text, at = texts[i].as_py() or "", 0
        while n - at > PIECE:
            blank = text.find(" ", at + PIECE)
            stop = blank if blank >= 0 else n
            out.append(text[at:stop])
            owner.append(i)
            at = stop
        out.append(text[at:])
        owner.append(i)
    return pa.array(out, pa.large_string()), np.array(owner)


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(grams * h) >> np.uint32(32 - bits) for h in _HASHES]


@dataclass
class LanguageFilters:
    """``tables`` has the cells of each ``WORD`` languages in order."""

    languages: list[str]
    tables: list[np.ndarray]
    false_rate: np.ndarray
    bits: int

    def _counts(self, texts: pa.Array) -> np.ndarray:
        """For each text its n-grams, then for each language those that it claims, then those that it alone claims."""
        grams, begin = grams_of(texts)
        cells = _cells(grams, self.bits)
        real = grams != 0
        masks = []
        for table in self.tables:
            mask = table[cells[0]]
            for other in cells[1:]:
                mask &= table[other]
            mask[~real] = 0
            masks.append(mask)
        alone = sum(np.bitwise_count(m) for m in masks) == 1
        n = len(self.languages)
        out = np.zeros((len(begin) - 1, 1 + 2 * n), np.int64)
        out[:, 0] = np.add.reduceat(real, begin[:-1], dtype=np.int64)
        for i in range(n):
            mask = masks[i // WORD]
            claimed = ((mask >> mask.dtype.type(i % WORD)) & mask.dtype.type(1)).astype(bool)
            out[:, 1 + i] = np.add.reduceat(claimed, begin[:-1], dtype=np.int64)
            out[:, 1 + n + i] = np.add.reduceat(claimed & alone, begin[:-1], dtype=np.int64)
        return out

    def claims(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts, a row for each text and a column for each language, and the counts of n-grams that a language alone claims."""
        parts, owner = pieces(texts)
        counts = self._counts(parts)
        if len(parts) > len(texts):
            whole = np.zeros((len(texts), counts.shape[1]), np.int64)
            np.add.at(whole, owner, counts)
            counts = whole
        n, k = counts[:, :1].astype(float), len(self.languages)
        return np.maximum(0, (counts[:, 1 : 1 + k] - n * self.false_rate) / (1 - self.false_rate)), counts[:, 1 + k :]


def build(grams: DataFrame) -> LanguageFilters:
    """Filters from ``grams(lang, gram)``: the cells are put together in Spark, what comes to the driver is the table itself."""
    sizes = grams.groupBy("lang").count().orderBy("lang").collect()
    languages = [r.lang for r in sizes]
    bits = min(CELL_BITS[1], max(CELL_BITS[0], (16 * max((r["count"] for r in sizes), default=1)).bit_length()))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    places = grams.sparkSession.createDataFrame([(lang, i // WORD, i % WORD) for i, lang in enumerate(languages)], "lang string, block int, bit int")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bit = batch.column("block"), batch.column("bit").to_numpy(zero_copy_only=False)
            mask = pa.array(np.left_shift(np.int64(1), bit.astype(np.int64)))
            for own in _cells(batch.column("gram").to_numpy().astype(np.uint32), bits):
                yield pa.RecordBatch.from_arrays([block, pa.array(own.astype(np.int64)), mask], ["block", "cell", "mask"])

    # one row for each language
    placed = grams.join(F.broadcast(places), "lang").select("block", "bit", "gram").mapInArrow(cells, "block int, cell long, mask long")
    found = placed.groupBy("block", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    tables = [np.zeros(1 << bits, kind) for _ in range(0, len(languages), WORD)]
    block, cell, mask = (np.asarray(found.column(c).to_numpy(), np.int64) for c in ("block", "cell", "mask"))
    for i, table in enumerate(tables):
        table[cell[block == i]] = mask[block == i].view(np.uint64).astype(kind)
    fill = [((tables[i // WORD] >> kind(i % WORD)) & kind(1)).mean() for i in range(len(languages))]
    return LanguageFilters(languages, tables, np.array(fill) ** len(_HASHES), bits)


def fit(docs: DataFrame) -> LanguageFilters:
    """Filters learned from ``docs(doc_id, text, lang)``; rows with a null text or language are left out.

    Of each language's different rows about ``DOCS_PER_LANGUAGE`` are used, chosen by a hash of id and text, and at
    least the row with the smallest hash; rows that repeat id and text count once. So every language gets a filter
    that has a row with an n-gram among those, with all n-grams of its sample, however its ids are given.
    """
    known = docs.where("text is not null and lang is not null").select("lang", F.xxhash64("doc_id", "text", F.lit(17)).alias("h"), "text")
    draw = (F.col("h") / float(1 << 63) + 1) / 2
    counts = cut(known.select("lang", "h").distinct().groupBy("lang").agg(F.least(F.lit(1.0), DOCS_PER_LANGUAGE / F.count("*")).alias("wanted"), F.min("h").alias("lowest")), "language-sizes")
    sample = known.join(bounded(counts), "lang").where((draw < F.col("wanted")) | (F.col("h") == F.col("lowest")))
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.row_groups(whole, "text", 4 << 20):
                parts, owner = pieces(batch.column("text"))
                langs = np.array(batch.column("lang").to_pylist(), object)[owner]
                for lang in sorted(set(langs)):
                    grams, _ = grams_of(parts.filter(pa.array(langs == lang)))
                    found = np.unique(grams[grams != 0])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64))], ["lang", "gram"])

    return build(cut(sample.select("text", "lang").mapInArrow(distinct, "lang string, gram long").distinct(), "grams"))


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, lang_pred, score``: the language and its share of all corrected claims.

    Null texts and texts without a letter are ``und`` with score 0. If no language claims anything, or nothing was
    learned, the first language (or ``und``) is given with score 0. Equal claims go to the language with more n-grams
    of its own, then to the first name in order. A row for each row, repeated ones and null ids too; an empty table
    gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in H.row_groups(whole, "text", 2 << 20):
                texts = batch.column("text")
                claims, alone = own.claims(texts) if own.languages else (np.zeros((len(texts), 1)), np.zeros((len(texts), 1), np.int64))
                best = np.where(claims >= claims.max(axis=1, keepdims=True) - 1e-6, alone, -1).argmax(axis=1)
                total = claims.sum(axis=1)
                score = np.where(total > 0, claims[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
                names, scores = [], []
                ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_pylist()
                for i in range(len(texts)):
                    lettered = own.languages and (ascii_letter[i] or any(c.isalpha() for c in texts[i].as_py() or ""))
                    names.append(own.languages[best[i]] if lettered else UNDETERMINED)
                    scores.append(float(score[i]) if lettered else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
