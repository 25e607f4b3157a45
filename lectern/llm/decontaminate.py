"""Benchmark passages in whole documents: SimHash of item-sized windows, a multi-index over Hamming blocks, exact check.

A window has as many words as the items it is held against (less at the end of a text). Its fingerprint is the SimHash
of its shingles that occur in items of that size, weighted; sums over a sliding frame give it for every window. Windows
whose shingles can't reach the threshold with any item of their size are left out first: an intersection weighs at
least ``similarity`` times the item. So are windows that begin with a shingle of no such item: dropping it never
lowers a similarity. Neither loses a pair.

Fingerprints of windows and items meet in a multi-index: cut into ``BLOCKS`` blocks of bits, two of them at most
``RADIUS`` apart differ in some block by at most ``RADIUS // BLOCKS`` bits, so each side lists the values near its own
blocks (windows one bit away, items the rest) and all pairs within the radius meet in a hash join. The exact weighted
Jaccard similarity of the shingle bags decides.

Shingles are ``K`` words; an item's shingle weighs ln(1 + items / items with it), any other ln(1 + items). A feature
votes with the root of its weight, so the fingerprint of a window that shares the share q of an item's weight is
64 acos(sqrt(q)) / pi bits away on average: 8.8 for a similarity of 0.7, with a deviation of 2.8 bits.
Only DataFrame functions.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.store import bounded, cut, free_names
from lectern.llm.textcols import let, ngram_hashes

K = 3
SIMILARITY = 0.7
RADIUS = 19
BITS = 64
BLOCKS = 5
#: Votes are added up in lanes of 21 bits, three in a long.
LANE = 21
#: The sliding frame of a window size, in units that are the same for all sizes.
_FRAME = 1 << 30


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _vote(weight: Column) -> Column:
    """Half units of the root of a weight, one at least."""
    return F.greatest(F.lit(1), F.round(2 * F.sqrt(weight)).cast("int"))


def _lanes(h: str, vote: str) -> list[Column]:
    """The bits of ``h`` times ``vote``, three lanes a column."""
    out = []
    for j in range(0, BITS, 3):
        bits = " | ".join(f"shiftleft(shiftrightunsigned({h}, {j + i}) & 1L, {LANE * i})" for i in range(min(3, BITS - j)))
        out.append(F.expr(f"({bits}) * {vote}").alias(f"l{j // 3}"))
    return out


LANES = [f"l{j}" for j in range(-(-BITS // 3))]


def _fingerprint(total: str = "votes") -> Column:
    """Each bit by weighted majority of the features (a tie gives 0), from the sums of the lanes and of all votes."""
    bits = [f"if(2 * (shiftrightunsigned({LANES[b // 3]}, {LANE * (b % 3)}) & {(1 << LANE) - 1}L) > {total}, shiftleft(1L, {b}), 0L)" for b in range(BITS)]
    return F.expr(" | ".join(bits))


def index_keys(fingerprint: str, distance: int, blocks: int = BLOCKS) -> Column:
    """Array of (block number ``i``, value ``v``) for every value at most ``distance`` bits away from the fingerprint's own in a block."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    parts = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        masks = [sum(1 << b for b in flips) for d in range(distance + 1) for flips in combinations(range(hi - lo), d)]
        own = f"cast(shiftrightunsigned({fingerprint}, {lo}) & {(1 << (hi - lo)) - 1}L as int)"
        parts.append(f"transform(array({', '.join(map(str, masks))}), m -> named_struct('i', {i}, 'v', {own} ^ m))")
    return F.expr(f"concat({', '.join(parts)})")


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """``item, item_id, size, hashes`` of items with at least ``k`` words; ``item`` tells texts under one id apart."""
    words = benchmark.where("item_id is not null and text is not null").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= k).distinct()
    return words.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("size"), ngram_hashes(F.col("words"), k).alias("hashes"))


def _similarity(rare: float) -> Column:
    """Weighted Jaccard similarity of a window (``grams``, those of its shingles that its size's items know; ``total`` of all) and an item's bag."""

    def step(distinct: Column) -> Column:
        repeats = F.size(distinct) < F.size("grams")

        def add(acc: Column, g: Column) -> Column:
            mine = F.when(repeats, F.size(F.filter("grams", lambda x: x == g))).otherwise(1)
            found = F.get("bag", F.array_position("bag_h", g).cast("int") - 1)
            more = F.struct(
                (acc["both"] + found["w"] * F.least(mine, found["c"])).alias("both"),
                (acc["extra"] + found["w"] * F.greatest(mine - found["c"], F.lit(0))).alias("extra"),
                (acc["seen"] + mine).alias("seen"),
            )
            return F.when(F.array_contains("bag_h", g), more).otherwise(acc)

        return F.aggregate(distinct, F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("extra"), F.lit(0).alias("seen")), add)

    return let(let(F.array_distinct("grams"), step), lambda s: s["both"] / (F.col("weight") + s["extra"] + rare * (F.col("total") - s["seen"])))


def live_windows(docs: DataFrame, items: DataFrame, places: DataFrame, k: int, similarity: float) -> DataFrame:
    """``doc_id, _row, start, size, total, print, grams`` of every item-sized window that may be similar enough to an item of its size."""
    known = cut(places.select("h", "size", "w").distinct(), "known")
    bars = places.groupBy("item", "size").agg(F.sum("w").alias("weight")).groupBy("size").agg(F.min("weight").alias("bar"))
    read = docs.select("doc_id", F.xxhash64("text").alias("_row"), words_of(F.col("text")).alias("words"))
    read = read.select("doc_id", "_row", F.size("words").alias("n"), let(F.col("words"), lambda t: F.when(F.size(t) >= k, ngram_hashes(t, k))).alias("hashes"))
    hits = read.select("doc_id", "_row", "n", F.posexplode("hashes").alias("pos", "h")).join(bounded(known), "h")
    # rows that repeat a document count once
    hits = hits.groupBy("doc_id", "_row", "size", "pos").agg(F.first("n").alias("n"), F.first("h").alias("h"), F.first("w").alias("w"))
    hits = hits.withColumn("vote", _vote(F.col("w"))).select("*", *_lanes("h", "vote"), F.expr(f"(cast(pos as bigint) * {_FRAME}) div (size - {k - 1})").alias("at"))
    frame = Window.partitionBy("doc_id", "_row", "size").orderBy("at").rangeBetween(0, _FRAME - 1)
    sums = [F.sum(c).over(frame).alias(c) for c in LANES]
    rows = hits.select("doc_id", "_row", "size", "pos", "n", F.sum("w").over(frame).alias("w"), F.sum("vote").over(frame).alias("votes"), *sums, F.collect_list("h").over(frame).alias("grams"))
    live = rows.join(F.broadcast(bars), "size").where(F.col("w") >= similarity * F.col("bar") - 1e-9)
    total = F.least(F.col("n") - F.col("pos"), F.col("size")) - (k - 1)
    return live.select("doc_id", "_row", F.col("pos").alias("start"), "size", total.alias("total"), _fingerprint().alias("print"), "grams")


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of a window and an item of its size (``item, distance``) with fingerprints at most ``radius`` bits apart: all of them, once each."""
    near = radius // BLOCKS
    mine = min(1, near)
    left = windows.select("*", F.explode(index_keys("print", mine)).alias("b")).select("*", "b.i", "b.v").drop("b")
    right = items.select("item", "size", F.col("print").alias("item_print"), F.explode(index_keys("print", near - mine)).alias("b")).select("item", "size", "item_print", "b.i", "b.v")
    met = left.join(bounded(right), ["size", "i", "v"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    return met.where(F.col("distance") <= radius).drop("i", "v", "item_print").dropDuplicates(["doc_id", "_row", "size", "start", "item"])


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``doc_id, item_id, start, similarity, distance, _row``.

    One row for each text and item, at the most similar window (the first of equals that begin with a known shingle);
    ``start`` counts words. Null and empty texts match nothing, nor do items of under ``k`` words; rows that repeat a
    document give one row, ids of items that repeat give the best of their texts. Empty tables give an empty result,
    other columns are ignored. ``_row`` is a hash of the text, by which rows that share a ``doc_id``, or have none, are
    told apart. Items of over 100,000 words overflow the votes and fail the job.
    """
    items = cut(_items(benchmark, k), "items")
    n_items = items.count()
    rare = math.log1p(max(n_items, 1))
    each = items.select("item", "size", F.explode("hashes").alias("h"))
    weights = each.groupBy("h").agg(F.countDistinct("item").alias("df")).select("h", F.log1p(F.lit(float(max(n_items, 1))) / F.col("df")).alias("w"))
    places = cut(each.join(weights, "h").withColumn("vote", F.when(F.col("size") <= 100_000, _vote(F.col("w"))).otherwise(F.raise_error(F.lit("an item has too many words")).cast("int"))), "places")
    sums = places.select("item", "size", "vote", *_lanes("h", "vote")).groupBy("item", "size").agg(F.sum("vote").alias("votes"), *[F.sum(c).alias(c) for c in LANES])
    prints = cut(sums.select("item", "size", _fingerprint().alias("print")), "item-prints")

    windows = cut(live_windows(docs, items, places, k, similarity), "windows")
    pairs = candidates(windows, prints, radius)
    bags = places.groupBy("item", "h").agg(F.count("*").cast("int").alias("c"), F.first("w").alias("w")).groupBy("item").agg(F.collect_list(F.struct("h", "c", "w")).alias("bag"), F.sum(F.col("w") * F.col("c")).alias("weight"))
    bags = bags.select("item", "bag", F.col("bag.h").alias("bag_h"), "weight").join(items.select("item", "item_id"), "item")
    found = pairs.join(bounded(bags, 20_000), "item").select("doc_id", "_row", "item_id", "start", "distance", _similarity(rare).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
    best = found.groupBy("doc_id", "_row", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.similarity").alias("similarity"), (-F.col("b.d")).cast("int").alias("distance"), "_row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns unchanged, whatever their names.

    Null and empty texts stay, rows without ``doc_id`` go by their text, repeated rows go or stay together. Without
    items every row stays; an empty table stays empty.
    """
    d, r = free_names(docs, "d", "r")
    found = cut(contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(d), F.col("_row").alias(r)).distinct(), "contaminated")
    return docs.join(bounded(found), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(r)), "left_anti").select(docs.columns)
