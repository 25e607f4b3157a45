"""Interleaving sources to target weights by Pfair scheduling.

A source of weight w (the weights add up to 1) has its j-th block released at slot floor(j / w) with deadline
ceil((j + 1) / w). Taking, slot by slot, the released block with the earliest deadline meets every deadline, so after
t slots each source has less than one block more or less than t w. The weights are the targets themselves, not rounded.

Sources run out. From then on the others go on in proportion to their weights: time is counted in shares of the
weights that are left, so no slot stays empty. Sources without a positive weight come last, by their sizes.

The schedule is one row for each block. Blocks grow with the table, so that there are at most ``BLOCKS`` of them and
one for each source; that many steps are worked out on the driver, and every document finds its slot from its rank in
its source. Where there are more than ``SOURCES`` sources, those with the smallest weights are scheduled together: as one
source with their weights added up, whose blocks are theirs by deadline, sorted over all tasks, so many in a slot that
they too give at most ``BLOCKS`` slots. Ranks come from salted buckets (a hash of the id): rows are numbered inside a bucket, and the buckets'
sizes, a small table, are added up. Rows that share an id too often for a bucket are dealt by position instead, after
the table has been written once.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.merkle import positions
from lectern.sources.store import bounded, cut, free_names

#: Blocks in a schedule (sources beyond their full blocks add one each), rows in a block at least, rows in a bucket (about).
BLOCKS = 1 << 17
BLOCK_ROWS = 8
BUCKET_ROWS = 512
#: Sources that are scheduled one by one.
SOURCES = 10_000

_NEW = ("block", "slot", "place", "release", "deadline")


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> list[tuple[str, int]]:
    """``(source, block)`` slot by slot until all blocks are placed.

    Time is the share of its weight that a source should have had: it moves by 1 / (weights not yet run out) a slot.
    A block may be taken in the slot in which its time begins or later; the block whose time ends first is taken.
    """
    out: list[tuple[str, int]] = []
    for tier in (True, False):
        active = {s: weights[s] if tier else float(blocks[s]) for s in sorted(blocks) if blocks[s] > 0 and (weights.get(s, 0) > 0) == tier}
        total = sum(active.values())
        waiting: list[tuple[float, str, int]] = [(0.0, s, 0) for s in active]
        ready: list[tuple[float, str, int]] = []
        now, left = 0.0, total
        while waiting or ready:
            now += total / left
            while waiting and (waiting[0][0] * total < now - 1e-9 or not ready):
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, ((j + 1) / active[s], s, j))
            _, s, j = heapq.heappop(ready)
            out.append((s, j))
            if j + 1 < blocks[s]:
                heapq.heappush(waiting, ((j + 1) / active[s], s, j + 1))
            else:
                left = max(left - active[s], total * 1e-12)
    return out


def _key(source: str = "source"):
    """Sources as keys; a null source is a source of its own."""
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source)))


def _targets(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """``key, n, target``: rows and target weight of each source."""
    sizes = docs.groupBy(_key().alias("key")).agg(F.count("*").alias("n"))
    if weights is None:
        return cut(sizes.withColumn("target", F.sqrt("n")), "sizes")
    named = docs.sparkSession.createDataFrame([("null" if s is None else f"={s}", float(w)) for s, w in weights.items()], "key string, target double")
    return cut(sizes.join(F.broadcast(named), "key", "left").withColumn("target", F.greatest(F.lit(0.0), F.coalesce("target", F.lit(0.0)))), "sizes")


def _plan(sizes: DataFrame, per: int) -> tuple[DataFrame, DataFrame | None]:
    """``key, block, slot`` of the sources that are scheduled one by one, and ``key, block, slot, inner`` of the blocks of the others, if there are any."""
    spark = sizes.sparkSession
    blocks = F.ceil(F.col("n") / per)
    heavy = sizes.select("key", "target", blocks.alias("b")).orderBy(F.desc("target"), F.desc("b"), "key").limit(SOURCES).collect()
    targets, counts = {r.key: r.target for r in heavy}, {r.key: r.b for r in heavy}
    rest = sizes.join(F.broadcast(spark.createDataFrame([(k,) for k in targets], "key string")), "key", "left_anti").withColumn("tree", F.when(F.col("target") > 0, "tail1").otherwise("tail0"))
    together = {r.tree: r for r in rest.groupBy("tree").agg(F.sum("target").alias("target"), F.sum(blocks).alias("b")).collect()}
    many = {t: max(1, -(-r.b // BLOCKS)) for t, r in together.items()}
    plan = schedule(targets | {t: r.target / many[t] for t, r in together.items()}, counts | {t: -(-r.b // many[t]) for t, r in together.items()})
    slots = spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(plan)], "key string, block long, slot long")
    if not together:
        return slots, None
    each = rest.select("tree", "key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.when(F.col("target") > 0, F.col("target")).otherwise(blocks.cast("double")).alias("share"))
    each = positions(each.withColumn("due", (F.col("block") + 1) / F.col("share")), ["due", "key", "block"])
    size = F.create_map(*[F.lit(x) for t, g in many.items() for x in (t, g)])[F.col("tree")]
    unit = each.select("tree", "key", F.col("block"), F.floor(F.col("pos") / size).cast("long").alias("unit"), (F.col("pos") % size).alias("inner"))
    placed = unit.join(F.broadcast(slots.select(F.col("key").alias("tree"), F.col("block").alias("unit"), "slot")), ["tree", "unit"])
    return slots, cut(placed.select("key", "block", "slot", "inner"), "tail-slots")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """``docs(doc_id, source, ...)`` with ``block``, ``slot``, ``place``, ``release`` and ``deadline``; sorted by (slot, place) they are mixed.

    ``weights`` maps source names (None for null) to target weights; without it, the square roots of the sizes.
    Sources that it leaves out or that have no positive weight come after all others. ``release`` and ``deadline`` are
    the window of the block while no source has run out, null without a positive weight. All rows are kept. Rows that
    repeat a ``doc_id`` are rows of their own, null ids too; rows of one id may trade places. An empty table stays
    empty; texts are not looked at. Columns with the names of the five new ones are replaced, others pass unchanged
    whatever their names. ``block_rows`` is ``BLOCK_ROWS``, or more where that would give over ``BLOCKS`` blocks.
    """
    docs = docs.drop(*_NEW)
    sizes = _targets(docs, weights)
    every = sizes.agg(F.sum("n").alias("n"), F.sum("target").alias("target")).first()
    per = block_rows or max(BLOCK_ROWS, -(-(every.n or 0) // BLOCKS))
    plan, tail = _plan(sizes, per)

    key, h, bucket, buckets, before, rank, w, k, x = free_names(docs, "key", "h", "bucket", "buckets", "before", "rank", "w", "k", "x")
    # one row for each source
    share = sizes.select(F.col("key").alias(key), (F.col("target") / F.lit(every.target or 1.0)).alias(w), F.ceil(F.col("n") / BUCKET_ROWS).alias(buckets))
    slots = plan.withColumnsRenamed({"key": key})
    rows = docs.withColumns({key: _key(), h: F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7))})
    crowded = cut(rows.groupBy(key, h).count().where(F.col("count") > BUCKET_ROWS).select(key, h), "crowded")
    if not crowded.isEmpty():
        many = crowded.select(F.col(key).alias(k), F.col(h).alias(x))
        marked = rows.join(bounded(many), (F.col(key) == F.col(k)) & (F.col(h) == F.col(x)), "left")
        spot = F.when(F.col(k).isNotNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(11))).otherwise(F.col(h))
        rows = cut(marked.withColumn(h, spot).select(*docs.columns, key, h), "dealt")
    rows = rows.join(bounded(share.select(key, buckets)), key).withColumn(bucket, F.pmod(F.col(h), F.col(buckets)))
    counts = rows.groupBy(key, bucket).agg(F.count("*").alias("c"))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select(key, bucket, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias(before)), "buckets")
    inside = Window.partitionBy(key, bucket).orderBy(h, "doc_id")
    rows = rows.withColumn(rank, F.row_number().over(inside) - 1).join(bounded(counts), [key, bucket])
    at = F.col(before) + F.col(rank)
    rows = rows.withColumns({"block": F.floor(at / per), "place": at % per})
    if tail is None:
        rows = rows.join(F.broadcast(slots), [key, "block"])
    else:
        inner, later = free_names(docs, "inner", "later")
        others = tail.withColumnsRenamed({"key": key, "slot": later, "inner": inner})
        rows = rows.join(F.broadcast(slots), [key, "block"], "left").join(others, [key, "block"], "left").withColumns({"slot": F.coalesce("slot", later), "place": F.coalesce(F.col(inner) * per, F.lit(0)) + F.col("place")})
    rows = rows.join(bounded(share.select(key, w)), key)
    j = F.col("block")
    window = {"release": F.floor(j / F.col(w) + 1e-9), "deadline": F.ceil((j + 1) / F.col(w) - 1e-9)}
    rows = rows.withColumns({c: F.when(F.col(w) > 0, at) for c, at in window.items()})
    return rows.select(*docs.columns, *[F.col(c).cast("long").alias(c) for c in _NEW])
