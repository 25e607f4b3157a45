"""Exact top-k by inner product: a KD-tree for each shard, searched best first.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at the median of its widest dimension and
keeps the tight bounding box of each node; a box bounds the score of anything in it by the sum over dimensions of
max(q lo, q hi). Nodes are visited from the best bound down until no bound reaches the k-th score. Query blocks first
search one shard each; the k-th scores found there go with them to all other shards and prune from the start.
Queries meet shards in blocks of bounded size, on both sides, in cogroups.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textcols import let
from lectern.sources.store import cut

SHARD_ROWS = 8192
BLOCK_ROWS = 512
#: Blocks that a tree meets in one task at most, on average.
PART_BLOCKS = 64
LEAF_ROWS = 64

_TREE = "dim int, shard int, n int, ids binary, vectors binary, lo binary, hi binary, left binary, right binary, start binary, stop binary"
_HITS = "query_id long, vec_id long, score long, worse string"
#: Scores are given in 64 bits; those beyond as the nearest such number.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x), x as double, one row for each id; the integers are held as doubles, exactly, whatever their size.

    Rows without id, vectors that are null or hold a null or non-finite component take no part (nor one that is beyond
    doubles when scaled). Of several vectors
    under one id the smallest counts, so repeated rows count once.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    # beyond 2**53 doubles are integers; floor gives longs
    v = F.transform(x, lambda c: let(c * scale, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Rows in tree order, and for each node its box, children (-1: a leaf) and range of rows."""
    order = np.argsort(ids, kind="stable")
    lo, hi, left, right, start, stop = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        me = len(lo)
        lo.append(own.min(axis=0))
        hi.append(own.max(axis=0))
        start.append(a)
        stop.append(b)
        left.append(-1)
        right.append(-1)
        return me

    waiting = [(node(0, len(ids)), 0, len(ids))]
    while waiting:
        me, a, b = waiting.pop()
        width = hi[me] - lo[me]
        if b - a <= leaf or not width.any():
            continue
        axis, mid = int(width.argmax()), (a + b) // 2
        own = order[a:b]
        order[a:b] = own[np.argpartition(vectors[own, axis], mid - a)]
        left[me], right[me] = node(a, mid), node(mid, b)
        waiting += [(left[me], a, mid), (right[me], mid, b)]
    return {"ids": ids[order], "vectors": vectors[order], "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right), "start": np.array(start), "stop": np.array(stop)}


def search(tree: dict[str, np.ndarray], query: np.ndarray, query_id: int, k: int, least: int | None) -> list[tuple[int, int]]:
    """The best ``(score, -id)`` of the tree, k at most, not under ``least``; the query's own id is left out."""
    bounds = np.maximum(tree["lo"] * query, tree["hi"] * query).sum(axis=1)
    best: list[tuple[int, int]] = []
    nodes = [(-bounds[0], 0)]
    while nodes:
        bound, me = heapq.heappop(nodes)
        worst = best[0][0] if len(best) == k else least
        if worst is not None and -bound < worst:
            break
        if tree["left"][me] >= 0:
            for child in (tree["left"][me], tree["right"][me]):
                heapq.heappush(nodes, (-bounds[child], int(child)))
            continue
        a, b = tree["start"][me], tree["stop"][me]
        scores = tree["vectors"][a:b] @ query
        able = np.flatnonzero(scores >= worst) if worst is not None else range(b - a)
        for i in able:
            if tree["ids"][a + i] != query_id:
                entry = (int(scores[i]), -int(tree["ids"][a + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return best


def _whole(rows: np.ndarray, wide: bool) -> np.ndarray:
    """Doubles that are integers as 64-bit integers, or where products could pass 64 bits, as Python's."""
    if not wide:
        return rows.astype(np.int64)
    out = np.empty(rows.shape, object)
    out[...] = [int(x) for x in rows.ravel()] if rows.ndim == 1 else [[int(x) for x in row] for row in rows]
    return out


def worse(score: int) -> str:
    """A string that sorts integers of any size from the largest to the smallest."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score < 0 else f"0{9999 - len(digits):04d}{digits.translate(_COMPLEMENT)}"


def shard_trees(vectors: DataFrame, shards: int) -> DataFrame:
    """A row for each shard and dimension with its tree in arrays of bytes; about ``SHARD_ROWS`` vectors each."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(group.vec_id.to_numpy(np.int64), np.array(group.v.to_list(), np.float64).reshape(len(group), -1))
        row = {c: tree[c].astype(np.float64 if c in ("vectors", "lo", "hi") else np.int64).tobytes() for c in ("ids", "vectors", "lo", "hi", "left", "right", "start", "stop")}
        return pd.DataFrame([{"dim": group.dim.iloc[0], "shard": group.shard.iloc[0], "n": len(group), **row}])

    return vectors.withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")}).groupBy("dim", "shard").applyInPandas(build, _TREE)


def _searched(trees: DataFrame, blocks: DataFrame, k: int, parts: int) -> DataFrame:
    """Blocks and trees meet in cogroups by dimension, shard and part of the blocks, so neither goes through the driver and a tree is handed over once for many blocks."""

    def run(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in trees.itertuples(index=False):
            tree = {c: np.frombuffer(getattr(row, c), np.int64) for c in ("ids", "left", "right", "start", "stop")}
            boxes = {c: np.frombuffer(getattr(row, c), np.float64).reshape(-1, row.dim) if row.dim else np.zeros((len(tree["ids"] if c == "vectors" else tree["left"]), 0)) for c in ("vectors", "lo", "hi")}
            most, trees_by_width = float(np.abs(boxes["vectors"]).max()) if row.dim else 0.0, {}
            for queries in blocks.queries:
                asked = np.array([q["v"] for q in queries], np.float64).reshape(len(queries), row.dim)
                wide = bool(row.dim) and most * float(np.abs(asked).max()) * row.dim >= 2.0**62
                if wide not in trees_by_width:
                    trees_by_width[wide] = tree | {c: _whole(rows, wide) for c, rows in boxes.items()}
                out += [(q["query_id"], -i, min(HIGHEST, max(LOWEST, s)), worse(s)) for q, v in zip(queries, asked, strict=True) for s, i in search(trees_by_width[wide], _whole(v, wide), q["query_id"], k, q["least"])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "worse"])

    dealt = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ("dim", "shard", "part")
    return blocks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, _HITS)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``vectors(vec_id, v)``, ``queries(query_id, v)`` -> ``query_id, rank, vec_id, score``.

    The k highest inner products with vectors of the same dimension and another id; ties go to the smaller id. Fewer
    candidates give fewer rows, none give none. Components are integers, held as doubles. Scores are exact, whatever
    their size, and rank so; one beyond 64 bits is given as the nearest 64-bit number. Repeated ``vec_id`` are rows of
    their own; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors.select("vec_id", "v"), "vectors")
    queries = cut(queries.select("query_id", "v", F.size("v").alias("dim")), "queries")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    trees = cut(shard_trees(vectors, shards), "trees")
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")

    def in_blocks(q: DataFrame) -> DataFrame:
        return q.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("query_id", "v", "least")).alias("queries"))

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    start = in_blocks(queries.withColumn("least", F.lit(None).cast("long")))
    # at home a shard meets one block in so many, later it meets all others
    parts, home_parts = -(-n_blocks // PART_BLOCKS), -(-n_blocks // (PART_BLOCKS * shards))
    first = cut(_searched(trees, start.withColumns({"shard": home, "part": F.pmod(F.floor(F.col("block") / shards), F.lit(home_parts)).cast("int")}), k, home_parts), "first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).where((F.col("c") == k) & (F.col("s") > LOWEST)).select("query_id", F.col("s").alias("least"))
    if shards > 1:
        rest = in_blocks(queries.join(kth, "query_id", "left"))
        rest = rest.withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home))).withColumn("part", F.pmod(F.col("block"), F.lit(parts)).cast("int"))
        first = first.unionByName(_searched(trees, rest, k, parts))
    ranked = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("worse", "vec_id", "score"))), 1, k).alias("best"))
    out = ranked.select("query_id", F.posexplode("best").alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
