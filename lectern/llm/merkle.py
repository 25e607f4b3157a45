"""A Merkle manifest of a dataset, by incremental witnesses.

Nodes are appended in order to a tree of ``ARITY`` children a node. An append gives each node a witness: the digests of
its siblings. As long as a subtree is open its witnesses are partial; each subtree that completes beside them extends
the witnesses of the others under the same parent. Appends are aligned: a task takes ``BLOCK`` consecutive nodes, a
power of the arity, streams them in order, and leaves for each node the witness up to the root of its block, and the
root. The block roots are appended to the next tree in the same way, in blocks again, until one root is left; then the
witness of a block root extends the witnesses of all nodes in the block, from the top down.

So no task holds more than one block of open subtrees, the work of an append does not depend on the nodes before it, and
the number of rounds is the logarithm of the number of nodes to base ``BLOCK``. Each language is a tree of leaves, and
their roots are appended to one tree of languages in the same way.

Digests are lower-case hex; a node is the SHA-256 of the digests of its children, concatenated as text. A run of
children is shorter at the end of a level, down to a single one, which is hashed as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.store import bounded, cut

ARITY = 8
#: Nodes in an aligned append.
BLOCK = ARITY**3

#: Witnesses, of some kilobytes each, up to which a table of them is broadcast.
WITNESSES = 4000

#: A level of a witness: the place of the node in its run, and its siblings' digests, concatenated.
WITNESS = "array<struct<place:int,siblings:string>>"


def field(value: Column) -> Column:
    """A value in the input of a leaf: ``-`` for null, else its UTF-8 bytes, counted and spelt out."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves(tree, ...)`` with ``pos``, the place in its tree by ``order``, and ``total``, the tree's size.

    Rows are sorted over all tasks by ranges, so that a tree may be of any size; a task numbers the rows of its range,
    and the ranges' sizes, a row for each task and tree in it, give the offsets. The ranges are written before they are
    counted, so counts and rows agree.
    """
    ranged = cut(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = cut(ranged.groupBy("tree", "part").agg(F.count("*").alias("n")), "range-sizes")
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    offsets = offsets.withColumnsRenamed({"tree": "o_tree", "part": "o_part"})
    own = ranged.withColumn("place", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1)
    rows = own.join(bounded(offsets), own["tree"].eqNullSafe(F.col("o_tree")) & (F.col("part") == F.col("o_part")))
    return rows.select(*leaves.columns, (F.col("place") + F.col("offset")).cast("long").alias("pos"), F.col("total").cast("long").alias("total"))


def _levels(total: int, block: int) -> int:
    """How many times runs of siblings become nodes in a block of a tree with ``total`` nodes."""
    levels, size = 0, 1
    while size < min(total, block):
        size, levels = size * ARITY, levels + 1
    return levels


def _append(digests: list[str], levels: int) -> tuple[str, list[list[tuple[int, str]]]]:
    """Root and witnesses after an append of all ``digests`` in order.

    ``open_nodes[level]`` are the nodes of the run that is still open there, each with the range of leaves under it.
    When a run completes, all leaves under a node of it get the node's siblings.
    """
    witnesses: list[list[tuple[int, str]]] = [[] for _ in digests]
    open_nodes: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]

    def complete(level: int) -> None:
        run = open_nodes[level]
        for place, (_, first, end) in enumerate(run):
            step = (place, "".join(d for i, (d, _, _) in enumerate(run) if i != place))
            for i in range(first, end):
                witnesses[i].append(step)
        parent = hashlib.sha256("".join(d for d, _, _ in run).encode()).hexdigest()
        open_nodes[level] = []
        push(level + 1, (parent, run[0][1], run[-1][2]))

    def push(level: int, node: tuple[str, int, int]) -> None:
        open_nodes[level].append(node)
        if level < levels and len(open_nodes[level]) == ARITY:
            complete(level)

    for i, digest in enumerate(digests):
        push(0, (digest, i, i + 1))
    for level in range(levels):
        if open_nodes[level]:
            complete(level)
    return open_nodes[levels][0][0], witnesses


def _appended(nodes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``nodes(tree, pos, total, digest)`` appended in blocks: ``tree, pos, block, witness`` for each, and the roots as nodes of the next tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending = None, []

        def done() -> pa.RecordBatch:
            tree, number, total = key
            root, witnesses = _append([d for _, d in pending], _levels(total, block))
            ends = np.append(0, np.cumsum([len(w) for w in witnesses])).astype(np.int32)
            flat = [step for w in witnesses for step in w]
            steps = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.string())], ["place", "siblings"])
            n = len(pending)
            return pa.RecordBatch.from_arrays(
                [pa.array([tree] * n, pa.string()), pa.array([p for p, _ in pending], pa.int64()), pa.array([number] * n, pa.int64()), pa.array([total] * n, pa.int64()), pa.array([root] * n, pa.string()), pa.ListArray.from_arrays(pa.array(ends), steps)],
                ["tree", "pos", "block", "total", "root", "witness"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "block", "total", "pos", "digest")]
            for tree, number, total, pos, digest in zip(*columns, strict=True):
                if key != (tree, number, total):
                    if pending:
                        yield done()
                    key, pending = (tree, number, total), []
                pending.append((pos, digest))
        if pending:
            yield done()

    rows = nodes.select("tree", F.floor(F.col("pos") / block).cast("long").alias("block"), "total", "pos", "digest")
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    out = cut(rows.mapInArrow(run, f"tree string, pos long, block long, total long, root string, witness {WITNESS}"), "witnesses")
    roots = out.where(F.col("pos") == F.col("block") * block).select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / block).cast("long").alias("total"), F.col("root").alias("digest"))
    return out.select("tree", "pos", "block", "witness"), roots


def trees(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``nodes(tree, pos, total, digest)`` -> ``tree, pos, witness`` up to the root of its tree for each node, and ``tree, root``."""
    rounds: list[DataFrame] = []
    while True:
        witnesses, nodes = _appended(nodes, block)
        rounds.append(witnesses)
        nodes = cut(nodes, "roots")
        if nodes.where("total > 1").isEmpty():
            break
    above = None
    for own in reversed(rounds):
        if above is None:
            above = own.select("tree", "pos", "witness")
            continue
        up = above.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), F.col("witness").alias("up"))
        met = own.join(bounded(up, WITNESSES), own["tree"].eqNullSafe(F.col("up_tree")) & (F.col("block") == F.col("up_pos")))
        above = cut(met.select("tree", "pos", F.concat("witness", "up").alias("witness")), "extended")
    return above, nodes.select("tree", F.col("digest").alias("root"))


def fold(leaf: Column, witness: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""

    def step(digest: Column, level: Column) -> Column:
        before = F.substr(level["siblings"], F.lit(1), 64 * level["place"])
        after = F.substr(level["siblings"], 64 * level["place"] + 1)
        return F.sha2(F.concat(before, digest, after).cast("binary"), 256)

    return F.aggregate(witness, leaf, step)


def manifest(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """``leaves(tree, doc_id, leaf, ...)`` -> the same rows with ``subroot, root, witness``.

    Leaves of a tree are in order of ``doc_id`` (null first), then ``leaf``; trees in the byte order of their names, null
    first. A tree of one leaf has it as its root. Rows that repeat id and leaf have places of their own, so their
    witnesses differ; which of them gets which does not matter, as they are equal. An empty table gives no rows.
    ``witness`` reaches from the leaf to the root over all trees.
    """
    placed = cut(positions(leaves, ["doc_id", "leaf"]), "leaves")
    own, roots = trees(placed.select("tree", "pos", "total", F.col("leaf").alias("digest")), block)
    roots = cut(roots, "subroots")
    # all trees are one tree of their roots; a name of its own keeps null and the empty name apart
    ranked = roots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    ranked = cut(positions(ranked, ["name"]), "ranked-subroots")
    upper, top = trees(ranked.select("tree", "pos", "total", "digest"), block)
    tops = ranked.join(upper.select("tree", "pos", F.col("witness").alias("up")), ["tree", "pos"]).join(top, "tree")
    tops = tops.select(F.col("name"), F.col("digest").alias("subroot"), "root", "up")
    rows = placed.join(own.withColumnsRenamed({"tree": "w_tree", "pos": "w_pos"}), placed["tree"].eqNullSafe(F.col("w_tree")) & (F.col("pos") == F.col("w_pos")))
    rows = rows.join(bounded(cut(tops, "tops"), WITNESSES), rows["tree"].eqNullSafe(F.col("name")))
    return rows.select(*leaves.columns, "subroot", "root", F.concat("witness", "up").alias("witness"))


def proof(witness: Column) -> Column:
    """The siblings of all levels, concatenated."""
    return F.array_join(F.transform(witness, lambda level: level["siblings"]), "")


def document_leaf(text: Column) -> Column:
    return leaf(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text)


def verify(rows: DataFrame, claimed: str) -> DataFrame:
    """``rows(root, witness, ...)`` with ``folded_root`` of the leaf in column ``claimed`` and whether it is the root."""
    out = rows.withColumn("folded_root", fold(F.col(claimed), F.col("witness")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
