"""Near-duplicate documents by a chosen-path set similarity join.

Every distinct shingle set is a node of ``trees`` independent trees. A tree sends a set down the path named by its
minwise token under the first, second, third ... random order of the tree, so sets of similarity s are still
together after d steps with probability s**d. A set stops in the first tree node, from the second step on, that
holds at most ``leaf`` sets; at the last step it stops in any case. Sets that meet in a node are compared:

1. each with a random member of its node, its pivot, on full shingle sets. This links close copies at a cost that is
   linear in their number;
2. in nodes whose members are then in different components, each with the most central member: the one with the
   highest mean similarity to the pivots it has met. Variants of one text are often similar enough to that text only,
   and this finds it;
3. in nodes that are still not of one component exhaustively: every member outside the node's largest component with
   every other member. Large nodes are cut into blocks that are bounded in rows and in shingles.

Before full sets are moved, a pair has to pass a bound that no link fails: each set has a bitmap of at least four bits
a shingle, each shingle setting one; a set has as many shingles outside the other as there are bits in its bitmap
alone, at least. Pairs that share a passage only are told apart by that, at a sixteenth of the bytes.

A pair is missed only if no tree brings it together: at most (1 - s**levels)**trees, 2.4e-7 for s = 0.85 and the
defaults (1e-5 for s = 0.8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.llm.components import connected_components
from lectern.sources.store import bounded, cut

TREES = 16
LEVELS = 3
LEAF = 8
#: Members of a block of full sets, and of a block of bitmaps, and shingles of either, on the average.
BLOCK = 256
BITMAP_BLOCK = 4096
BLOCK_SHINGLES = 1 << 22


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each value of the low bits of the shingle hashes: a power of two of them, at least four a shingle."""
    size = max(64, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    bits = np.zeros(size, bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _words(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to ``size`` bytes."""
    rows = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    while rows.shape[1] * 8 > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def _linkable(n_a: np.ndarray, n_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the largest intersection that the counts of bits allow would be a link."""
    both = np.minimum(n_a - only_a, n_b - only_b)
    return 100 * both >= percent * (n_a + n_b - both)


def signatures(docs: DataFrame, k: int, trees: int = TREES, levels: int = LEVELS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, d1, d2, sig, bits``: set size, 128-bit digest, minwise values and bitmap of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.row_groups(whole, "text"):
                data, offsets = H.text_bytes(batch.column("text"))
                hashes, begin = H.shingle_hashes(*H.word_hashes(data, offsets), k)
                sizes, d1, d2, bits = [], [], [], []
                for own in H.distinct_sets(hashes, begin):
                    sizes.append(len(own))
                    bits.append(bitmap(own))
                    d1.append(own.sum(dtype=np.uint64))
                    d2.append(H.mix(own + np.uint64(1)).sum(dtype=np.uint64))
                sig = H.minwise(hashes, begin, trees * levels)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int32).ravel()), sig.shape[1]).cast(pa.list_(pa.int32())), pa.array(bits, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "sig", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>, bits binary")


def paths(classes: DataFrame, trees: int, levels: int) -> DataFrame:
    """A row for each set and tree: ``rep, n, p2 .. p<levels>``, the names of the tree nodes on its way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                sig = batch.column("sig").flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, trees, levels).astype(np.uint64)
                node = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (batch.num_rows, trees)) * np.uint64(0x9E3779B97F4A7C15)
                names = []
                for level in range(levels):
                    node = H.mix(node ^ (sig[:, :, level] + np.uint64(level << 40)))
                    names.append(node.view(np.int64).ravel())
                rep = np.repeat(batch.column("rep").to_numpy(), trees)
                n = np.repeat(batch.column("n").to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), *map(pa.array, names[1:])], ["rep", "n", *[f"p{i}" for i in range(2, levels + 1)]])

    return classes.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, " + ", ".join(f"p{i} long" for i in range(2, levels + 1)))


def tree_members(classes: DataFrame, trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """``node, rep, n, size, pivot``: where each set stopped in each tree, without nodes of one set."""
    rest, members = paths(classes, trees, levels), None
    for level in range(2, levels + 1):
        node = f"p{level}"
        known = cut(rest.groupBy(node).agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64(node, "rep").alias("h"), "rep")).getField("rep").alias("pivot")).where("size > 1"), "nodes")
        here = rest.join(known, node)
        stop = here if level == levels else here.where(F.col("size") <= leaf)
        stop = stop.select(F.col(node).alias("node"), "rep", "n", "size", "pivot")
        members = stop if members is None else members.unionByName(stop)
        if level < levels:
            rest = here.where(F.col("size") > leaf).drop("size", "pivot")
    return cut(members, "members")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles``: the distinct shingle hashes of the documents whose id is in ``ids(doc_id)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.row_groups(whole, "text"):
                data, offsets = H.text_bytes(batch.column("text"))
                sets = list(H.distinct_sets(*H.shingle_hashes(*H.word_hashes(data, offsets), k)))
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "shingles"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(bounded(ids), "doc_id", "left_semi")
    return some.mapInArrow(run, "doc_id long, shingles array<long>")


def possible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """``a, b, bound, able`` of the ``pairs(a, b)`` whose sizes allow a link: the largest similarity that ``bitmaps(id, n, bits)`` allow, and whether that is a link; all links are able, and little else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            able, bound = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows)
            left, right = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
            for la, lb in np.unique(sizes, axis=0):
                rows = np.flatnonzero((sizes == (la, lb)).all(axis=1))
                x, y = _words([left[i] for i in rows], min(la, lb)), _words([right[i] for i in rows], min(la, lb))
                only_a, only_b = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (x & ~y, y & ~x))
                both = np.minimum(n_a[rows] - only_a, n_b[rows] - only_b)
                bound[rows] = both / (n_a[rows] + n_b[rows] - both)
                able[rows] = _linkable(n_a[rows], n_b[rows], only_a, only_b, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bound), pa.array(able)], ["a", "b", "bound", "able"])

    sides = [bitmaps.select(*[F.col(c).alias(n) for c, n in (("id", x), ("n", f"n_{x}"), ("bits", f"bits_{x}"))]) for x in "ab"]
    met = pairs.select("a", "b").distinct().join(sides[0].select("a", "n_a"), "a").join(sides[1].select("b", "n_b"), "b")
    near = met.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()
    return near.join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "a long, b long, bound double, able boolean")


def measured(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``pairs(a, b, ...)`` with ``both`` and ``either``, the sizes of intersection and union of the full shingle sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cut(shingle_sets(docs, ids, k), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return met.withColumn("either", F.size("sa") + F.size("sb") - F.col("both")).drop("sa", "sb")


def _linked(percent: int):
    return 100 * F.col("both") >= percent * F.col("either")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the tree nodes that hold several components: ``node, id, n, component, main`` (the largest), ``size`` and ``weight`` (all shingles)."""
    rows = members.select("node", F.col("rep").alias("id"), "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = cut(rows, "labelled")
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    info = parts.groupBy("node").agg(F.max(F.struct("c", "component")).getField("component").alias("main"), F.sum("c").alias("size"), F.sum("w").alias("weight"), F.count("*").alias("parts"))
    return rows.join(cut(info.where("parts > 1").drop("parts"), "open"), "node")


def _central_stars(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Each member of an open node with the node's most central one, if it is in another component."""
    rank = met.groupBy(F.col("rep").alias("id")).agg(F.avg("bound").alias("near"))
    rows = cut(rows.join(rank, "id", "left").withColumn("near", F.coalesce("near", F.lit(0.0))), "ranked")
    best = cut(rows.groupBy("node").agg(F.max(F.struct("near", F.col("id").alias("hub"), F.col("component").alias("hub_component"))).alias("m")).select("node", "m.hub", "m.hub_component"), "hubs")
    stars = rows.join(best, "node").where("component <> hub_component")
    return stars.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in small open nodes whose sizes allow a link."""
    p, q = (rows.select(F.col("node").alias(f"node_{x}"), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}")) for x in "pq")
    able = (F.col("node_p") == F.col("node_q")) & (F.col("id_p") < F.col("id_q")) & (F.col("c_p") != F.col("c_q"))
    able = able & (100 * F.least("n_p", "n_q") >= percent * F.greatest("n_p", "n_q"))
    return p.join(q, able).select(F.col("id_p").alias("a"), F.col("id_q").alias("b")).distinct()


def _block_chances(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows of a block that may have a link with a row on its other side and of another component, by their bitmaps."""
    group = group.reset_index(drop=True)
    size, n = group.bits.map(len).to_numpy(), group.n.to_numpy()
    probe, component = group.probe.to_numpy(), group.component.to_numpy()
    keep = np.zeros(len(group), bool)
    for la in np.unique(size[probe]):
        for lb in np.unique(size[~probe]):
            if max(la, lb) > 4 * min(la, lb):  # sizes that no link has
                continue
            left, right = np.flatnonzero(probe & (size == la)), np.flatnonzero(~probe & (size == lb))
            x, y = _words(list(group.bits[left]), min(la, lb)), _words(list(group.bits[right]), min(la, lb))
            # rows by size, so that each probe meets only those whose size a link allows
            order = np.argsort(n[right], kind="stable")
            right, y = right[order], y[order]
            bits_x, bits_y = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (x, y))
            lo = np.searchsorted(n[right], -(-percent * n[left] // 100))
            hi = np.searchsorted(n[right], 100 * n[left] // percent, side="right")
            for i, own, bits, a, b in zip(left, x, bits_x, lo, hi, strict=True):
                both = np.bitwise_count(y[a:b] & own).sum(axis=1, dtype=np.int64)
                able = _linkable(n[i], n[right[a:b]], bits - both, bits_y[a:b] - both, percent)
                met = right[a:b][able & (component[right[a:b]] != component[i])]
                keep[met] = True
                keep[i] |= len(met) > 0
    return group.loc[keep, ["node", "id"]]


def _block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between probes and members of one block, one for each two components: all intersections at once, as products of 0/1 matrices."""
    p, q = group[group.probe], group[~group.probe]
    if not len(p) or not len(q):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sizes = group.shingles.map(len).to_numpy()
    owner = np.repeat(np.arange(len(group)), sizes)
    probe = group.probe.to_numpy()
    place = np.cumsum(probe) - 1, np.cumsum(~probe) - 1
    _, word, times = np.unique(np.concatenate(group.shingles.to_list()), return_inverse=True, return_counts=True)
    # shingles of one row only meet nothing
    number = np.cumsum(times > 1) - 1
    shared = times[word] > 1
    owner, word = owner[shared], number[word[shared]]
    both = np.zeros((len(p), len(q)), np.float32)
    for lo in range(0, int(word.max()) + 1 if len(word) else 0, 1 << 13):
        part = (word >= lo) & (word < lo + (1 << 13))
        left, right = np.zeros((len(p), 1 << 13), np.float32), np.zeros((len(q), 1 << 13), np.float32)
        o, w = owner[part], word[part] - lo
        left[place[0][o[probe[o]]], w[probe[o]]] = 1
        right[place[1][o[~probe[o]]], w[~probe[o]]] = 1
        both += left @ right.T
    union = sizes[probe][:, None] + sizes[~probe][None, :] - both
    ci, cj = p.component.to_numpy(), q.component.to_numpy()
    i, j = np.nonzero((100 * both >= percent * union) & (ci[:, None] != cj[None, :]))
    out = pd.DataFrame({"a": p.id.to_numpy()[i], "b": q.id.to_numpy()[j], "ci": ci[i], "cj": cj[j]})
    return out.drop_duplicates(["ci", "cj"])[["a", "b"]]


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``node, x, y, probe, id, n, component``: each member outside the node's largest component (a probe) and all members, dealt so that every probe meets every member in one block."""
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rows = cut(rows.withColumn("blocks", blocks), "dense")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    p = rows.where("component <> main").select("node", own.alias("x"), every.alias("y"), "id", "n", "component", F.lit(True).alias("probe"))
    # only blocks that hold a probe need their members
    used = cut(p.select("node", "x").distinct(), "used")
    q = rows.select("node", every.alias("x"), own.alias("y"), "id", "n", "component", F.lit(False).alias("probe")).join(used, ["node", "x"], "left_semi")
    return p.unionByName(q.select(p.columns))


def _dense_links(rows: DataFrame, bitmaps: DataFrame, docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links in large open nodes, in blocks: by bitmaps first, then those that may have a link on full sets.

    A node of S members is copied S / block times, so blocks of bitmaps, which are small, are large: what is quadratic is
    the number of comparisons, not what is moved.
    """
    met = _blocks(rows, BITMAP_BLOCK).join(bitmaps.select("id", "bits"), "id")
    able = cut(met.groupBy("node", "x", "y").applyInPandas(lambda group: _block_chances(group, percent), "node long, id long").distinct(), "able")
    left = rows.join(able, ["node", "id"], "left_semi")
    info = cut(left.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "able-sizes")
    left = left.drop("size", "weight").join(info, "node")
    sets = shingle_sets(docs, cut(left.select(F.col("id").alias("doc_id")).distinct(), "dense-ids"), k).withColumnRenamed("doc_id", "id")
    full = _blocks(left, block).drop("n").join(sets, "id")
    return full.groupBy("node", "x", "y").applyInPandas(lambda group: _block_links(group, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, n_shingles, component_id, kept``.

    Texts are split at ASCII white space, A-Z lower-cased; a document's set holds its distinct ``k``-word shingles.
    Null and empty texts, and texts without words, have an empty set and link with nothing. Rows with equal sets are
    one node. Rows that repeat a ``doc_id`` count as one document; rows without one link with nothing and are kept,
    their component is null. ``kept`` marks the smallest ``doc_id`` of each component. An empty table gives an empty
    result; other columns are ignored. Texts of any length are hashed in slices; one set is held at a time.
    """
    sigs = cut(signatures(docs, k, trees, levels), "signatures")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "sig", "bits")).alias("m"))
    classes = cut(classes.select("d1", "d2", "n", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig"), F.col("m.bits").alias("bits")), "classes")
    bitmaps = classes.select(F.col("rep").alias("id"), "n", "bits")
    members = tree_members(classes, trees, levels, leaf)

    # ids that stand for several sets, because a doc_id was given to several texts
    shared = full.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep").where("doc_id <> rep") if _repeats(sigs) else None

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Components after some more links."""
        if links.isEmpty():
            return labels
        known = labels.select(F.col("id").alias("u"), F.col("component").alias("v"))
        return cut(connected_components(known.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))), "labels")

    def tried(able: DataFrame, name: str) -> DataFrame:
        """Pairs that may be links, with the sizes of their intersections and unions."""
        return cut(measured(docs, able.where("able").select("a", "b").distinct(), k), name)

    stars = members.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), "rep").distinct()
    bounds = cut(possible(stars, bitmaps, percent), "star-bounds")
    met = tried(bounds, "stars")
    edges = met.where(_linked(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    if shared is not None:
        edges = edges.unionByName(shared.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    labels = cut(connected_components(edges), "labels")
    # how central a set is shows in all its pivots, linked or not
    seen = stars.join(bounds.groupBy("a", "b").agg(F.max("bound").alias("bound")), ["a", "b"], "left").select("rep", F.coalesce("bound", F.lit(0.0)).alias("bound"))
    hubs = cut(_central_stars(_open_members(members, labels), seen), "hub-stars")
    hubs = hubs.join(met.select("a", "b"), ["a", "b"], "left_anti")
    labels = joined(labels, tried(cut(possible(hubs, bitmaps, percent), "hub-bounds"), "hub-links").where(_linked(percent)))
    rows = cut(_open_members(members, labels), "open-members")
    rest = tried(cut(possible(_open_pairs(rows.where(F.col("size") <= leaf), percent), bitmaps, percent), "rest-bounds"), "rest").where(_linked(percent)).select("a", "b")
    labels = joined(labels, cut(rest.unionByName(_dense_links(rows.where(F.col("size") > leaf), bitmaps, docs, k, percent)), "rest-links"))
    by_set = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    by_set = cut(by_set, "components")
    some = full.join(by_set, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    none = sigs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(sigs: DataFrame) -> bool:
    return not sigs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest ``doc_id``; columns unchanged.

    Of rows that repeat a kept ``doc_id`` one stays. Rows without ``doc_id`` or without words, null texts among them, all
    stay. An empty table stays empty; columns may have any names.
    """
    found = cut(near_duplicates(docs, k, percent), "groups")
    out = docs.join(bounded(found.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    again = cut(again, "again")
    one = out.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return out.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)
