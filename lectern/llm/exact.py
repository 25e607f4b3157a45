"""Exact deduplication by skew-safe combining.

Rows meet in three stages, and in each the key is the digest together with the full text, so that only equal contents
ever become one row:

1. locally: Spark's partial aggregate leaves one row for each text of a partition;
2. in salted digest groups: the local rows of a text come from many partitions; their salt, the number of the partition
   modulo ``SALTS``, deals them to so many tasks, and each leaves one winner;
3. globally: at most ``SALTS`` winners of a text meet, whatever the number of its copies.

The rows of documents never move with their texts after that. A digest that turned out to stand for one text only stands
for it everywhere, as stage 3 has compared all contents under it; documents get their group by digest. Should a digest
stand for several texts, its documents get their group by digest and text.

Groups so large that one of them is noticeable in a task (more than 1/``HEAVY`` of all rows) are fewer than ``HEAVY``,
hence broadcast; the other groups meet their documents in a shuffle that they can't unbalance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.store import bounded, cut, free_names

#: Tasks among which the local winners of one text are dealt.
SALTS = 64
#: Groups of more than one in so many rows are broadcast; there are fewer of them than this.
HEAVY = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _winners(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, digest, content)`` -> ``digest, content, keep_id, group_size``: stages 1 to 3."""
    tally = [F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    rows = texts.select("digest", "content", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = rows.groupBy("salt", "digest", "content").agg(*tally)
    # dealt by the digest alone, so that all contents under a digest are in one place for the next step too
    return salted.repartition("digest").groupBy("digest", "content").agg(*tally)


def exact_groups(docs: DataFrame, text: Callable[[Column], Column] = normalised, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if ``text`` makes the same string of them, by default with each run of ASCII white space as one
    space and null as the empty text. ``keep_id`` is the smallest ``doc_id`` of the group, ``group_size`` its number of
    rows; ``kept`` marks the rows with that id. A null ``doc_id`` counts as a row of its group, but stands for it only
    where no row has an id (``keep_id`` is then null, and the rows are kept); rows that repeat id and text are all kept.
    An empty table gives an empty result; other columns are ignored. ``text_sha256`` is the lower-case hex digest of
    the normalised text, under which rows are grouped; another ``digest`` may be given, and texts that share a digest
    stay apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(F.col("text")).alias("content")).select("doc_id", digest(F.col("content")).alias("digest"), "content")
    per_digest = _winners(texts).groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    per_digest = cut(per_digest.where("group_size > 1"), "groups")
    rows = cut(texts.select("doc_id", "digest"), "digests")
    limit = rows.count() / HEAVY
    heavy = per_digest.where(F.col("group_size") > limit).select("digest", F.struct("contents", "keep_id", "group_size").alias("h"))
    light = per_digest.where(F.col("group_size") <= limit).select("digest", F.struct("contents", "keep_id", "group_size").alias("l"))
    known = rows.join(F.broadcast(heavy), "digest", "left")
    # rows of heavy groups and rows without a digest to look up are dealt evenly, by a key that no digest is
    known = known.withColumn("look", F.when(F.col("h").isNull(), F.col("digest")).otherwise(F.concat(F.lit("id:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    met = known.join(light.withColumnRenamed("digest", "look"), "look", "left").withColumn("g", F.coalesce("h", "l"))
    done = met.where("g is null or g.contents = 1").select("doc_id", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("g.keep_id")).alias("keep_id"), F.coalesce("g.group_size", F.lit(1).cast("long")).alias("group_size"), F.col("digest").alias("text_sha256"))
    clash = per_digest.where("contents > 1").select("digest")
    if not clash.isEmpty():
        same = texts.join(bounded(clash), "digest", "left_semi")
        groups = cut(_winners(same), "clashing")
        done = done.unionByName(same.join(groups, ["digest", "content"]).select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256")))
    return done.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest ``doc_id``; columns unchanged.

    Of rows that repeat both a kept id and its text one stays, whichever, and of a group without ids one. Null and empty texts are
    equal. An empty table stays empty; clashing column names are no matter.
    """
    digest, rank = free_names(docs, "digest", "keep_id")
    groups = exact_groups(docs).where("kept").select(F.col("text_sha256").alias(digest), F.col("doc_id").alias(rank)).distinct()
    rows = docs.withColumn(digest, sha256(normalised(F.col("text"))))
    same = (rows[digest] == groups[digest]) & F.col("doc_id").cast("long").eqNullSafe(groups[rank])
    kept = rows.join(groups, same, "left_semi")
    return kept.dropDuplicates(["doc_id", digest]).select(docs.columns)
