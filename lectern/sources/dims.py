"""Dimensions as small DataFrames, the check that guards them, and the lookups that join to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import values as V

#: A dimension is broadcast; more rows than this are refused by ``check_dimension``.
MOST_ROWS = 100_000


def entity_names(spark: SparkSession) -> DataFrame:
    """``code, name, alias, alias_words``: every name an entity goes by, the display name included."""
    rows = [(code, name, a) for code, name, more in V.ENTITIES for a in (name, *more)]
    return spark.createDataFrame(rows, "code string, name string, alias string").withColumn("alias_words", X.ascii_words(F.col("alias")))


def topics(spark: SparkSession) -> DataFrame:
    """``label, topic, idx``."""
    return spark.createDataFrame([(a, t, i) for i, (t, labels) in enumerate(V.TOPIC_ALIASES) for a in labels], "label string, topic string, idx int")


def subsections(spark: SparkSession) -> DataFrame:
    """``parent, label, subsection``; the parent of overview subsections is null."""
    rows = [(parent, label, name) for parent, entries in V.SUBSECTIONS for name, more in entries for label in (name, *more)]
    df = spark.createDataFrame(rows, "parent string, raw string, subsection string")
    return df.select("parent", X.subsection_label(F.col("raw")).alias("label"), "subsection").distinct()


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.SUBSECTION_OVERRIDES), "label string, topic string")


def topic_rules(spark: SparkSession) -> DataFrame:
    """``phrase, topic, rank``: phrases in the form of ``ascii_words``; rank orders topics by rule, then place."""
    rows = [(p, t, 100 * i + j) for i, (phrases, found) in enumerate(V.TOPIC_RULES) for p in phrases for j, t in enumerate(found)]
    return spark.createDataFrame(rows, "phrase string, topic string, rank int").withColumn("phrase", X.ascii_words(F.col("phrase"))).distinct()


def check_dimension(dim: DataFrame, alias: str, code: str, parent: str | None = None, parents: DataFrame | None = None, code_pattern: str | None = "^[A-Z]{2}$") -> DataFrame:
    """DIM1: violations ``(problem, alias, n)`` of a dimension that is about to be broadcast; none if it is sound.

    Blank aliases, malformed codes, an alias of two codes (under one parent), unknown parents, too many rows.
    """
    keys = [F.lower(F.trim(F.col(alias))).alias("alias")] + ([F.col(parent).alias("parent")] if parent else [])
    rows = dim.select(*keys, F.col(code).alias("code"))
    found = rows.where("alias is null or alias = ''").groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("blank_alias").alias("problem"), F.lit("").alias("alias"), "n")
    twice = rows.groupBy(*[k for k in rows.columns if k != "code"]).agg(F.countDistinct("code").alias("n")).where("n > 1")
    found = found.unionByName(twice.select(F.lit("alias_collision").alias("problem"), "alias", "n"))
    if code_pattern:
        bad = rows.where(~F.coalesce(F.col("code").rlike(code_pattern), F.lit(False))).groupBy("alias").agg(F.count("*").alias("n"))
        found = found.unionByName(bad.select(F.lit("bad_code").alias("problem"), "alias", "n"))
    if parent and parents is not None:
        lost = rows.where("parent is not null").join(parents.select(F.col(parents.columns[0]).alias("parent")).distinct(), "parent", "left_anti").groupBy("alias").agg(F.count("*").alias("n"))
        found = found.unionByName(lost.select(F.lit("unknown_parent").alias("problem"), "alias", "n"))
    size = rows.groupBy().agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS)
    return found.unionByName(size.select(F.lit("too_large").alias("problem"), F.lit("").alias("alias"), "n"))


def small(dim: DataFrame) -> DataFrame:
    """``dim`` marked for broadcast after its size was checked."""
    return F.broadcast(dim) if dim.limit(MOST_ROWS + 1).count() <= MOST_ROWS else dim


def join_topic(df: DataFrame, label: Column, dim: DataFrame, out: str = "topic") -> DataFrame:
    """JN1: exact match of the normalised label with a topic alias; unmatched rows get null. Labels that differ in capitals only are one alias."""
    d = dim.select(F.lower("label").alias("_alias"), F.col("topic").alias(out)).distinct()
    return df.withColumn("_alias", F.lower(label)).join(small(d), "_alias", "left").drop("_alias")


def join_subsection(df: DataFrame, parent: str, label: Column, dim: DataFrame, out: str = "canonical_subsection") -> DataFrame:
    """JN2: (topic, label) to the canonical subsection; a null topic is the overview."""
    d = dim.select(F.col("parent").alias("_of"), F.col("label").alias("_l"), F.col("subsection").alias(out))
    rows = df.withColumn("_sub", X.subsection_label(label))
    return rows.join(small(d), F.col(parent).eqNullSafe(F.col("_of")) & (F.col("_sub") == F.col("_l")), "left").drop("_of", "_l", "_sub")


def join_entity(df: DataFrame, name: Column, dim: DataFrame, out: str = "entity_code") -> DataFrame:
    """JN3: a name or alias to its code; unknown names get null."""
    d = dim.select(X.entity_token(F.col("alias")).alias("_alias"), F.col("code").alias(out)).distinct()
    return df.withColumn("_alias", X.entity_token(name)).join(small(d), "_alias", "left").drop("_alias")


def heading_entity(df: DataFrame, heading: Column, requested: str, dim: DataFrame, key: str, out: str = "entity_code") -> DataFrame:
    """JN13: the one requested code whose name occurs in ``heading`` as whole words; null for none or several.

    ``key`` names the column that tells rows apart, ``requested`` an array of codes.
    """
    words = df.select(key, F.explode(requested).alias("code"), X.ascii_words(heading).alias("_h"))
    hit = words.join(small(dim.select("code", "alias_words")), "code").where(X.contains_words(F.col("_h"), F.col("alias_words")))
    one = hit.groupBy(key).agg(F.countDistinct("code").alias("n"), F.min("code").alias(out)).where("n = 1").select(key, out)
    return df.join(one, key, "left")
