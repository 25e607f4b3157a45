"""Facets, catalogue and inventory of a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many values a facet lists, and the longest subsection that counts.
COUNTRIES, TOPICS, SUBSECTIONS, DOCUMENTS, LONGEST = 300, 500, 1000, 1000, 512


def facet_country(chunks: DataFrame, limit: int = COUNTRIES) -> DataFrame:
    """AGG1: ``country_code, country, chunk_count``; the name is the most frequent one of the code (ties: the smallest), else the code."""
    by_name = chunks.groupBy(F.upper(F.trim("country_code")).alias("country_code"), "country").agg(F.count("*").alias("c")).where("country_code is not null and country_code <> ''")
    per = by_name.groupBy("country_code").agg(F.min(F.when(F.col("country").isNotNull(), F.struct((-F.col("c")).alias("c"), "country"))).getField("country").alias("country"), F.sum("c").alias("chunk_count"))
    return per.select("country_code", F.coalesce("country", "country_code").alias("country"), "chunk_count").orderBy("country_code").limit(limit)


def facet_value(chunks: DataFrame, column: str, limit: int | None, longest: int | None = None) -> DataFrame:
    """AGG2, AGG3: ``value, chunk_count`` of a column, nulls and overlong values left out, in order of value; all values if ``limit`` is None."""
    rows = chunks.where(F.col(column).isNotNull())
    if longest is not None:
        rows = rows.where(F.length(column) <= longest)
    per = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("chunk_count"))
    return per if limit is None else per.orderBy("value").limit(limit)


def facet_topic(chunks: DataFrame, limit: int | None = TOPICS) -> DataFrame:
    return facet_value(chunks, "legal_topic", limit)


def facet_subsection(chunks: DataFrame, limit: int | None = SUBSECTIONS) -> DataFrame:
    return facet_value(chunks, "subsection", limit, LONGEST)


def catalog(chunks: DataFrame, countries: int | None = COUNTRIES, topics: int | None = TOPICS, subsections: int | None = SUBSECTIONS) -> DataFrame:
    """AGG4: all three facets in one scan, by grouping sets: ``facet, value, chunk_count``; a bound of None lists all values."""
    code, topic, sub = F.upper(F.trim("country_code")).alias("c"), F.col("legal_topic").alias("t"), F.col("subsection").alias("s")
    sets = chunks.select(code, topic, sub).groupingSets([["c"], ["t"], ["s"]], "c", "t", "s").agg(F.grouping_id().alias("g"), F.count("*").alias("chunk_count"))
    facet = F.when(F.col("g") == 3, "country").when(F.col("g") == 5, "topic").otherwise("subsection")
    value = F.when(F.col("g") == 3, F.col("c")).when(F.col("g") == 5, F.col("t")).otherwise(F.col("s"))
    rows = sets.select(facet.alias("facet"), value.alias("value"), "chunk_count").where(F.col("value").isNotNull())
    rows = rows.where((F.col("facet") != "subsection") | (F.length("value") <= LONGEST))
    if countries is topics is subsections is None:
        return rows
    most = [F.lit(n).cast("long") if n is not None else F.lit((1 << 63) - 1) for n in (countries, topics, subsections)]
    bound = F.when(F.col("facet") == "country", most[0]).when(F.col("facet") == "topic", most[1]).otherwise(most[2])
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("facet").orderBy("value"))).where(F.col("n") <= bound).drop("n")


def match_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """JN7: ``documents(document_id, country_code, source_filename)`` with ``status``: a document's file is its historical name or ``<CODE>.docx``.

    ``resolved``, ``missing``, ``conflict`` (two different files exist), ``invalid_metadata``.
    """
    names = documents.select("document_id", "country_code", "source_filename", F.explode(F.array_distinct(F.array("source_filename", F.concat(F.upper("country_code"), F.lit(".docx"))))).alias("name"))
    have = names.join(files.select("name", F.coalesce("path", "name").alias("path")), "name", "left")
    per = have.groupBy("document_id", "country_code", "source_filename").agg(F.countDistinct("path").alias("n"))
    bad = F.col("country_code").isNull() | ~F.col("country_code").rlike("^[A-Za-z]{2}$") | F.col("source_filename").isNull() | (F.trim("source_filename") == "")
    return per.select("document_id", "country_code", "source_filename", F.when(bad, "invalid_metadata").when(F.col("n") == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("conflict").alias("status"))


def document_inventory(chunks: DataFrame, files: DataFrame | None = None, limit: int | None = DOCUMENTS) -> DataFrame:
    """AGG5: metadata of each document's smallest chunk, chunk count and file status, in order of id; all documents if ``limit`` is None."""
    meta = [c for c in ("country", "country_code", "language", "source_filename", "reference_year") if c in chunks.columns]
    rows = chunks.groupBy("document_id").agg(F.min_by(F.struct(*meta), "chunk_id").alias("m"), F.count("*").alias("chunk_count")).select("document_id", "m.*", "chunk_count")
    if files is not None:
        status = match_files(rows.select("document_id", "country_code", "source_filename"), files).select("document_id", F.when(F.col("status") == "resolved", "indexed").when(F.col("status") == "conflict", "indexed_source_conflict").otherwise("indexed_source_missing").alias("status"))
        rows = rows.join(status, "document_id", "left")
    return rows if limit is None else rows.orderBy("document_id").limit(limit)


def existing_documents(chunks: DataFrame, code: str) -> DataFrame:
    """AGG6: the documents of a country, with the file of their smallest chunk, in order of id."""
    return chunks.where(F.col("country_code") == code).groupBy("document_id").agg(F.min_by("source_filename", "chunk_id").alias("source_filename")).orderBy("document_id")
