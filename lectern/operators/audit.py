"""Corpus audits: sources, duplicates, coverage, structure and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.facets import match_files


def source_audit(documents: DataFrame, files: DataFrame) -> DataFrame:
    """AGG7: ``status, documents, chunks`` with a total row (null status). ``documents`` carries ``chunk_count``."""
    status = match_files(documents.select("document_id", "country_code", "source_filename"), files).select("document_id", "status")
    return documents.join(status, "document_id").rollup("status").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


def duplicate_files(files: DataFrame, digest: str = "sha256", name: str = "name") -> DataFrame:
    """AGG8: ``digest, name, n``: the files whose digest several files share, a row for each; ``n`` is their number. Null digests are left out."""
    shared = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")
    return files.select(digest, name).join(shared, digest)


def corpus_coverage(chunks: DataFrame, topics: list[str]) -> DataFrame:
    """AGG9: per document counts, topics missing (in dimension order), repeated ids, longest chunk, ``OK`` or ``CHECK``."""
    per = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("document_type") == "overview").alias("overview_chunks"),
        F.count_if(F.col("document_type") == "comparator").alias("comparator_chunks"),
        F.collect_set("legal_topic").alias("_found"),
        F.countDistinct("chunk_id").alias("distinct_ids"),
        F.max(F.length("content")).alias("max_length"),
    )
    missing = F.array_except(F.array(*[F.lit(t) for t in topics]), F.col("_found"))
    per = per.withColumns({"missing_topics": missing, "duplicate_ids": F.col("chunks") - F.col("distinct_ids")})
    ok = (F.size("missing_topics") == 0) & (F.col("duplicate_ids") == 0) & (F.col("overview_chunks") > 0)
    return per.withColumn("status", F.when(ok, "OK").otherwise("CHECK")).drop("_found")


def corpus_validation(chunks: DataFrame, contacts: DataFrame, expected: DataFrame) -> DataFrame:
    """AGG10: per document of ``expected(document_id, country_code)``: chunks, sorted topics, contacts, warnings, ``valid``."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_set("legal_topic")).alias("topics"), F.collect_set("country_code").alias("_codes"))
    found = contacts.groupBy("document_id").agg(F.count("*").alias("contacts"))
    rows = expected.join(per, "document_id", "left").join(found, "document_id", "left").na.fill(0, ["chunks", "contacts"])
    foreign = F.size(F.array_except(F.coalesce("_codes", F.array().cast("array<string>")), F.array("country_code"))) > 0
    warn = F.array_compact(F.array(F.when(foreign, F.lit("foreign_country")), F.when(F.col("chunks") == 0, F.lit("no_chunks")), F.when(F.col("contacts") == 0, F.lit("no_contact"))))
    rows = rows.withColumns({"topics": F.coalesce("topics", F.array().cast("array<string>")), "warnings": warn})
    return rows.withColumn("valid", (F.col("chunks") > 0) & ~F.array_contains("warnings", "foreign_country")).drop("_codes")


def structure_profile(blocks: DataFrame, n_topics: int = 11, top: int = 10, doc: str = "doc_id") -> DataFrame:
    """AGG11: per document block counts, heading histogram, most frequent styles, topics found, and a class.

    ``blocks(doc_id, pos, kind, text, style, heading_level, topic)``; ``topic`` is the matched topic of a block.
    Under ``n_topics`` topics ``incomplete``, else by how many stand on first-level headings: all but one
    ``standard_heading``, none ``bold_legacy``, else ``hybrid``.
    """
    levels = blocks.where("heading_level is not null").groupBy(doc, "heading_level").count().groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("heading_level", "count")))).alias("heading_levels"))
    ranked = blocks.where("style is not null").groupBy(doc, "style").count().withColumn("r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("count"), "style"))).where(F.col("r") <= top)
    styles = ranked.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "style", "count"))), lambda x: F.struct(x["style"], x["count"])).alias("styles"))
    per = blocks.groupBy(doc).agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("kind") == "table").alias("tables"),
        F.count_if(~X.has_alphanumeric(F.col("text"))).alias("decorative"),
        F.countDistinct("topic").alias("topics_found"),
        F.countDistinct(F.when(F.col("heading_level") == 1, F.col("topic"))).alias("topics_on_h1"),
    )
    kind = F.when(F.col("topics_found") < n_topics, "incomplete").when(F.col("topics_on_h1") >= n_topics - 1, "standard_heading").when(F.col("topics_on_h1") == 0, "bold_legacy").otherwise("hybrid")
    return per.withColumn("structure", kind).join(levels, doc, "left").join(styles, doc, "left")


def suspicious_blocks(blocks: DataFrame, selected: DataFrame, doc: str = "doc_id") -> DataFrame:
    """AGG12: headings that are empty, unrecognised at the first level, numbered or explicitly unbolded, with reasons; ``selected(doc_id, pos)`` are left out."""
    reasons = F.concat_ws(
        ",",
        F.when(~X.has_alphanumeric(F.coalesce("text", F.lit(""))), F.lit("empty_heading")),
        F.when((F.col("heading_level") == 1) & F.col("topic").isNull(), F.lit("unrecognised_h1")),
        F.when(F.col("numbered"), F.lit("numbered_heading")),
        F.when(F.col("unbolded"), F.lit("unbolded_heading")),
    )
    rows = blocks.where("heading_level is not null").join(selected.select(doc, "pos"), [doc, "pos"], "left_anti")
    return rows.withColumn("reasons", reasons).where("reasons <> ''").select(doc, "pos", "text", "heading_level", "reasons")


def section_sizes(sections: DataFrame, limit: int = 6000, doc: str = "doc_id") -> DataFrame:
    """AGG13: per document sections, estimated chunks, longest section, and the sections over the limit (longest first)."""
    n = F.length("content")
    over = F.collect_list(F.when(n > limit, F.struct((-n).alias("n"), "section")))
    per = sections.groupBy(doc).agg(F.count("*").alias("sections"), F.sum(F.ceil(F.greatest(n, F.lit(1)) / limit)).alias("estimated_chunks"), F.max(n).alias("max_length"), F.array_sort(over).alias("o"))
    return per.select(doc, "sections", "estimated_chunks", "max_length", F.transform("o", lambda x: F.struct(x["section"].alias("section"), (-x["n"]).alias("length"))).alias("over_limit"))


def reference_labels(blocks: DataFrame, country: str = "country_code") -> DataFrame:
    """AGG14: per label key of headings: count, variants with counts (most frequent first), sorted countries."""
    rows = blocks.withColumns({"key": X.label_key(F.col("text")), "variant": X.squash_ws(F.col("text"))}).where("key <> ''")
    variants = rows.groupBy("key", "variant").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "variant"))).alias("v"))
    where = rows.groupBy("key").agg(F.sort_array(F.collect_set(country)).alias("countries"))
    return variants.join(where, "key").select("key", "n", F.transform("v", lambda x: F.struct(x["variant"].alias("variant"), (-x["c"]).alias("n"))).alias("variants"), "countries")


def label_candidates(blocks: DataFrame, references: DataFrame, longest: int = 220, doc: str = "doc_id") -> DataFrame:
    """AGG15 with JN11: bold or second-level blocks of at most ``longest`` characters, with the topic carried forward and whether a reference has their key."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("current_topic", F.last("topic", ignorenulls=True).over(w))
    rows = rows.where((F.coalesce("bold", F.lit(False)) | (F.col("heading_level") == 2)) & (F.length("text") <= longest)).withColumn("key", X.label_key(F.col("text")))
    known = references.select("key", F.lit(True).alias("matched")).distinct()
    return rows.join(known, "key", "left").select(doc, "pos", "key", "text", "current_topic", F.coalesce("matched", F.lit(False)).alias("matched"))


def structural_score(level: Column, listed: Column, prefixed: Column, bold_runs: Column, numbered: Column, unbolded: Column) -> Column:
    """How much a block looks like a main heading."""
    heading = F.when(level == 1, 100).when(level > 1, F.greatest(F.lit(10), 60 - 10 * level)).otherwise(0)
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return heading + yes(listed, 30) + yes(prefixed, 20) + F.least(F.coalesce(bold_runs, F.lit(0)) * 5, F.lit(20)) + yes(numbered, -15) + yes(unbolded, -25)


def best_candidate(rows: DataFrame, keys: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """RNK14: the best of each group by score, then position; ``duplicates`` counts the others."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), pos)
    return rows.withColumns({"r": F.row_number().over(w), "duplicates": F.count("*").over(Window.partitionBy(*keys)) - 1}).where("r = 1").drop("r")


def indexing_summary(results: DataFrame) -> DataFrame:
    """AGG16: totals over ``results(status, prepared, indexed, stale)``."""
    return results.agg(F.count("*").alias("discovered"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") != "ok").alias("failed"), *[F.sum(c).alias(c) for c in ("prepared", "indexed", "stale")])


def ordered_union(rows: DataFrame, key: str, order: str, values: str, out: str = "merged") -> DataFrame:
    """AGG17: per key the union of arrays, in first-seen order."""
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(values).alias("v")))).alias("a"))
    return per.select(key, F.array_distinct(F.flatten(F.transform("a", lambda x: x["v"]))).alias(out))
