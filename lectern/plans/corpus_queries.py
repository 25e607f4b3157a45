"""Segmentation, identity, write planning and audits over the given tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import audit, segment
from lectern.plans import inputs as I
from lectern.sources import corpus, dims, versioned
from lectern.sources.store import fresh_path
from lectern.streaming import streams

US = "\u001f"


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = I.blocks(spark, d)
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("pos").alias("last"), F.sum(F.length("text")).alias("chars"))


def html_headings(spark: SparkSession, d: str) -> DataFrame:
    return corpus.read_html_blocks(I.table(spark, d, "pages")).where("heading_level is not null").groupBy("page_id", "heading_level").agg(F.count("*").alias("n"), F.min("text").alias("first"))


def _html_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = corpus.read_html_blocks(I.table(spark, d, "pages")).withColumnRenamed("page_id", "doc_id")
    return b.where("tag <> 'title'")


def table_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.array(F.struct(F.lit(0).alias("col"), F.col("o_orderstatus").alias("text")), F.struct(F.lit(1).alias("col"), F.lit("-").alias("text")), F.struct(F.lit(2).alias("col"), F.col("o_orderkey").cast("string").alias("text")))
    cells = I.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 2).alias("table_idx"), F.col("o_orderkey").alias("row"), F.explode(text).alias("c"))
    return corpus.serialize_tables(cells.select("doc_id", "table_idx", "row", "c.col", "c.text"))


def front_matter_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.front_matter(I.blocks(spark, d), 12, 1500)
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.max("line_no").alias("last"))


def _title_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a title made from nation names in front."""
    n = I.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.initcap("n_name").alias("name"))
    docs = I.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 25).alias("k")).join(F.broadcast(n), "k")
    kind = F.col("doc_id") % 4
    first = F.when(kind == 0, F.concat(F.lit("Employment Law Overview in "), "name", F.lit(" 2024"))).when(kind == 1, F.concat(F.lit("Labour and Employment Law in "), "name")).when(kind == 2, F.lit("Employment Law Overview 2023")).otherwise(F.concat(F.lit("Employment law overview / "), "name"))
    two = F.array(first, F.col("name"), F.lit("Other text"))
    return docs.select("doc_id", F.posexplode(two).alias("pos", "text"))


def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    return segment.title_candidates(_title_lines(spark, d))


_TITLES = """n AS (SELECT n_nationkey AS k, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM nation),
 t AS (SELECT doc_id, doc_id % 4 AS kind, name FROM documents JOIN n ON n.k = doc_id % 25)"""


def document_entities(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("BR", "Nation_1"), ("CN", "Nation_2"), ("CA", "Nation_3"), ("PE", "Nation_10"), ("RO", "Nation_11"), ("US", "Nation_24")], "code string, alias string")
    docs = I.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("BR")).alias("explicit_code"))
    return segment.resolve_document_entity(docs, segment.title_candidates(_title_lines(spark, d)), names)


def sections_from_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.carry_headings(_html_blocks(spark, d)).withColumn("role", F.when(F.col("heading_level").isNotNull(), "subsection").otherwise("content"))
    s = segment.build_sections(rows, keys=("section", "subsection"))
    return s.select("doc_id", "island", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("subsection", F.lit("")).alias("subsection"), F.length("content").alias("chars"))


def repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    return segment.drop_repeated_blocks(I.blocks(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("content"))
    p = segment.split_sections(docs, 1000)
    return p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max(F.length("content")).alias("longest"), F.sum(F.length(F.regexp_replace("content", r"\s+", ""))).alias("solid"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    doc = corpus.document_id(F.col("country_code"), F.col("language"), "labour")
    w = Window.partitionBy("document", "document_type", "legal_topic", "subsection").orderBy("chunk_id")
    rows = c.withColumn("document", doc).withColumn("occurrence", F.row_number().over(w))
    cid = corpus.chunk_id(F.col("document"), F.col("document_type"), F.col("legal_topic"), F.lit("Section"), F.col("subsection"), F.col("occurrence"))
    return rows.select("chunk_id", F.col("document").alias("document_id"), cid.alias("id"), "occurrence", F.sha2("content", 256).alias("content_hash"))


def enriched_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    pieces = c.select(F.col("chunk_id").alias("doc_id"), F.lit(0).alias("island"), F.lit(0).alias("piece"), "section", F.when(F.col("chunk_id") % 17 == 0, "unknown").otherwise(F.col("legal_topic")).alias("topic"), "subsection", "content")
    meta = c.select(F.col("chunk_id").alias("doc_id"), "country", "country_code", "language", F.lit("f.docx").alias("source_filename"), F.lit("docx").alias("source_format"), "reference_year")
    topics = spark.createDataFrame([(t,) for t in I.FIVE], "topic string")
    good, bad = segment.enrich_chunks(pieces, meta, topics, "labour")
    ok = good.groupBy("document_type").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))
    return ok.unionByName(bad.agg(F.lit("rejected").alias("document_type"), F.count("*").alias("n"), F.lit(0).cast("long").alias("ids")))


def document_id_check(spark: SparkSession, d: str) -> DataFrame:
    good = corpus.document_id(F.col("source"), F.col("lang"), "labour")
    ids = I.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.upper(good)).when(F.col("doc_id") % 5 == 1, F.substring(good, 1, 60)).otherwise(good).alias("document_id"))
    return corpus.valid_document_ids(ids)


def contact_fields(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return I.table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(segment.EMAIL), F.lit(0))).alias("emails"), F.regexp_extract(t, segment.EMAIL, 0).alias("email"), F.regexp_extract(t, segment.PHONE, 0).alias("phone")).where("emails > 0 or phone <> ''")


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contact blocks made from the customers, ten for each document, in pairs of firm and person."""
    c = I.table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 10).alias("doc_id"), (F.col("c_custkey") % 10).cast("int").alias("block_idx"), F.col("c_custkey").cast("string").alias("k"))
    firm = F.array(F.concat(F.lit("Firm "), "k"), F.concat(F.lit("Street "), "k"), F.concat(F.lit("Tel: +32 2 643 "), F.lpad("k", 4, "0")), F.concat(F.lit("office"), "k", F.lit("@example.com")))
    person = F.array(F.lit("Contact:"), F.concat(F.lit("Person "), "k"), F.concat(F.lit("p"), "k", F.lit("@example.com")))
    blocks = c.select("doc_id", "block_idx", F.when(F.col("block_idx") % 2 == 0, firm).otherwise(person).alias("lines"), F.lit(None).cast("string").alias("country"))
    return segment.extract_contacts(blocks)


def contact_texts(spark: SparkSession, d: str) -> DataFrame:
    return segment.contact_text(contacts(spark, d)).select("doc_id", F.sha2(segment.clean_contact_text(F.col("content")), 256).alias("digest"), F.length("content").alias("chars"))


def metadata_violations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    meta = I.table(spark, d, "documents").select("doc_id", F.when(k % 6 == 0, " ").otherwise(F.col("source")).alias("country"), F.when(k % 5 == 0, "ABC").otherwise("AB").alias("country_code"), F.col("lang").alias("language"), F.lit("f").alias("source_filename"), (1890 + k % 220).cast("int").alias("reference_year"))
    return segment.validate_metadata(meta).groupBy("violation").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def batch_violations(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    rows = c.select((F.col("chunk_id") % 50).alias("batch"), F.when(F.col("chunk_id") % 50 < 25, 0).otherwise(F.col("document_id")).alias("document_id"), F.lit("f").alias("source_filename"), F.when(F.col("chunk_id") % 50 < 10, "en").otherwise(F.col("language")).alias("language"), F.lit("XX").alias("country_code"), F.lit("X").alias("country"), F.when(F.col("chunk_id") % 50 == 3, 1).otherwise(F.col("chunk_id")).alias("chunk_id"))
    return corpus.validate_batch(rows, "batch")


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = I.chunks(spark, d).select("chunk_id", "document_id", "country_code", F.length("content").alias("v"))
    return c.where("chunk_id % 2 = 0 or chunk_id % 3 = 0"), c.where("document_id % 2 = 0 and chunk_id % 4 <> 2")


def upsert_stale(spark: SparkSession, d: str) -> DataFrame:
    return corpus.upsert_stats(*_old_new(spark, d))


def upserted_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus.upsert_document(*_old_new(spark, d)).groupBy("country_code").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def deleted_corpus(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return corpus.delete_documents(old, new).groupBy("country_code").agg(F.count("*").alias("n"))


def reindexed_corpus(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    renamed = old.where("document_id % 5 = 0").select(F.col("document_id").alias("old_id"), (-F.col("document_id")).alias("new_id")).distinct()
    return corpus.reindex_documents(old, new.where("document_id % 5 <> 0"), renamed).groupBy("country_code").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def replace_plan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 20
    docs = I.table(spark, d, "documents").select(F.col("source").alias("country_code"), F.when(n < 10, 1).otherwise(F.col("doc_id")).alias("document_id"), F.lit("f").alias("source_filename"), F.when(n % 3 == 0, "h").otherwise("g").alias("sha256"), "doc_id").where("source <> 'src5'")
    incoming = I.table(spark, d, "documents").select(F.col("source").alias("country_code"), F.lit("h").alias("sha256")).distinct()
    return corpus.plan_replacement(docs.drop("doc_id"), incoming, F.col("country_code") == "src7")


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    files = I.table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"))
    return audit.duplicate_files(files)


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = I.table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("document_id"), F.count("*").alias("chunk_count"))
    k = F.col("document_id")
    docs = docs.select("document_id", F.when(k % 7 == 0, "1").when(k % 2 == 0, "AB").otherwise("CD").alias("country_code"), F.concat(F.lit("old"), (k % 3).cast("string"), F.lit(".docx")).alias("source_filename"), "chunk_count")
    files = spark.createDataFrame([("AB.docx", "/a/AB.docx"), ("old1.docx", "/a/old1.docx")], "name string, path string")
    return docs, files


def source_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.source_audit(*_files(spark, d))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.corpus_coverage(I.chunks(spark, d).withColumn("document_id", F.col("country_code")), I.FIVE)
    return rows.select("document_id", "chunks", "overview_chunks", "comparator_chunks", "duplicate_ids", "max_length", F.array_join("missing_topics", ",").alias("missing"), "status")


def corpus_validation(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    expected = c.select("document_id").distinct().select("document_id", F.lit("SRC1").alias("country_code"))
    found = c.where("subsection = 'Contact'").select("document_id")
    rows = audit.corpus_validation(c, found, expected)
    return rows.select("document_id", "chunks", F.array_join("topics", ",").alias("topics"), "contacts", F.array_join("warnings", ",").alias("warnings"), "valid")


def structure_profile(spark: SparkSession, d: str) -> DataFrame:
    b = _html_blocks(spark, d).withColumns({"kind": F.when(F.col("tag").isin("td", "th"), "table").otherwise("text"), "style": F.col("tag"), "topic": F.lower(F.substring("text", 1, 1))})
    p = audit.structure_profile(b, 5, 3)
    styles = F.array_join(F.transform("styles", lambda s: F.concat_ws("=", s["style"], s["count"].cast("string"))), ",")
    levels = F.array_join(F.transform(F.map_entries("heading_levels"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return p.select("doc_id", "blocks", "tables", "topics_found", "topics_on_h1", "structure", F.coalesce(levels, F.lit("")).alias("levels"), styles.alias("top_styles"))


def suspicious_headings(spark: SparkSession, d: str) -> DataFrame:
    b = _html_blocks(spark, d).withColumns({"topic": F.when(F.length("text") % 2 == 0, F.col("text")), "numbered": F.col("text").rlike("^[A-M]"), "unbolded": F.col("pos") % 5 == 0})
    return audit.suspicious_blocks(b, b.where("pos % 3 = 0").select("doc_id", "pos")).groupBy("reasons").agg(F.count("*").alias("n"))


def long_sections(spark: SparkSession, d: str) -> DataFrame:
    s = I.table(spark, d, "documents").select((F.col("doc_id") % 100).alias("doc_id"), F.col("doc_id").cast("string").alias("section"), F.col("text").alias("content"))
    rows = audit.section_sizes(s)
    return rows.select("doc_id", "sections", "estimated_chunks", "max_length", F.array_join(F.transform("over_limit", lambda o: F.concat_ws("=", o["section"], o["length"].cast("string"))), ",").alias("over"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    words = X.search_tokens(F.col("text"))
    b = _html_blocks(spark, d).where("heading_level is not null").withColumn("text", F.concat(F.get(words, F.lit(0)), F.when(F.col("pos") % 2 == 0, " :").otherwise("")))
    return b.where("text is not null").withColumns({"country_code": F.concat(F.lit("C"), (F.col("doc_id") % 3).cast("string")), "topic": F.when(F.col("heading_level") == 1, F.substring("text", 1, 2)), "bold": F.col("doc_id") % 3 != 0})


def reference_labels(spark: SparkSession, d: str) -> DataFrame:
    r = audit.reference_labels(_labelled(spark, d))
    return r.select("key", "n", F.array_join(F.transform("variants", lambda v: F.concat_ws("=", v["variant"], v["n"].cast("string"))), ",").alias("variants"), F.array_join("countries", ",").alias("countries"))


def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    b = _labelled(spark, d)
    return audit.label_candidates(b.where("doc_id % 2 = 1"), audit.reference_labels(b.where("doc_id % 2 = 0"))).select("doc_id", "pos", "key", F.coalesce("current_topic", F.lit("")).alias("current_topic"), "matched")


def best_heading(spark: SparkSession, d: str) -> DataFrame:
    b = _labelled(spark, d).withColumn("initial", F.substring("text", 1, 1))
    score = audit.structural_score(F.col("heading_level"), F.col("pos") % 3 == 0, F.col("pos") % 5 == 0, (F.col("pos") % 7).cast("int"), F.col("pos") % 2 == 0, F.col("pos") % 11 == 0)
    return audit.best_candidate(b.withColumn("score", score), ["doc_id", "initial"]).select("doc_id", "initial", "pos", "score", "duplicates")


def indexing_summary(spark: SparkSession, d: str) -> DataFrame:
    r = I.table(spark, d, "labels").select(F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"), F.lit(3).alias("prepared"), F.lit(2).alias("indexed"), F.col("toxic").alias("stale"))
    return audit.indexing_summary(r)


def ordered_unions(spark: SparkSession, d: str) -> DataFrame:
    t = I.turns(spark, d).select("conv_id", "turn", X.search_tokens(F.col("text")).alias("codes"))
    return audit.ordered_union(t, "conv_id", "turn", "codes").select("conv_id", F.array_join("merged", " ").alias("merged"))


def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    n = I.table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 6 == 0, "same").when(F.col("n_nationkey") % 7 == 0, " ").otherwise(F.col("n_name")).alias("alias"), F.when(F.col("n_nationkey") % 5 == 0, F.substring("n_name", 1, 3)).otherwise(F.substring("n_name", 1, 2)).alias("code"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"))
    regions = I.table(spark, d, "region").where("r_regionkey < 4").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("r"))
    return dims.check_dimension(n, "alias", "code", "region", regions)


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents as text files, one folder for each source, listed and hashed; a lock file among them is left out."""
    path = fresh_path(spark, "files")
    docs = I.table(spark, d, "documents").select("source", F.col("text").alias("value"))
    docs.repartition("source").write.partitionBy("source").text(path)
    spark.range(1).select(F.lit("lock").alias("value")).coalesce(1).write.text(f"{path}/source=~$lock")
    files = corpus.read_corpus_files(spark, path, "*.txt")
    named = files.withColumn("source", F.regexp_extract("path", "source=([^/]*)", 1)).where("source not like '~$%' and source not like '%7E%'")
    return named.groupBy("source").agg(F.sum("length").alias("bytes"), F.count_if(F.length("sha256") == 64).alias("hashed") - F.count("*").alias("n")).toDF("source", "bytes", "unhashed")


def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A chunk table by country, on disk; the countries of every third document are replaced by its shorter version, then it is read back."""
    path = fresh_path(spark, "chunks")
    rows = I.chunks(spark, d).select(F.col("chunk_id").cast("string"), F.col("document_id").cast("string"), "country", "country_code", "legal_topic", "document_type", "language", "section", "subsection", "content", F.lit("f").alias("source_filename"), F.lit("docx").alias("source_format"), F.lit("h").alias("content_hash"), "reference_year")
    corpus.replace_partition(rows, path)
    corpus.replace_partition(rows.where("country_code in ('SRC1', 'SRC3') and cast(chunk_id as long) % 3 = 0"), path)
    versioned.compact(spark, path, fewest=2)
    back = corpus.scan_chunks(spark, path)
    one = corpus.scan_by_key(back, "country_code", "SRC1").agg(F.lit("SRC1 alone").alias("country_code"), F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    return back.groupBy("country_code").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")).unionByName(one)


def incremental_versions(spark: SparkSession, d: str) -> DataFrame:
    """The documents' chunks arrive as a stream in two loads, the second replacing every document of an even number; the table's current version."""
    root = fresh_path(spark, "stream")
    rows = I.chunks(spark, d).select(F.col("chunk_id").cast("string"), F.col("document_id").cast("string"), "country", "country_code", "legal_topic", "document_type", "language", "section", "subsection", "content", F.lit("f").alias("source_filename"), F.lit("docx").alias("source_format"), F.lit("h").alias("content_hash"), "reference_year")
    second = rows.where("cast(document_id as long) % 2 = 0 and cast(chunk_id as long) % 4 < 2")
    for part in (rows, second):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(corpus.CHUNK_SCHEMA).parquet(f"{root}/in")
        streams.incremental_corpus(stream, f"{root}/table", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    now = streams.current_corpus(spark, f"{root}/table")
    return now.groupBy("country_code").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"), F.sum(F.length("content")).alias("chars"))


def _capitals() -> dict[str, str]:
    """Letters with a capital of one character, as DuckDB's ``upper`` has them: Unicode's simple capitals and the capital sharp s."""
    out = {"ß": "ẞ"}
    for c in map(chr, range(0x80, 0x20000)):
        one = next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
        if one != c:
            out[c] = one
    return out


_CAPITALS = {**dict(zip(string.ascii_lowercase, string.ascii_uppercase, strict=True)), **_capitals()}


def _capital(c: Column) -> Column:
    """Letter by letter, so no text grows; Spark's ``upper`` writes a sharp s as two letters."""
    return F.translate(c, "".join(_CAPITALS), "".join(_CAPITALS.values()))


def _dimensions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics, subsections and an override taken from the headings of every third page."""
    heads = segment.carry_headings(_html_blocks(spark, d).where("heading_level is not null and doc_id % 3 = 0"))
    label = X.topic_label(F.col("text"))
    topics = heads.where("heading_level = 1").select(label.alias("label"), _capital(label).alias("topic")).distinct()
    subs = heads.where("heading_level > 1 and section is not null").select(_capital(X.topic_label(F.col("section"))).alias("parent"), X.subsection_label(F.col("text")).alias("label"), _capital(F.col("text")).alias("subsection"))
    # a label that is written in two ways goes by the smaller one
    subs = subs.groupBy("parent", "label").agg(F.min("subsection").alias("subsection"))
    over = heads.where("heading_level = 3").agg(F.min(X.subsection_label(F.col("text"))).alias("label")).select("label", F.lit("OVERRIDE").alias("topic"))
    return topics, subs, over


def classified_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Roles and headings of all blocks of the pages, against dimensions that know some of their headings."""
    topics, subs, over = _dimensions(spark, d)
    false = F.lit(False)
    blocks = _html_blocks(spark, d).withColumns({"numbered": false, "bold": false, "unbolded": F.col("pos") % 7 == 0, "names": F.array().cast("array<string>")})
    rows = segment.classify_blocks(blocks, topics, subs, over)
    return rows.select("doc_id", "pos", "role", "section", "topic", "subsection", "island")


def named_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sources as entity names, in another writing, to their codes."""
    dim = I.table(spark, d, "documents").select(F.concat(F.upper("source"), F.lit(" Land")).alias("alias"), F.concat(F.lit("C"), F.substring("source", 4, 9)).alias("code")).where("code <> 'C2'").distinct()
    rows = I.table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), "source", F.lit("_land ")).alias("name"))
    return dims.join_entity(rows, F.col("name"), dim).select("doc_id", "entity_code")


QUERIES = {f.__name__: f for f in (corpus_files, replaced_partitions, incremental_versions, classified_blocks, named_documents, text_blocks, html_headings, table_text, front_matter_cap, title_candidates, document_entities, sections_from_headings, repeated_blocks, split_chunks, chunk_ids, enriched_chunks, document_id_check, contact_fields, contacts, contact_texts, metadata_violations, batch_violations, upsert_stale, upserted_corpus, deleted_corpus, reindexed_corpus, replace_plan, duplicate_texts, source_audit, coverage_report, corpus_validation, structure_profile, suspicious_headings, long_sections, reference_labels, label_candidates, best_heading, indexing_summary, ordered_unions, dimension_check)}

W = "WITH "
_TAGS = "h1|h2|h3|h4|h5|h6|p|li|td|th|title"
# Blocks of pages: RE2 has no look-ahead, so the page is cut in front of every block tag.
_HTML = f"""cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<(script)\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?i)(</?(?:{_TAGS})\\b)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM pages),
 e AS (SELECT page_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM cut),
 g AS (SELECT page_id, raw, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM e WHERE i < n AND regexp_matches(raw, '^<(?i:{_TAGS})\\b[^>]*>')),
 html_blocks AS (SELECT page_id AS doc_id, pos, tag, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS heading_level, text FROM (
  SELECT page_id, pos, lower(regexp_extract(raw, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '^<[^>]*>', ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS text FROM g) WHERE text <> '')"""
_BODY = _HTML + ", b AS (SELECT * FROM html_blocks WHERE tag <> 'title')"
_LABELLED = _BODY + """, w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')[1] AS w FROM b WHERE heading_level IS NOT NULL),
 l AS (SELECT doc_id, pos, heading_level, w || CASE WHEN pos % 2 = 0 THEN ' :' ELSE '' END AS text, w AS key, 'C' || CAST(doc_id % 3 AS VARCHAR) AS country_code, CASE WHEN heading_level = 1 THEN substr(w || CASE WHEN pos % 2 = 0 THEN ' :' ELSE '' END, 1, 2) END AS topic, doc_id % 3 <> 0 AS bold FROM w WHERE w IS NOT NULL)"""
_OLD_NEW = I.CHUNKS_SQL + ", old AS (SELECT chunk_id, document_id, country_code, length(content) AS v FROM chunks WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0), new AS (SELECT chunk_id, document_id, country_code, length(content) AS v FROM chunks WHERE document_id % 2 = 0 AND chunk_id % 4 <> 2)"
_DOC = "'doc_' || sha256('document-v2' || chr(31) || 'labour' || chr(31) || upper({c}) || chr(31) || lower({l}))"

_CONTACTS = """WITH c AS (SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS doc_id, c_custkey % 10 AS i, 'Firm ' || CAST(c_custkey AS VARCHAR) AS c_name, CAST(c_custkey AS VARCHAR) AS k FROM customer),
  f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pair, c_name, 'Street ' || k AS address, '+32 2 643 ' || lpad(k, 4, '0') AS phone, 'office' || k || '@example.com' AS fe FROM c WHERE i % 2 = 0),
  p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pair, 'Person ' || k AS person, 'p' || k || '@example.com' AS pe FROM c WHERE i % 2 = 1)
  SELECT coalesce(f.doc_id, p.doc_id) AS doc_id, CAST(coalesce(f.pair, p.pair) AS INTEGER) AS pair, c_name AS member_firm, person AS contact_person, coalesce(pe, fe) AS email, phone, address, CAST(NULL AS VARCHAR) AS website FROM f FULL JOIN p ON f.doc_id = p.doc_id AND f.pair = p.pair"""

# Labels of the pages' headings: numbering and decoration go (their texts hold no dashes or curly apostrophes).
_LABEL = "trim(regexp_replace(regexp_replace(text, '(?i)^\\s*(?:[|¦=]+\\s*)?(?:(?:\\d{1,2}|[IVX]{1,6})\\s*[.)]\\s*)?', ''), '\\s*[|¦=]+\\s*$', ''))"
_SUB = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^\\s*[a-z]\\s*[.)]\\s*', ''), '\\s*[:|¦=]+\\s*$', ''), '\\s*/\\s*', '/', 'g'), '\\s*-\\s*', ' - ', 'g')))"
_CLASSIFIED = _BODY + ", l AS (SELECT *, " + _LABEL + " AS label, " + _SUB + """ AS sub FROM b),
 hd AS (SELECT *, last_value(CASE WHEN heading_level = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS under FROM l WHERE heading_level IS NOT NULL AND doc_id % 3 = 0),
 tp AS (SELECT DISTINCT lower(label) AS alias, upper(label) AS topic FROM hd WHERE heading_level = 1),
 sb AS (SELECT upper(under) AS parent, sub, min(upper(text)) AS name FROM hd WHERE heading_level > 1 AND under IS NOT NULL GROUP BY ALL),
 ov AS (SELECT min(sub) AS sub FROM hd WHERE heading_level = 3),
 m AS (SELECT l.*, tp.topic AS own, l.sub = ov.sub AND heading_level IS NOT NULL AS over, CASE WHEN l.sub = ov.sub AND heading_level IS NOT NULL THEN 'override' WHEN tp.topic IS NOT NULL AND (heading_level = 1 OR regexp_matches(text, '^\\s*(?:[|¦=]+\\s*)?(?:\\d{1,2}|[IVX]{1,6})\\s*[.)]')) THEN 'topic'
   WHEN heading_level = 1 AND lower(label) IN ('general', 'employment law overview', 'labour and employment law overview') THEN 'overview' WHEN heading_level = 1 THEN 'generic_main' END AS main FROM l LEFT JOIN tp ON lower(label) = tp.alias CROSS JOIN ov),
 s AS (SELECT *, last_value(CASE WHEN main IN ('topic', 'overview', 'generic_main') THEN struct_pack(label := label, topic := CASE WHEN main = 'topic' THEN own END, strict := main <> 'generic_main') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM m),
 k AS (SELECT s.*, sb.name AS known FROM s LEFT JOIN sb ON s.sec.topic IS NOT DISTINCT FROM sb.parent AND s.sub = sb.sub),
 r AS (SELECT *, CASE WHEN main IS NOT NULL THEN main WHEN known IS NOT NULL AND coalesce(heading_level IN (2, 4), false) AND pos % 7 <> 0 THEN 'subsection' WHEN NOT coalesce(sec.strict, true) AND coalesce(heading_level = 2, false) THEN 'subsection' ELSE 'content' END AS role FROM k),
 z AS (SELECT *, last_value(CASE WHEN role <> 'content' THEN struct_pack(role := role, sub := CASE WHEN role = 'subsection' THEN coalesce(known, text) END, t := text) END IGNORE NULLS) OVER w AS last, sum(CASE WHEN role <> 'content' THEN 1 ELSE 0 END) OVER w AS island FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""

ORACLE_SQL = {
    "corpus_files": "SELECT source, CAST(sum(octet_length(CAST(encode(text) AS BLOB)) + 1) AS BIGINT) AS bytes, 0 AS unhashed FROM documents GROUP BY source",
    "replaced_partitions": W + I.CHUNKS_SQL + ", k AS (SELECT country_code, content FROM chunks WHERE country_code NOT IN ('SRC1', 'SRC3') OR chunk_id % 3 = 0) SELECT country_code, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM k GROUP BY country_code UNION ALL SELECT 'SRC1 alone', count(*), CAST(sum(length(content)) AS BIGINT) FROM k WHERE country_code = 'SRC1'",
    "incremental_versions": W + I.CHUNKS_SQL + ", k AS (SELECT * FROM chunks WHERE document_id % 2 = 1 OR chunk_id % 4 < 2 OR document_id NOT IN (SELECT document_id FROM chunks WHERE document_id % 2 = 0 AND chunk_id % 4 < 2)) SELECT country_code, count(*) AS n, count(DISTINCT document_id) AS documents, CAST(sum(length(content)) AS BIGINT) AS chars FROM k GROUP BY country_code",
    "classified_blocks": W + _CLASSIFIED + " SELECT doc_id, pos, role, CASE WHEN last.role = 'override' THEN 'OVERRIDE' ELSE sec.label END AS section, CASE WHEN last.role = 'override' THEN 'OVERRIDE' ELSE sec.topic END AS topic, CASE WHEN last.role = 'override' THEN last.t ELSE last.sub END AS subsection, CAST(island AS BIGINT) AS island FROM z",
    "named_documents": "SELECT doc_id, CASE WHEN source <> 'src2' THEN 'C' || substr(source, 4, 9) END AS entity_code FROM documents",
    "text_blocks": W + I.BLOCKS_SQL + " SELECT doc_id, count(*) AS blocks, max(pos) AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY doc_id",
    "html_headings": W + _HTML + " SELECT doc_id AS page_id, heading_level, count(*) AS n, min(text) AS first FROM html_blocks WHERE heading_level IS NOT NULL GROUP BY doc_id, heading_level",
    "table_text": "SELECT o_custkey AS doc_id, o_orderkey % 2 AS table_idx, string_agg(o_orderstatus || ' | - | ' || CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey, o_orderkey % 2",
    "front_matter_cap": W + I.BLOCKS_SQL + ", f AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(n) AS INTEGER) AS last FROM f WHERE n <= 12 AND seen < 1500 GROUP BY doc_id",
    "title_candidates": W + _TITLES + " SELECT doc_id, 0 AS pos, name AS raw_country, CASE kind WHEN 0 THEN 2024 WHEN 2 THEN 2023 END AS year FROM t",
    "document_entities": W + _TITLES + """, d AS (SELECT doc_id, kind, CASE name WHEN 'Nation_1' THEN 'BR' WHEN 'Nation_2' THEN 'CN' WHEN 'Nation_3' THEN 'CA' WHEN 'Nation_10' THEN 'PE' WHEN 'Nation_11' THEN 'RO' WHEN 'Nation_24' THEN 'US' END AS code FROM t)
  SELECT doc_id, code, CASE WHEN code IS NOT NULL THEN CASE kind WHEN 0 THEN 2024 WHEN 2 THEN 2023 END END AS year, CASE WHEN code IS NULL THEN 'undeterminable' WHEN doc_id % 3 = 0 AND code <> 'BR' THEN 'mismatch' ELSE 'resolved' END AS status FROM d""",
    "sections_from_headings": W + _BODY + """, c AS (SELECT *, sum(CASE WHEN heading_level IS NOT NULL THEN 1 ELSE 0 END) OVER w AS island, sum(CASE WHEN heading_level = 1 THEN 1 ELSE 0 END) OVER w AS n, last_value(CASE WHEN heading_level = 1 THEN text END IGNORE NULLS) OVER w AS section FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, last_value(CASE WHEN heading_level > 1 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subsection FROM c)
  SELECT doc_id, CAST(island AS BIGINT) AS island, coalesce(section, '') AS section, coalesce(subsection, '') AS subsection, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS INTEGER) AS chars FROM s WHERE heading_level IS NULL GROUP BY doc_id, island, section, subsection HAVING regexp_matches(string_agg(text, chr(10) ORDER BY pos), '[\\p{L}\\p{N}]')""",
    "repeated_blocks": W + I.BLOCKS_SQL + ", r AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM blocks) SELECT doc_id, count(*) AS n FROM r WHERE text IS DISTINCT FROM before GROUP BY doc_id",
    "chunk_ids": W + I.CHUNKS_SQL + ", d AS (SELECT *, " + _DOC.format(c="country_code", l="language") + " AS document FROM chunks), o AS (SELECT *, row_number() OVER (PARTITION BY document, document_type, legal_topic, subsection ORDER BY chunk_id) AS n FROM d) SELECT chunk_id, document AS document_id, 'chunk_' || sha256('chunk-v1' || chr(31) || document || chr(31) || document_type || chr(31) || coalesce(legal_topic, '') || chr(31) || 'section' || chr(31) || lower(coalesce(subsection, '')) || chr(31) || CAST(n AS VARCHAR)) AS id, CAST(n AS INTEGER) AS occurrence, sha256(content) AS content_hash FROM o",
    "enriched_chunks": W + I.CHUNKS_SQL + ", k AS (SELECT *, CASE WHEN chunk_id % 17 = 0 THEN 'rejected' WHEN legal_topic IS NULL THEN 'overview' ELSE 'comparator' END AS t FROM chunks WHERE trim(content) <> '') SELECT t AS document_type, count(*) AS n, CASE WHEN t = 'rejected' THEN 0 ELSE count(*) END AS ids FROM k GROUP BY t",
    "document_id_check": "WITH d AS (SELECT doc_id, " + _DOC.format(c="source", l="lang") + " AS g FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(g) WHEN 1 THEN substr(g, 1, 60) ELSE g END AS document_id, doc_id % 5 > 1 AS valid FROM d",
    "contact_fields": "WITH c AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS INTEGER) AS emails, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email, regexp_extract(text, '\\+?[0-9][0-9 ()./-]{6,}[0-9]') AS phone FROM documents) SELECT * FROM c WHERE emails > 0 OR phone <> ''",
    "contacts": _CONTACTS,
    "contact_texts": "WITH c AS (" + _CONTACTS + "), e AS (SELECT doc_id, string_agg(array_to_string(list_filter(['Member firm: ' || member_firm, 'Contact person: ' || contact_person, 'Email: ' || email, 'Phone: ' || phone, 'Address: ' || address], lambda x: x IS NOT NULL), chr(10)), chr(10) || chr(10) ORDER BY pair) AS t FROM c GROUP BY doc_id) SELECT doc_id, sha256(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM e",
    "metadata_violations": "WITH v AS (SELECT doc_id, 'country_blank' AS violation FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'country_code_form' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'year_range' FROM documents WHERE 1890 + doc_id % 220 NOT BETWEEN 1900 AND 2100) SELECT violation, count(*) AS n, min(doc_id) AS first FROM v GROUP BY violation",
    "batch_violations": W + I.CHUNKS_SQL + """, r AS (SELECT chunk_id % 50 AS batch, CASE WHEN chunk_id % 50 < 25 THEN 0 ELSE document_id END AS document_id, CASE WHEN chunk_id % 50 < 10 THEN 'en' ELSE language END AS language, CASE WHEN chunk_id % 50 = 3 THEN 1 ELSE chunk_id END AS chunk_id FROM chunks),
  s AS (SELECT batch, count(DISTINCT document_id) AS d, count(DISTINCT language) AS l, count(*) AS n, count(DISTINCT chunk_id) AS ids FROM r GROUP BY batch)
  SELECT batch, 'documents_differ' AS violation FROM s WHERE d <> 1 UNION ALL SELECT batch, 'languages_differ' FROM s WHERE l <> 1 UNION ALL SELECT batch, 'chunk_id_repeated' FROM s WHERE ids < n""",
    "upsert_stale": W + _OLD_NEW + ", s AS (SELECT document_id, count(*) AS stale FROM old WHERE document_id IN (SELECT document_id FROM new) AND chunk_id NOT IN (SELECT chunk_id FROM new) GROUP BY document_id) SELECT document_id, count(*) AS requested, count(DISTINCT chunk_id) AS indexed, coalesce(max(stale), 0) AS stale FROM new LEFT JOIN s USING (document_id) GROUP BY document_id",
    "upserted_corpus": W + _OLD_NEW + " SELECT country_code, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new) GROUP BY country_code",
    "deleted_corpus": W + _OLD_NEW + " SELECT country_code, count(*) AS n FROM old WHERE document_id NOT IN (SELECT document_id FROM new) GROUP BY country_code",
    "reindexed_corpus": W + _OLD_NEW + ", b AS (SELECT * FROM new WHERE document_id % 5 <> 0) SELECT country_code, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM b) AND (document_id % 5 <> 0 OR document_id = 0) UNION ALL SELECT * FROM b) GROUP BY country_code",
    "replace_plan": """WITH e AS (SELECT source, count(DISTINCT CASE WHEN doc_id % 20 < 10 THEN 1 ELSE doc_id END) AS d, min(CASE WHEN (doc_id % 20) % 3 = 0 THEN 'h' ELSE 'g' END) AS lo, max(CASE WHEN (doc_id % 20) % 3 = 0 THEN 'h' ELSE 'g' END) AS hi FROM documents WHERE source <> 'src5' GROUP BY source)
  SELECT s.source AS country_code, 'h' AS sha256, CASE WHEN d IS NULL THEN 'fresh' WHEN d = 1 AND lo = 'h' AND hi = 'h' THEN 'already_current' WHEN s.source = 'src7' THEN 'replace' ELSE 'replacement_required' END AS status FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN e USING (source)""",
    "duplicate_texts": "SELECT sha256(text) AS sha256, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, n FROM documents JOIN (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) USING (text)",
    "source_audit": """WITH d AS (SELECT min(doc_id) AS k, count(*) AS c FROM documents GROUP BY source, lang), s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'invalid_metadata' WHEN k % 2 = 0 AND k % 3 = 1 THEN 'conflict' WHEN k % 2 = 0 OR k % 3 = 1 THEN 'resolved' ELSE 'missing' END AS status FROM d)
  SELECT status, count(*) AS documents, CAST(sum(c) AS BIGINT) AS chunks FROM s GROUP BY ROLLUP (status)""",
    "coverage_report": W + I.CHUNKS_SQL + """, p AS (SELECT country_code, count(*) AS chunks, count(*) FILTER (document_type = 'overview') AS o, count(*) FILTER (document_type = 'comparator') AS c, max(length(content)) AS m, list(DISTINCT legal_topic) AS f, count(*) - count(DISTINCT chunk_id) AS dup FROM chunks GROUP BY country_code)
  SELECT country_code AS document_id, chunks, o AS overview_chunks, c AS comparator_chunks, dup AS duplicate_ids, CAST(m AS INTEGER) AS max_length, array_to_string(list_filter(['alpha', 'beta', 'gamma', 'delta', 'epsilon'], lambda t: NOT list_contains(f, t)), ',') AS missing, CASE WHEN len(list_filter(['alpha', 'beta', 'gamma', 'delta', 'epsilon'], lambda t: NOT list_contains(f, t))) = 0 AND dup = 0 AND o > 0 THEN 'OK' ELSE 'CHECK' END AS status FROM p""",
    "corpus_validation": W + I.CHUNKS_SQL + """, p AS (SELECT document_id, count(*) AS chunks, coalesce(string_agg(DISTINCT legal_topic, ',' ORDER BY legal_topic), '') AS topics, count(*) FILTER (subsection = 'Contact') AS contacts, bool_or(country_code <> 'SRC1') AS f FROM chunks GROUP BY document_id)
  SELECT document_id, chunks, topics, contacts, array_to_string(list_filter([CASE WHEN f THEN 'foreign_country' END, CASE WHEN contacts = 0 THEN 'no_contact' END], lambda x: x IS NOT NULL), ',') AS warnings, NOT f AS valid FROM p""",
    "structure_profile": W + _BODY + """, t AS (SELECT *, lower(substr(text, 1, 1)) AS topic FROM b), st AS (SELECT doc_id, tag, count(*) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, tag) AS r FROM t GROUP BY doc_id, tag),
  ss AS (SELECT doc_id, string_agg(tag || '=' || CAST(c AS VARCHAR), ',' ORDER BY r) AS top_styles FROM st WHERE r <= 3 GROUP BY doc_id), lv AS (SELECT doc_id, string_agg(CAST(heading_level AS VARCHAR) || '=' || CAST(c AS VARCHAR), ',' ORDER BY heading_level) AS levels FROM (SELECT doc_id, heading_level, count(*) AS c FROM t WHERE heading_level IS NOT NULL GROUP BY doc_id, heading_level) GROUP BY doc_id),
  p AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (tag IN ('td', 'th')) AS tables, count(DISTINCT topic) AS topics_found, count(DISTINCT CASE WHEN heading_level = 1 THEN topic END) AS topics_on_h1 FROM t GROUP BY doc_id)
  SELECT doc_id, blocks, tables, topics_found, topics_on_h1, CASE WHEN topics_found < 5 THEN 'incomplete' WHEN topics_on_h1 >= 4 THEN 'standard_heading' WHEN topics_on_h1 = 0 THEN 'bold_legacy' ELSE 'hybrid' END AS structure, coalesce(levels, '') AS levels, top_styles FROM p LEFT JOIN lv USING (doc_id) JOIN ss USING (doc_id)""",
    "suspicious_headings": W + _BODY + """, r AS (SELECT array_to_string(list_filter([CASE WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'empty_heading' END, CASE WHEN heading_level = 1 AND length(text) % 2 = 1 THEN 'unrecognised_h1' END, CASE WHEN regexp_matches(text, '^[A-M]') THEN 'numbered_heading' END, CASE WHEN pos % 5 = 0 THEN 'unbolded_heading' END], lambda x: x IS NOT NULL), ',') AS reasons FROM b WHERE heading_level IS NOT NULL AND pos % 3 <> 0)
  SELECT reasons, count(*) AS n FROM r WHERE reasons <> '' GROUP BY reasons""",
    "long_sections": "SELECT doc_id % 100 AS doc_id, count(*) AS sections, CAST(sum(ceil(greatest(length(text), 1) / 6000)) AS BIGINT) AS estimated_chunks, CAST(max(length(text)) AS INTEGER) AS max_length, coalesce(string_agg(CAST(doc_id AS VARCHAR) || '=' || CAST(length(text) AS VARCHAR), ',' ORDER BY length(text) DESC, CAST(doc_id AS VARCHAR)) FILTER (length(text) > 6000), '') AS over FROM documents GROUP BY doc_id % 100",
    "reference_labels": W + _LABELLED + ", v AS (SELECT key, text, count(*) AS c FROM l GROUP BY key, text) SELECT key, CAST(sum(c) AS BIGINT) AS n, string_agg(text || '=' || CAST(c AS VARCHAR), ',' ORDER BY c DESC, text) AS variants, any_value(countries) AS countries FROM v JOIN (SELECT key, string_agg(DISTINCT country_code, ',' ORDER BY country_code) AS countries FROM l GROUP BY key) USING (key) GROUP BY key",
    "label_candidates": W + _LABELLED + ", c AS (SELECT *, last_value(topic IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS t FROM l WHERE doc_id % 2 = 1) SELECT doc_id, CAST(pos AS INTEGER) AS pos, key, coalesce(t, '') AS current_topic, key IN (SELECT key FROM l WHERE doc_id % 2 = 0) AS matched FROM c WHERE bold OR heading_level = 2",
    "best_heading": W + _LABELLED + ", s AS (SELECT doc_id, pos, substr(text, 1, 1) AS initial, CASE WHEN heading_level = 1 THEN 100 ELSE greatest(10, 60 - 10 * heading_level) END + CASE WHEN pos % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN pos % 5 = 0 THEN 20 ELSE 0 END + least(5 * (pos % 7), 20) + CASE WHEN pos % 2 = 0 THEN -15 ELSE 0 END + CASE WHEN pos % 11 = 0 THEN -25 ELSE 0 END AS score FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, initial ORDER BY score DESC, pos) AS r, count(*) OVER (PARTITION BY doc_id, initial) - 1 AS duplicates FROM s) SELECT doc_id, initial, CAST(pos AS INTEGER) AS pos, CAST(score AS INTEGER) AS score, duplicates FROM r WHERE r = 1",
    "indexing_summary": "SELECT count(*) AS discovered, count(*) FILTER (quality = 1) AS success, count(*) FILTER (quality <> 1) AS failed, 3 * count(*) AS prepared, 2 * count(*) AS indexed, CAST(sum(toxic) AS BIGINT) AS stale FROM labels",
    "ordered_unions": "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w), f AS (SELECT conv_id, w, min(turn * 10000000 + i) AS o FROM e GROUP BY conv_id, w) SELECT c.conv_id, coalesce(string_agg(w, ' ' ORDER BY o), '') AS merged FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id",
    "dimension_check": """WITH n AS (SELECT lower(trim(CASE WHEN n_nationkey % 6 = 0 THEN 'same' WHEN n_nationkey % 7 = 0 THEN ' ' ELSE n_name END)) AS alias, CASE WHEN n_nationkey % 5 = 0 THEN substr(n_name, 1, 3) ELSE substr(n_name, 1, 2) END AS code, 'R' || CAST(n_regionkey AS VARCHAR) AS parent FROM nation)
  SELECT 'blank_alias' AS problem, '' AS alias, count(*) AS n FROM n WHERE alias = '' HAVING count(*) > 0
  UNION ALL SELECT 'alias_collision', alias, count(DISTINCT code) FROM n GROUP BY alias, parent HAVING count(DISTINCT code) > 1
  UNION ALL SELECT 'bad_code', alias, count(*) FROM n WHERE NOT regexp_matches(code, '^[A-Z]{2}$') GROUP BY alias
  UNION ALL SELECT 'unknown_parent', alias, count(*) FROM n WHERE parent = 'R4' GROUP BY alias""",
}
