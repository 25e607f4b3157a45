"""Reading files, blocks and chunks; writing versioned chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import versioned

CHUNK_COLUMNS = ("chunk_id", "document_id", "country", "country_code", "legal_topic", "document_type", "language", "section", "subsection", "content", "source_filename", "source_format", "content_hash", "reference_year")
CHUNK_SCHEMA = ", ".join(f"{c} {'int' if c == 'reference_year' else 'string'}" for c in CHUNK_COLUMNS)

# Parts of document and chunk identity, separated by the unit separator.
SEPARATOR, DOCUMENT_VERSION, CHUNK_VERSION = "\u001f", "document-v2", "chunk-v1"


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """A plain scan dealt to all cores (``by`` columns, if given) if its files give fewer partitions than there are cores; large tables stay as they are.

    Work on texts is heavier than moving them, and one small file would otherwise be one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *by) if scan.rdd.getNumPartitions() < cores else scan


def read_corpus_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC1: ``path, name, length, sha256`` of the files under ``path``; office lock files (``~$...``) are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    return named.where(~F.col("name").startswith("~$")).dropDuplicates(["path"])


def text_lines(text: Column) -> Column:
    """``array<struct<pos, text>>``: the non-empty lines of a text, white space squashed; ``pos`` counts all lines."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda line, pos: F.struct(pos.alias("pos"), F.trim(F.regexp_replace(line, r"(?U)[\s ]+", " ")).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def read_text_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """SRC2: ``doc_id, pos, text``: the non-empty lines of each document; ``pos`` counts all lines."""
    return docs.select(doc, F.explode(text_lines(F.col(text))).alias("x")).select(doc, "x.pos", "x.text")


# The block elements of a page that become blocks, and the few entities that are decoded.
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "title")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Text of a fragment: tags dropped, entities decoded, white space squashed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"(?U)[\s ]+", " "))


def read_html_blocks(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """SRC2 for pages: ``page_id, pos, tag, heading_level, text`` of block elements in document order; scripts and styles are dropped."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    tags = "|".join(BLOCK_TAGS)
    found = F.regexp_extract_all(clean, F.lit(rf"(?is)<(?:{tags})\b[^>]*>.*?(?=<(?:/?(?:{tags}))\b)"), F.lit(0))
    parts = pages.select(doc, F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", "^<([A-Za-z][A-Za-z0-9]*)", 1))
    blocks = parts.select(doc, "pos", tag.alias("tag"), html_text(F.regexp_replace("raw", "^<[^>]*>", "")).alias("text"))
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    return blocks.where("text <> ''").select(doc, "pos", "tag", level.alias("heading_level"), "text")


def serialize_tables(cells: DataFrame) -> DataFrame:
    """SRC3: ``cells(doc_id, table_idx, row, col, text)`` -> ``doc_id, table_idx, text``: rows joined by `` | ``, rows without a letter or digit dropped, one line each."""
    rows = cells.groupBy("doc_id", "table_idx", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    rows = rows.withColumn("line", F.array_join(F.transform("c", lambda x: x["text"]), " | ")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    tables = rows.groupBy("doc_id", "table_idx").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    return tables.select("doc_id", "table_idx", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: the versioned chunk table at ``path``, without ``content_hash``."""
    return versioned.read_table(spark, path).select(*[c for c in CHUNK_COLUMNS if c != "content_hash"])


def scan_by_key(chunks: DataFrame, key: str, value: str) -> DataFrame:
    """SRC5: the rows of one country or document; pushed down to the scan."""
    return chunks.where(F.col(key) == value)


#: A snapshot of a country holds at most so many chunks.
SNAPSHOT_CHUNKS = 10_000


def country_snapshot(chunks: DataFrame, code: str, limit: int = SNAPSHOT_CHUNKS) -> DataFrame:
    """SRC5 for a replacement that has to be able to go back: the chunks of a country; the job fails if there are more than ``limit``, rather than give a part of them."""
    rows = scan_by_key(chunks, "country_code", code)
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"{code} has more than {limit} chunks")
    return rows


def document_id(code: Column, language: Column, family: str) -> Column:
    return F.concat(F.lit("doc_"), F.sha2(F.concat_ws(SEPARATOR, F.lit(DOCUMENT_VERSION), F.lit(family), F.upper(code), F.lower(language)), 256))


def chunk_id(document: Column, kind: Column, topic: Column, section: Column, subsection: Column, occurrence: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (document, kind, topic, F.lower(section), F.lower(subsection), occurrence)]
    return F.concat(F.lit("chunk_"), F.sha2(F.concat_ws(SEPARATOR, F.lit(CHUNK_VERSION), *parts), 256))


def valid_document_ids(df: DataFrame, column: str = "document_id") -> DataFrame:
    """SNK7: ``valid``: the fixed form of a document id."""
    return df.withColumn("valid", F.coalesce(F.col(column).rlike("^doc_[0-9a-f]{64}$"), F.lit(False)))


def validate_batch(chunks: DataFrame, batch: str) -> DataFrame:
    """SNK5: ``(batch, violation)`` of write batches: several documents, files, countries or languages, or a chunk id twice."""
    one = {"documents": "document_id", "files": "source_filename", "languages": "language"}
    counts = [F.countDistinct(c).alias(n) for n, c in one.items()]
    stats = chunks.groupBy(batch).agg(*counts, F.countDistinct("country_code", "country").alias("countries"), F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))
    rules = [F.when(F.col(n) != 1, F.lit(f"{n}_differ")) for n in ("documents", "files", "countries", "languages")]
    rules.append(F.when(F.col("ids") < F.col("n"), F.lit("chunk_id_repeated")))
    return stats.select(batch, F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def upsert_document(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK1: the table after an upsert: all rows of the documents in ``new`` are replaced by it, in one pass for any number of documents."""
    touched = new.select("document_id").distinct()
    return existing.join(touched, "document_id", "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def upsert_stats(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Per document of ``new``: rows ``requested``, distinct chunks ``indexed``, and ``stale`` old chunks that went."""
    asked = new.groupBy("document_id").agg(F.count("*").alias("requested"), F.countDistinct("chunk_id").alias("indexed"))
    old = existing.join(new.select("document_id").distinct(), "document_id", "left_semi")
    stale = old.join(new.select("document_id", "chunk_id").distinct(), ["document_id", "chunk_id"], "left_anti").groupBy("document_id").agg(F.count("*").alias("stale"))
    return asked.join(stale, "document_id", "left").na.fill(0, ["stale"])


def replace_partition(new: DataFrame, path: str, key: str = "country_code") -> int:
    """SNK2: every row of the countries in ``new`` is replaced in the versioned table at ``path``, for all of them by one switch; a job that fails leaves the table as it is. Returns the version."""
    return versioned.publish(path, new, key)


def delete_documents(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK3: the table without the documents in ``ids(document_id)``."""
    return existing.join(ids.select("document_id").distinct(), "document_id", "left_anti").select(existing.columns)


def missing_documents(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that a deletion would not find; a caller fails on any."""
    return ids.select("document_id").distinct().join(existing.select("document_id").distinct(), "document_id", "left_anti")


def reindex_documents(existing: DataFrame, rebuilt: DataFrame, renamed: DataFrame) -> DataFrame:
    """SNK4: rebuilt documents in, and old ids (``renamed(old_id, new_id)``) out where the id changed."""
    old = renamed.where("old_id <> new_id").select(F.col("old_id").alias("document_id"))
    return upsert_document(delete_documents(existing, old), rebuilt)


def plan_replacement(existing: DataFrame, incoming: DataFrame, approved: Column | None = None) -> DataFrame:
    """SNK6: ``incoming(country_code, document_id, source_filename, sha256)`` with ``status``.

    ``existing(country_code, document_id, source_filename, sha256)``. ``fresh``: nothing for the country;
    ``already_current``: exactly one document and file, the same file hash; else ``replacement_required``, or
    ``replace`` where ``approved`` is true.
    """
    have = existing.groupBy("country_code").agg(F.countDistinct("document_id").alias("_docs"), F.countDistinct("source_filename").alias("_files"), F.min("sha256").alias("_low"), F.max("sha256").alias("_high"))
    same = (F.col("_docs") == 1) & (F.col("_files") == 1) & (F.col("_low") == F.col("sha256")) & (F.col("_high") == F.col("sha256"))
    ok = approved if approved is not None else F.lit(False)
    status = F.when(F.col("_docs").isNull(), "fresh").when(same, "already_current").when(ok, "replace").otherwise("replacement_required")
    return incoming.join(have, "country_code", "left").withColumn("status", status).drop("_docs", "_files", "_low", "_high")
