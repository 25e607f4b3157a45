"""Documents to front matter, sections, bounded pieces and identified chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import values as V
from lectern.sources import corpus
from lectern.sources.dims import join_subsection, join_topic, small

FRONT_LINES, FRONT_CHARS = 100, 12_000
MAX_CHARS = 6000


def front_matter(blocks: DataFrame, max_lines: int = FRONT_LINES, max_chars: int = FRONT_CHARS) -> DataFrame:
    """SEG1: the first lines of each document until a cap is reached; the line that crosses it stays."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    seen = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumns({"line_no": F.row_number().over(w), "chars_before": seen})
    return rows.where((F.col("line_no") <= max_lines) & (F.col("chars_before") < max_chars))


def title_candidates(lines: DataFrame) -> DataFrame:
    """SEG2: ``doc_id, pos, raw_country, year`` from title lines: the two title wordings, ``prefix / Country``, and a bare heading with the next line."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = F.regexp_replace(X.fold_label(F.col("text")), r"[.:|¦=]+$", "")
    rows = lines.withColumns({"_t": t, "_next": F.lead("text").over(w)})
    title = r"(?i)^(?:labou?r and )?employment law(?: overview)?(?: in|,| -|:) (?:the )?(.+?)(?: (?:-|,)? ?\(?((?:19|20|21)\d\d)\)?)?$"
    slash = r"(?i)^employment law overview ?/ ?(.+)$"
    bare = r"(?i)^(?:labou?r and )?employment law(?: overview)?(?: ((?:19|20|21)\d\d))?$"
    found = (
        F.when(F.col("_t").rlike(slash), F.struct(F.regexp_extract("_t", slash, 1).alias("c"), F.lit("").alias("y")))
        .when(F.col("_t").rlike(bare), F.struct(F.coalesce(X.fold_label(F.col("_next")), F.lit("")).alias("c"), F.regexp_extract("_t", bare, 1).alias("y")))
        .when(F.col("_t").rlike(title), F.struct(F.regexp_extract("_t", title, 1).alias("c"), F.regexp_extract("_t", title, 2).alias("y")))
    )
    return rows.withColumn("f", found).where("f is not null and f.c <> ''").select("doc_id", "pos", F.col("f.c").alias("raw_country"), F.when(F.col("f.y") != "", F.col("f.y").cast("int")).alias("year"))


def resolve_document_entity(documents: DataFrame, candidates: DataFrame, names: DataFrame) -> DataFrame:
    """SEG3: ``doc_id, code, year, status``: ``resolved``, ``undeterminable``, ``ambiguous``, or ``mismatch`` with ``documents.explicit_code``."""
    dim = names.select(X.entity_token(F.col("alias")).alias("_a"), "code").distinct()
    known = candidates.withColumn("_a", X.entity_token(F.col("raw_country"))).join(small(dim), "_a")
    per = known.groupBy("doc_id").agg(F.countDistinct("code").alias("n"), F.min_by("code", "pos").alias("found"), F.min(F.when(F.col("year").isNotNull(), F.struct("pos", "year"))).getField("year").alias("year"))
    rows = documents.join(per, "doc_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "undeterminable").when(F.col("n") > 1, "ambiguous").when(F.col("explicit_code").isNotNull() & (F.upper("explicit_code") != F.col("found")), "mismatch").otherwise("resolved")
    return rows.select("doc_id", F.when(F.col("n") == 1, F.col("found")).alias("code"), "year", status.alias("status"))


def _is_overview(label: Column, names: Column) -> Column:
    low = F.lower(label)
    with_name = F.exists(
        names,
        lambda n: low.isin(*V.OVERVIEW_LABELS) | (low == F.concat(F.lit("employment law overview "), F.lower(n))) | (low == F.concat(F.lit("employment law overview in "), F.lower(n))) | (low == F.concat(F.lit("labour and employment law overview "), F.lower(n))) | (low == F.concat(F.lit("labour and employment law overview in "), F.lower(n))) | (low == F.concat(F.lit("labour and employment law in "), F.lower(n))),
    )
    return low.isin(*V.OVERVIEW_LABELS) | with_name


def classify_blocks(blocks: DataFrame, topics: DataFrame, subsections: DataFrame, overrides: DataFrame) -> DataFrame:
    """SEG4 and SEG5: ``blocks(doc_id, pos, text, heading_level, numbered, bold, unbolded, names)`` with ``role, section, topic, subsection``.

    Roles in order of precedence: ``override``, ``topic``, ``overview``, ``generic_main`` (another first-level
    heading), ``subsection``, ``content``. Subsections depend on the topic that is carried forward, so topics are
    filled first. A new section ends the subsection; an override lasts until the next heading and then the
    enclosing section is restored. ``names`` are the names of the document's entity.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("_label", X.without_entity(X.topic_label(F.col("text")), F.coalesce("names", F.array().cast("array<string>"))))
    rows = join_topic(rows, F.col("_label"), topics, "_topic")
    over = overrides.select(F.col("label").alias("_ol"), F.col("topic").alias("_over"))
    rows = rows.withColumn("_ol", X.subsection_label(F.col("text"))).join(small(over), "_ol", "left").drop("_ol")
    h1, heading = F.col("heading_level") == 1, F.col("heading_level").isNotNull()
    marked = F.coalesce(h1, F.lit(False)) | F.coalesce("numbered", F.lit(False)) | F.col("text").rlike(r"^\s*(?:[|¦=]+\s*)?(?:\d{1,2}|[IVX]{1,6})\s*[.)]") | F.coalesce("bold", F.lit(False))
    over_view = (F.coalesce(h1, F.lit(False)) | F.coalesce("bold", F.lit(False))) & _is_overview(X.topic_label(F.col("text")), F.coalesce("names", F.array().cast("array<string>")))
    role = F.when(F.col("_over").isNotNull() & (heading | F.coalesce("bold", F.lit(False))), "override").when(F.col("_topic").isNotNull() & marked, "topic").when(over_view, "overview").when(F.coalesce(h1, F.lit(False)), "generic_main")
    rows = rows.withColumn("_main", role)
    new_section = F.col("_main").isin("topic", "overview", "generic_main")
    section = F.when(new_section, F.struct("pos", F.col("_label").alias("section"), F.when(F.col("_main") == "topic", F.col("_topic")).alias("topic"), (F.col("_main") != "generic_main").alias("strict")))
    rows = rows.withColumn("_section", F.last(section, ignorenulls=True).over(w)).withColumn("_parent", F.col("_section.topic"))
    rows = join_subsection(rows, "_parent", F.col("text"), subsections, "_known")
    strict = F.col("_known").isNotNull() & (F.col("heading_level").isin(2, 4) | F.coalesce("bold", F.lit(False))) & ~F.coalesce("unbolded", F.lit(False))
    generic = ~F.coalesce(F.col("_section.strict"), F.lit(True)) & (F.col("heading_level") == 2) & ~F.coalesce("numbered", F.lit(False))
    rows = rows.withColumn("role", F.when(F.col("_main").isNotNull(), F.col("_main")).when(F.coalesce(strict, F.lit(False)) | F.coalesce(generic, F.lit(False)), "subsection").otherwise("content"))
    # the last heading of any kind tells the subsection and whether an override holds
    last = F.when(F.col("role") != "content", F.struct("role", F.when(F.col("role") == "subsection", F.coalesce("_known", X.fold_label(F.col("text")))).alias("sub"), F.col("_over").alias("over"), X.fold_label(F.col("text")).alias("text")))
    rows = rows.withColumn("_last", F.last(last, ignorenulls=True).over(w))
    held = F.col("_last.role") == "override"
    return rows.withColumns(
        {
            "section": F.when(held, F.col("_last.over")).otherwise(F.col("_section.section")),
            "topic": F.when(held, F.col("_last.over")).otherwise(F.col("_section.topic")),
            "subsection": F.when(held, F.col("_last.text")).otherwise(F.col("_last.sub")),
            "island": F.sum((F.col("role") != "content").cast("int")).over(w),
        }
    ).drop("_label", "_topic", "_over", "_main", "_section", "_parent", "_known", "_last")


def carry_headings(blocks: DataFrame, doc: str = "doc_id", level: str = "heading_level") -> DataFrame:
    """SEG5 without dimensions: the last first-level heading as ``section``, the last deeper one since as ``subsection``, and the ``island`` they open."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("island", F.sum(F.when(F.col(level).isNotNull(), 1).otherwise(0)).over(w))
    rows = rows.withColumn("_n", F.sum(F.when(F.col(level) == 1, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(doc, "_n").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"section": F.last(F.when(F.col(level) == 1, F.col("text")), ignorenulls=True).over(w), "subsection": F.last(F.when(F.col(level) > 1, F.col("text")), ignorenulls=True).over(inner)}).drop("_n")


def build_sections(blocks: DataFrame, doc: str = "doc_id", keys: tuple[str, ...] = ("section", "topic", "subsection")) -> DataFrame:
    """SEG6: the content of each island joined by blank lines; islands without a letter or digit are dropped."""
    body = blocks.where("role = 'content'").groupBy(doc, "island", *keys).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    joined = body.select(doc, "island", *keys, F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("content"))
    return joined.where(X.has_alphanumeric(F.col("content")))


_PACK = "struct<done:array<string>,open:string>"


def _packed(parts: Column, glue: str, limit: int) -> Column:
    """Greedy packing of parts that each fit into pieces of at most ``limit`` characters, separators counted."""

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + len(glue) + F.length(p) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(glue), p).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p.alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")).cast(_PACK)
    return X.let(F.aggregate(parts, start, step), lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def _slices(word: Column, limit: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(word) - 1) / limit).cast("int")), lambda i: F.substring(word, i * limit + 1, F.lit(limit)))


def _level(parts: Column, glue: str, limit: int, finer) -> Column:
    """Packs runs of parts that fit; a part that doesn't ends the run and is split by ``finer``, its pieces stay apart."""

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(p) <= limit
        together = acc["open"].isNotNull() & (F.length(acc["open"]) + len(glue) + F.length(p) <= limit)
        flushed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return (
            F.when(fits & together, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(glue), p).alias("open")))
            .when(fits, F.struct(flushed.alias("done"), p.alias("open")))
            .otherwise(F.struct(F.concat(flushed, finer(p)).alias("done"), F.lit(None).cast("string").alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")).cast(_PACK)
    return X.let(F.aggregate(parts, start, step), lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def split_pieces(content: Column, limit: int = MAX_CHARS) -> Column:
    """SEG7: ``content`` as pieces of at most ``limit`` characters: by paragraphs, else sentences, else words, else hard slices."""
    if limit < 100:
        raise ValueError("a piece has to be allowed 100 characters at least")
    def full(arr: Column) -> Column:
        return F.filter(F.transform(arr, lambda p: F.trim(p)), lambda p: p != "")

    words = lambda s: _level(full(F.split(s, r"\s+")), " ", limit, lambda w: _slices(w, limit))
    sentences = lambda p: _level(full(F.split(p, r"(?<=[.!?])\s+(?=[A-Z0-9À-ÖØ-Þ\"'(])")), " ", limit, words)
    split = _level(full(F.split(content, r"\n\s*\n+")), "\n\n", limit, sentences)
    return F.when(F.length(content) <= limit, F.array(content)).otherwise(split)


def split_sections(sections: DataFrame, limit: int = MAX_CHARS, content: str = "content") -> DataFrame:
    """SEG7 over a table: one row for each piece, ``piece`` counting from 0."""
    others = [c for c in sections.columns if c != content]
    return sections.select(*others, F.posexplode(split_pieces(F.col(content), limit)).alias("piece", content))


def enrich_chunks(pieces: DataFrame, meta: DataFrame, topics: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """SEG8: pieces ``(doc_id, island, piece, section, topic, subsection, content)`` and ``meta`` -> chunks, and rejects with an unknown topic.

    A null topic is the overview. Ids follow document, type, topic, section, subsection and the running count of
    that path; blank pieces are dropped before they are counted.
    """
    known = topics.select(F.col("topic").alias("_t")).distinct()
    rows = pieces.where(F.trim("content") != "").join(small(known), F.col("topic") == F.col("_t"), "left").join(meta, "doc_id")
    bad = rows.where("topic is not null and _t is null").drop("_t")
    rows = rows.where("topic is null or _t is not null").drop("_t")
    kind = F.when(F.col("topic").isNull(), "overview").otherwise("comparator")
    rows = rows.withColumns({"document_type": kind, "document_id": corpus.document_id(F.col("country_code"), F.col("language"), family)})
    path = Window.partitionBy("document_id", "document_type", "topic", F.lower("section"), F.lower("subsection")).orderBy("doc_id", "island", "piece")
    rows = rows.withColumn("occurrence", F.row_number().over(path))
    out = rows.withColumns({"chunk_id": corpus.chunk_id(F.col("document_id"), F.col("document_type"), F.col("topic"), F.col("section"), F.col("subsection"), F.col("occurrence")), "content_hash": F.sha2("content", 256), "legal_topic": F.col("topic")})
    return out.select(*corpus.CHUNK_COLUMNS), bad


def validate_metadata(meta: DataFrame) -> DataFrame:
    """SEG9: ``(doc_id, violation)`` of document metadata."""
    blank = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c}_blank")) for c in ("country", "country_code", "language", "source_filename")]
    rules = [*blank, F.when(~F.coalesce(F.col("country_code").rlike("^[A-Za-z]{2}$"), F.lit(True)), F.lit("country_code_form")), F.when((F.col("reference_year") < 1900) | (F.col("reference_year") > 2100), F.lit("year_range"))]
    return meta.select("doc_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def drop_repeated_blocks(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SEG10: without blocks that equal the non-empty block right before them."""
    before = F.lag("text").over(Window.partitionBy(doc).orderBy("pos"))
    return blocks.withColumn("_before", before).where(~F.col("text").eqNullSafe(F.col("_before"))).drop("_before")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()./-]{6,}[0-9]"
WEBSITE = r"(?i)(?:https?://|www\.)[^\s]+"
PERSON_MARK = r"(?i)\b(?:contact|partner|lawyer|attorney)\b"


def extract_contacts(blocks: DataFrame) -> DataFrame:
    """SEG11: ``blocks(doc_id, block_idx, lines, country)`` -> ``doc_id, pair, member_firm, contact_person, email, phone, address, website``.

    A person block has a marker line: the next line that is no email is the name. A firm block has an email or a
    phone; a website alone is not enough. Firms and persons are paired by their order in the document, unmatched
    sides stay, repeated (firm, person, email) go.
    """
    # words that ran together at a line's joints are parted, but not inside addresses of the net
    parted = F.transform("lines", lambda x: X.squash_ws(F.when(x.rlike(EMAIL) | x.rlike(WEBSITE), x).otherwise(X.repair_joins(x))))
    lines = F.filter(parted, lambda x: x != "")
    rows = blocks.withColumn("l", F.filter(lines, lambda x: ~F.coalesce(F.lower(x) == F.lower("country"), F.lit(False))))
    text = F.array_join("l", "\n")
    rows = rows.withColumns({"emails": F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))), "phone": F.regexp_extract(text, PHONE, 0), "website": F.regexp_extract(text, WEBSITE, 0), "person": F.exists("l", lambda x: x.rlike(PERSON_MARK + r"\s*:?\s*$"))})
    name = F.get(F.filter("l", lambda x: ~x.rlike(EMAIL) & ~x.rlike(PERSON_MARK + r"\s*:?\s*$")), F.lit(0))
    persons = rows.where("person").select("doc_id", "block_idx", name.alias("contact_person"), F.array_join("emails", ", ").alias("p_email"))
    address = F.array_join(F.filter(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda x: ~x.rlike(EMAIL) & ~x.rlike(r"^\s*(?i)(?:tel|phone|t)?[.: ]*" + PHONE + r"\s*$") & ~x.rlike(WEBSITE)), ", ")
    firms = rows.where(~F.col("person") & ((F.size("emails") > 0) | (F.col("phone") != ""))).select("doc_id", "block_idx", F.get("l", F.lit(0)).alias("member_firm"), F.array_join("emails", ", ").alias("f_email"), "phone", address.alias("address"), "website")
    first = Window.partitionBy("doc_id").orderBy("block_idx")
    persons = persons.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "contact_person", "p_email").orderBy("block_idx"))).where("n = 1").withColumn("pair", F.row_number().over(first)).drop("n", "block_idx")
    firms = firms.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "member_firm", "f_email", "phone").orderBy("block_idx"))).where("n = 1").withColumn("pair", F.row_number().over(first)).drop("n", "block_idx")
    both = firms.join(persons, ["doc_id", "pair"], "full_outer")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    email = F.coalesce(blank("p_email"), blank("f_email"))
    out = both.select("doc_id", "pair", "member_firm", "contact_person", email.alias("email"), blank("phone").alias("phone"), blank("address").alias("address"), blank("website").alias("website"))
    keep = F.row_number().over(Window.partitionBy("doc_id", "member_firm", "contact_person", "email").orderBy("pair"))
    return out.withColumn("n", keep).where("n = 1").drop("n")


def contact_text(contacts: DataFrame) -> DataFrame:
    """SEG12: ``doc_id, content``: ``Label: value`` lines of each contact, entries separated by a blank line; subsection ``Contact``."""
    labels = (("Member firm", "member_firm"), ("Contact person", "contact_person"), ("Email", "email"), ("Phone", "phone"), ("Address", "address"), ("Website", "website"))
    entry = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.col(c)) for name, c in labels])
    rows = contacts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pair", entry.alias("e")))).alias("e"))
    return rows.select("doc_id", F.lit("Contact").alias("subsection"), F.array_join(F.transform("e", lambda x: x["e"]), "\n\n").alias("content"))


def clean_contact_text(content: Column) -> Column:
    """SEG13: the phone number removed from the end of the address line if it repeats there."""
    phone = F.regexp_extract(content, r"(?m)^Phone: (.+)$", 1)
    address = F.regexp_extract(content, r"(?m)^Address: (.+)$", 1)
    shorter = F.regexp_replace(F.substring(address, F.lit(1), F.length(address) - F.length(phone)), r"[\s,;]+$", "")
    return F.when((phone != "") & F.endswith(address, phone), F.replace(content, F.concat(F.lit("Address: "), address), F.concat(F.lit("Address: "), shorter))).otherwise(content)
