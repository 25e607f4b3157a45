"""Ranking many queries over a chunk table: postings, BM25 over several fields, filters, pages and totals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from lectern.functions import text as X
from lectern.functions import values as V
from lectern.operators.ranking import Filters, Shard, counted, ranked, unpacked
from lectern.sources.store import cut

K1, B = 1.2, 0.75
BOOSTS = {"content": 5.0, "subsection": 3.0, "section": 2.0}
TIE = 0.2
#: Rows up to which the terms of all queries are broadcast to the corpus scan.
TERM_ROWS = 1_000_000
#: Terms up to which every Python worker holds those of all queries.
NUMBERED_TERMS = 100_000


@dataclass(frozen=True)
class Index:
    """``postings(field, term, chunk_id, dl, tf)``, ``fields(field, n, avgdl)``, ``terms(field, term, df)``.

    Where the terms of interest were given and are few, ``rows(field, chunk_id, dl, terms, tfs)`` has the postings of a text
    as arrays in its row, its terms by their numbers in ``numbers(number, term)``.
    """

    postings: DataFrame
    fields: DataFrame
    terms: DataFrame
    rows: DataFrame | None = None
    numbers: DataFrame | None = None


def _bounded(df: DataFrame, rows: int = TERM_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _counted(words: Column) -> Column:
    """``array<struct<term, tf>>``: each word with how often it occurs, from the places where a word begins among the sorted ones."""

    def of(s: Column) -> Column:
        n = F.size(s)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(every, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return X.let(begins, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).cast("long").alias("tf"))))

    return X.let(F.sort_array(words), of)


def build_postings(chunks: DataFrame, fields: list[str], only_terms: DataFrame | None = None, keep: tuple[str, ...] = ()) -> Index:
    """RNK1. With ``only_terms(term)`` postings of other terms are dropped at the scan; field statistics cover the whole corpus either way.

    Words are counted in the row of their text, so neither texts nor words are shuffled. ``keep`` names columns of
    ``chunks`` that postings carry along.
    """
    if only_terms is not None:
        some = [r.term for r in only_terms.select("term").where("term is not null").distinct().limit(NUMBERED_TERMS + 1).collect()]
        if len(some) <= NUMBERED_TERMS:
            return _packed(chunks, fields, some, keep)
    arrays = F.array(*[F.struct(F.lit(f).alias("field"), X.search_tokens(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in fields])
    own = chunks.select("chunk_id", *keep, F.explode(arrays).alias("f"))
    per = own.select("chunk_id", *keep, "f.field", F.size("f.words").alias("dl"), _counted(F.col("f.words")).alias("counts")).where("dl > 0")
    # written once: field statistics, document frequencies and every query over this index read it back
    per = cut(per, "counts")
    stats = cut(per.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "field-stats")
    postings = per.select("field", "chunk_id", *keep, "dl", F.explode("counts").alias("c")).select("field", "c.term", "chunk_id", *keep, "dl", "c.tf")
    if only_terms is not None:
        postings = cut(postings.join(_bounded(only_terms.select("term").distinct()), "term", "left_semi").select("field", "term", "chunk_id", *keep, "dl", "tf"), "postings")
    terms = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(postings, stats, terms)


def _packed(chunks: DataFrame, fields: list[str], some: list[str], keep: tuple[str, ...]) -> Index:
    """The index of ``some`` terms: a text's words are counted in one pass, and a row holds all its postings."""
    spark = chunks.sparkSession
    texts = F.array(*[F.struct(F.lit(f).alias("field"), X.spaced_tokens(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in fields])
    own = chunks.select("chunk_id", *keep, F.explode(texts).alias("f")).select("chunk_id", *keep, "f.field", "f.words")
    held = spark.sparkContext.broadcast({t: i for i, t in enumerate(some)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted(batches, held.value)

    schema = own.drop("words").schema.add("dl", LongType()).add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    # written once: field statistics, document frequencies and every query over this index read it back
    rows = cut(own.mapInArrow(run, schema), "counts")
    numbers = spark.createDataFrame(list(enumerate(some)), "number int, term string")
    stats = cut(rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "field-stats")
    df = cut(rows.select("field", F.explode("terms").alias("number")).groupBy("field", "number").agg(F.count("*").alias("df")), "frequencies")
    each = rows.select("field", "chunk_id", *keep, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("c")).join(F.broadcast(numbers), F.col("c.terms") == F.col("number"))
    postings = each.select("field", "term", "chunk_id", *keep, "dl", F.col("c.tfs").cast("long").alias("tf"))
    return Index(postings, stats, df.join(F.broadcast(numbers), "number").select("field", "term", "df"), rows, numbers)


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """``query_id, term, qtf, n_terms``; a repeated term counts each time."""
    words = queries.select("query_id", X.search_tokens(F.col(text)).alias("w")).withColumn("n_terms", F.size("w"))
    return words.select("query_id", "n_terms", F.explode("w").alias("term")).groupBy("query_id", "term", "n_terms").agg(F.count("*").alias("qtf"))


def required_terms(n_terms: Column, filtered: Column) -> Column:
    """FLT4: one term if a list filter was given, else 70 % of them, at least one."""
    return F.when(filtered, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(0.7 * n_terms).cast("int")))


#: Chunks in a shard of the postings, about, and queries that meet a shard at a time, where only the best hits are asked for; an eighth where all are.
SHARD_CHUNKS = 16_384
SHARD_QUERIES = 4096


def _weights(queries: DataFrame, index: Index, boosts: dict[str, float]) -> DataFrame:
    """``query_id, field, term, qtf, weight, need``: what a query's terms count in each field."""
    terms = query_terms(queries)
    filtered = F.coalesce("filtered", F.lit(False)) if "filtered" in queries.columns else F.lit(False)
    # fields are few; terms and queries are bounded by the query table
    stats = index.terms.join(_bounded(terms.select("term").distinct()), "term", "left_semi").join(F.broadcast(index.fields), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost = F.lit(0.0)
    for field, b in boosts.items():
        boost = F.when(F.col("field") == field, b).otherwise(boost)
    asked = terms.join(_bounded(queries.select("query_id", filtered.alias("_filtered"))), "query_id").join(stats.select("field", "term", (idf * boost).alias("w")), "term")
    return asked.select("query_id", "field", "term", F.col("qtf").cast("long").alias("qtf"), (F.col("qtf") * F.col("w")).alias("weight"), required_terms(F.col("n_terms"), F.col("_filtered")).cast("long").alias("need"))


def _in_shards(queries: DataFrame, index: Index, boosts: dict[str, float], k: int | None, digits: int, kinds_of: DataFrame | None = None, filtered: bool = False) -> DataFrame:
    """Shards of chunks meet blocks of queries, each pair in one task; see ``ranking.Shard``.

    With ``kinds_of(query_id, kind)`` the chunks of a shard are of one kind, and a query meets shards of its kinds only.
    If ``filtered``, postings carry ``ATTRIBUTES``, and a query counts only chunks that pass its filters.
    """
    spark = queries.sparkSession
    asked = cut(_weights(queries, index, boosts), "asked")
    chunks = index.fields.agg(F.max("n")).first()[0] or 0
    # small tables are dealt to all cores; all hits of a block of queries in a shard are one table, so both are small then
    fewest = min(spark.sparkContext.defaultParallelism, -(-chunks // 1024))
    shards = max(1, fewest, -(-chunks // (SHARD_CHUNKS if k is not None else SHARD_CHUNKS // 8)))
    blocks = max(1, -(-queries.count() // (SHARD_QUERIES if k is not None else SHARD_QUERIES // 8)))
    shard, every = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    if index.rows is not None:
        asked = asked.withColumnRenamed("term", "_t").join(F.broadcast(index.numbers), F.col("_t") == F.col("term")).drop("_t", "term").withColumnRenamed("number", "term")
        rows, values = index.rows.where(F.size("terms") > 0).join(F.broadcast(index.fields.select("field", "avgdl")), "field"), ["field", "chunk_id", "dl", "avgdl", "terms", "tfs"]
    else:
        impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        rows = index.postings.join(_bounded(asked.select("field", "term").distinct()), ["field", "term"], "left_semi").join(F.broadcast(index.fields), "field").withColumn("impact", impact)
        values = ["field", "term", "chunk_id", "dl", "impact"]
    packed = index.rows is not None
    if kinds_of is not None:
        return _by_kind(rows.select(shard.alias("shard"), "kind", *values), asked, kinds_of, shards, packed, k, digits)
    attributes = ATTRIBUTES if filtered else ()
    if filtered:
        asked = asked.join(_bounded(queries.select("query_id", *_wanted(queries))), "query_id")
    left = rows.select(shard.alias("shard"), every.alias("block"), *values, *attributes)
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "field", "term", "qtf", "weight", "need", *attributes)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.postings.schema['chunk_id'].dataType.simpleString()}, score double"

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        shard = Shard(unpacked(rows, K1, B) if packed else rows)
        return ranked(shard, asked, k, TIE, 10.0**-digits, Filters(shard, rows, asked, attributes, ("subsection", "Contact")) if filtered else None)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, kinds)
    return found.select("query_id", "chunk_id", F.round("score", digits).alias("score"))


def _by_kind(left: DataFrame, asked: DataFrame, kinds_of: DataFrame, shards: int, packed: bool, k: int | None, digits: int) -> DataFrame:
    """``query_id, kind, chunk_id, score``: the best ``k`` of each query among the chunks of each of its kinds."""
    places = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    right = asked.join(_bounded(kinds_of.select("query_id", "kind").distinct()), "query_id").select(places, "kind", "query_id", "field", "term", "qtf", "weight", "need")
    left = left.join(_bounded(kinds_of.select("kind").distinct()), "kind", "left_semi").select(*left.columns)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, kind string, chunk_id {left.schema['chunk_id'].dataType.simpleString()}, score double"

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"query_id": asked.column("query_id").slice(0, 0), "kind": pa.array([], pa.string()), "chunk_id": rows.column("chunk_id").slice(0, 0), "score": pa.array([], pa.float64())})
        found = ranked(Shard(unpacked(rows, K1, B) if packed else rows), asked, k, TIE, 10.0**-digits)
        kind = pa.array([asked.column("kind")[0].as_py()] * found.num_rows, pa.string())
        return pa.table({"query_id": found.column("query_id"), "kind": kind, "chunk_id": found.column("chunk_id"), "score": found.column("score")})

    found = left.groupBy("shard", "kind").cogroup(right.groupBy("shard", "kind")).applyInArrow(run, schema)
    return found.select("query_id", "kind", "chunk_id", F.round("score", digits).alias("score"))


def bm25_search(queries: DataFrame, index: Index, boosts: dict[str, float], digits: int = 4) -> DataFrame:
    """RNK2: ``queries(query_id, query, filtered)`` -> ``query_id, chunk_id, score``: the best field plus ``TIE`` times the others.

    A field counts only if it holds the required number of query terms. Statistics are those of the whole corpus, so
    filters may be applied to the hits.
    """
    return _in_shards(queries, index, boosts, None, digits)


def bm25_top(queries: DataFrame, index: Index, boosts: dict[str, float], limit: int = 10, offset: int = 0, digits: int = 4) -> DataFrame:
    """RNK2 and RNK3: a page of each query's hits, as ``top_k`` of ``bm25_search`` gives it, without scoring all of them.

    A shard of chunks takes the terms with the largest contributions first, drops chunks that can't reach the last place
    of the page any more, and gives its best hits only.
    """
    return top_k(_in_shards(queries, index, boosts, limit + offset, digits), limit, offset)


def bm25_top_filtered(queries: DataFrame, index: Index, boosts: dict[str, float], limit: int = 10, digits: int = 4) -> DataFrame:
    """The first ``limit`` hits of each query that pass its filters: ``top_k`` of ``filter_hits`` of ``bm25_search``, without making the other hits.

    ``index`` was built with ``keep=ATTRIBUTES``; statistics are those of the whole corpus.
    """
    return top_k(_in_shards(queries, index, boosts, limit, digits, filtered=True), limit)


def bm25_top_kinds(queries: DataFrame, index: Index, boosts: dict[str, float], kinds_of: DataFrame, limit: int = 10, digits: int = 4) -> DataFrame:
    """``query_id, kind, chunk_id, score, rank``: the first ``limit`` of ``bm25_search`` within each kind of chunks that a query asks for.

    ``index`` was built with ``keep=("kind",)``; ``kinds_of(query_id, kind)``. Equals ranking all hits by kind, without making them.
    """
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "chunk_id")
    rows = _in_shards(queries, index, boosts, limit, digits, kinds_of)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_k(hits: DataFrame, limit: Column | int = 10, offset: Column | int = 0) -> DataFrame:
    """RNK3: a page of each query by score, ties by chunk; ``rank`` starts at 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    lim, off = (c if isinstance(c, Column) else F.lit(c) for c in (limit, offset))
    rows = hits.withColumn("rank", F.row_number().over(w))
    if isinstance(limit, int) and isinstance(offset, int):
        rows = rows.where(F.col("rank") <= limit + offset)  # a constant bound lets the window keep only so many rows
    return rows.where((F.col("rank") > off) & (F.col("rank") <= off + lim))


def search_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count("*").alias("total_hits"))


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT3: accepted queries (normalised) and rejects with a reason."""
    q = X.squash_ws(F.coalesce("query", F.lit("")))
    reason = (
        F.when(F.length(q) < 2, "query_too_short").when(F.length("query") > 1000, "query_too_long").when((F.col("limit") < 1) | (F.col("limit") > 50), "limit_range").when((F.col("offset") < 0) | (F.col("offset") > 1000), "offset_range")
    )
    rows = queries.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason").withColumn("query", q), rows.where("reason is not null")


def filters_given(queries: DataFrame) -> Column:
    """FLT4: any list filter was given, even one that is blank after cleaning; language and year don't count."""
    return F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("country_codes", "legal_topics", "subsections")]) > 0


_KEYS = ("_code", "_topic", "_sub", "_lang", "_year")
#: What a chunk has for each of the keys.
ATTRIBUTES = ("country_code", "legal_topic", "subsection", "language", "reference_year")


def _wanted(queries: DataFrame) -> list[Column]:
    """The values that a query's filters let pass, an array for each of ``ATTRIBUTES``; empty where it doesn't filter."""
    none = F.array().cast("array<string>")
    return [
        X.dedupe_list(F.coalesce("country_codes", none), lambda v: F.upper(X.squash_ws(v))).alias("country_code"),
        X.dedupe_list(F.coalesce("legal_topics", none)).alias("legal_topic"),
        X.dedupe_list(F.coalesce("subsections", none)).alias("subsection"),
        F.array_compact(F.array(F.lower(F.trim("language")))).alias("language"),
        F.array_compact(F.array("reference_year")).alias("reference_year"),
    ]


def _asked(queries: DataFrame) -> DataFrame:
    """The filters of each query as keys: a row for each combination of its list values, null where it doesn't filter; ``_mask`` tells which keys are set."""
    none = F.array().cast("array<string>")
    rows = queries.select(
        "query_id",
        X.dedupe_list(F.coalesce("country_codes", none), lambda v: F.upper(X.squash_ws(v))).alias("_codes"),
        X.dedupe_list(F.coalesce("legal_topics", none)).alias("_topics"),
        X.dedupe_list(F.coalesce("subsections", none)).alias("_subs"),
        F.lower(F.trim("language")).alias("_lang"),
        F.col("reference_year").alias("_year"),
    )
    for many, one in (("_codes", "_code"), ("_topics", "_topic"), ("_subs", "_sub")):
        rows = rows.withColumn(one, F.explode_outer(many)).drop(many)
    mask = F.lit(0)
    for i, k in enumerate(_KEYS):
        mask = mask + F.when(F.col(k).isNotNull(), 1 << i).otherwise(0)
    return rows.withColumn("_mask", mask)


def _allowed(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with a chunk's attributes, for each query whose filters they pass: an equi-join on the keys that the query sets. ``on`` are further keys."""
    # five filters make 32 kinds of query at most
    kinds = sorted(r[0] for r in asked.select("_mask").distinct().collect())
    masks = F.explode(F.array(*[F.lit(m) for m in kinds])) if kinds else F.lit(-1)
    own = (F.col("country_code"), F.col("legal_topic"), F.col("subsection"), F.col("language"), F.col("reference_year"))
    each = rows.withColumn("_m", masks)
    # contacts come only to those who ask for that subsection
    each = each.where(~F.col("subsection").eqNullSafe(F.lit("Contact")) | (F.col("_m").bitwiseAND(4) != 0))
    each = each.withColumns({f"{k}_c": F.when(F.col("_m").bitwiseAND(1 << i) != 0, c) for i, (k, c) in enumerate(zip(_KEYS, own, strict=True))})
    same = F.col("_m") == F.col("_mask")
    for k in _KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_c"))
    for c in on:
        same = same & (each[c] == asked[c])
    return each.join(_bounded(asked), same)


def filter_chunks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """FLT1 and FLT2: ``(query_id, chunk_id)`` pairs that pass all filters of a query.

    List filters restrict by membership, an empty or null list doesn't; language and year by equality. ``Contact``
    chunks pass only if the query asks for that subsection.
    """
    cols = chunks.select("chunk_id", "country_code", "legal_topic", "subsection", "language", "reference_year")
    return _allowed(cols, _asked(queries), []).select("query_id", "chunk_id")


def filter_counts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, n, first``: how many chunks pass and the smallest of them; chunks are counted by their attributes first."""
    attributes = ["country_code", "legal_topic", "subsection", "language", "reference_year"]
    kinds = chunks.groupBy(*attributes).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))
    return _allowed(kinds, _asked(queries), []).groupBy("query_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def filter_hits(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """FLT1 and FLT2 on ``hits(query_id, chunk_id, ...)``: those that pass the filters of their query."""
    cols = chunks.select("chunk_id", "country_code", "legal_topic", "subsection", "language", "reference_year")
    asked = _asked(queries)
    return _allowed(hits.join(cols, "chunk_id"), asked, ["query_id"]).select(*[hits[c] for c in hits.columns])


def filter_conflict(explicit: Column, action: Column) -> Column:
    """FLT5: an action names a code outside a non-empty explicit filter."""
    return (F.size(explicit) > 0) & (F.size(F.array_except(action, explicit)) > 0)


def contact_lookup(queries: DataFrame, chunks: DataFrame, limit: int = 20) -> DataFrame:
    """RNK4: contact chunks of the codes of each query, in order of chunk, at most ``limit``; no codes, no rows."""
    codes = queries.select("query_id", F.explode("country_codes").alias("country_code"))
    rows = chunks.where("subsection = 'Contact'").join(_bounded(codes.distinct()), "country_code")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("rank") <= limit)


def retrieval_query(question: Column, names: Column, concepts: Column) -> Column:
    """RNK5: the question without entity names (longest first, whole words) and stop words, then all concept terms; the question itself if under two characters are left.

    ``names`` is an array of the requested entities' names, ``concepts`` an array of terms.
    """
    longest = F.array_sort(names, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    quoted = F.transform(longest, lambda n: F.regexp_replace(n, r"([^\p{L}\p{N} ])", r"\\$1"))
    bare = F.when(F.size(names) > 0, F.regexp_replace(question, F.concat(F.lit(r"(?iU)(?<!\w)(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\w)")), F.lit(" "))).otherwise(question)
    words = F.filter(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9'-]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*V.QUERY_STOP_WORDS))
    out = F.array_join(F.concat(words, F.coalesce(concepts, F.array().cast("array<string>"))), " ")
    return F.when(F.length(F.trim(out)) < 2, question).otherwise(F.trim(out))


def candidate_limits(max_sources: Column, n_countries: Column, multiple: Column | int = 1, rerank: Column | bool = False) -> tuple[Column, Column]:
    """RNK6: ``(share, pool)`` for each country."""
    share = F.greatest(F.ceil(max_sources / F.greatest(n_countries, F.lit(1))).cast("int"), F.lit(4))
    m = multiple if isinstance(multiple, Column) else F.lit(multiple)
    on = rerank if isinstance(rerank, Column) else F.lit(rerank)
    return share, F.when(on, F.least(share * F.greatest(F.lit(1), m), F.lit(20))).otherwise(share)


def check_source_budget(max_sources: Column, n_countries: Column) -> Column:
    """RNK7: a request of several countries needs a source for each."""
    return (n_countries >= 2) & (max_sources < n_countries)
