"""Ranking, filters, facets and selection over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import facets, search, select
from lectern.plans import inputs as I
from lectern.sources.store import bounded, cut

CONTENT = {"content": 5.0}
WITH = "WITH "

# BM25 of one or several fields as SQL; {fields} is a union of (chunk_id, field, words, boost), {msm} the required terms.
_BM25 = """qt AS (SELECT query_id, term, count(*) AS qtf, n_terms FROM (SELECT query_id, unnest(words) AS term, len(words) AS n_terms FROM queries) GROUP BY query_id, term, n_terms),
 fw AS (SELECT chunk_id, field, boost, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM ({fields})),
 fields AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM fw WHERE len(w) > 0 GROUP BY field),
 postings AS (SELECT field, boost, term, chunk_id, dl, count(*) AS tf FROM (SELECT field, boost, chunk_id, len(w) AS dl, unnest(w) AS term FROM fw) GROUP BY field, boost, term, chunk_id, dl),
 terms AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
 perfield AS (
  SELECT query_id, chunk_id, field, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * max(boost) AS s, sum(qtf) AS matched, n_terms
  FROM postings JOIN qt USING (term) JOIN terms USING (field, term) JOIN fields USING (field) GROUP BY query_id, chunk_id, field, n_terms),
 hits AS (SELECT query_id, chunk_id, round(max(s) + 0.2 * (sum(s) - max(s)), 4) AS score FROM perfield WHERE matched >= {msm} GROUP BY query_id, chunk_id)"""
_ONE = "SELECT chunk_id, 'content' AS field, 5.0 AS boost, content AS body FROM chunks"
_THREE = _ONE + " UNION ALL SELECT chunk_id, 'subsection', 3.0, coalesce(subsection, '') FROM chunks UNION ALL SELECT chunk_id, 'section', 2.0, section FROM chunks"
_SEVENTY = "greatest(1, floor(0.7 * n_terms))"


def bm25(fields: str, msm: str) -> str:
    return WITH + I.CHUNKS_SQL + ", " + I.QUERIES_SQL + ", " + _BM25.format(fields=fields, msm=msm)


def _index(chunks: DataFrame, queries: DataFrame, fields: list[str], kind: str | None = None) -> search.Index:
    rows = chunks if kind is None else chunks.withColumn("kind", F.col(kind))
    return search.build_postings(rows, fields, search.query_terms(queries).select("term"), () if kind is None else ("kind",))


def _hits(spark: SparkSession, d: str, boosts: dict[str, float], filtered: bool) -> DataFrame:
    chunks, queries = I.chunks(spark, d), I.queries(spark, d).withColumn("filtered", F.lit(filtered))
    return search.bm25_search(queries, _index(chunks, queries, list(boosts)), boosts)


def _top(spark: SparkSession, d: str, boosts: dict[str, float], filtered: bool, limit: int, offset: int = 0) -> DataFrame:
    chunks, queries = I.chunks(spark, d), I.queries(spark, d).withColumn("filtered", F.lit(filtered))
    return search.bm25_top(queries, _index(chunks, queries, list(boosts)), boosts, limit, offset)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, CONTENT, True, 10)


def bm25_multifield(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, search.BOOSTS, True, 10, 5)


def bm25_msm70(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, search.BOOSTS, False, 10)


def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return search.search_totals(_hits(spark, d, CONTENT, False))


def _filters(queries: DataFrame) -> DataFrame:
    q = F.col("query_id")
    none = F.array().cast("array<string>")
    return queries.withColumns(
        {
            "country_codes": F.when(q % 3 == 0, F.array(F.lit("src0"), F.lit("SRC1 "), F.lit("SRC0"))).otherwise(none),
            "legal_topics": F.when(q % 4 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(none),
            "subsections": F.when(q % 5 == 0, F.array(F.lit("Contact"))).otherwise(none),
            "language": F.when(q % 2 == 0, F.lit("EN")),
            "reference_year": F.when(q % 7 == 0, F.lit(2021)),
        }
    )


_ALLOWED = """allowed AS (SELECT q.query_id, c.chunk_id FROM queries q JOIN chunks c ON
  (q.query_id % 3 <> 0 OR c.country_code IN ('SRC0', 'SRC1')) AND (q.query_id % 4 <> 0 OR coalesce(c.legal_topic IN ('alpha', 'beta'), false))
  AND (q.query_id % 5 <> 0 OR coalesce(c.subsection = 'Contact', false)) AND (q.query_id % 2 <> 0 OR c.language = 'en') AND (q.query_id % 7 <> 0 OR c.reference_year = 2021)
  AND (c.subsection IS DISTINCT FROM 'Contact' OR q.query_id % 5 = 0))"""


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = I.chunks(spark, d), _filters(I.queries(spark, d))
    queries = queries.withColumn("filtered", search.filters_given(queries))
    index = search.build_postings(chunks, ["content"], search.query_terms(queries).select("term"), search.ATTRIBUTES)
    return search.bm25_top_filtered(queries, index, CONTENT, 10)


def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.filter_counts(_filters(I.queries(spark, d)), I.chunks(spark, d))


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    index = search.build_postings(I.chunks(spark, d), ["content", "subsection", "section"])
    per = index.postings.groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))
    return per.join(index.fields, "field").select("field", "postings", "terms", "tokens", "n", F.round("avgdl", 6).alias("avgdl"))


def contact_lookup(spark: SparkSession, d: str) -> DataFrame:
    queries = I.queries(spark, d).select("query_id", F.array(F.concat(F.lit("SRC"), (F.col("query_id") % 4).cast("string")), F.lit("SRC9")).alias("country_codes"))
    return search.contact_lookup(queries, I.chunks(spark, d)).select("query_id", "rank", "chunk_id", "country_code")


def query_validation(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("item_id")
    rows = I.table(spark, d, "benchmark").select(q.alias("query_id"), F.when(q % 9 == 0, F.lit(" x ")).when(q % 9 == 1, F.repeat("text", 9)).otherwise(F.col("text")).alias("query"), (q % 60).cast("int").alias("limit"), F.when(q % 8 == 3, 1001).otherwise(0).alias("offset"))
    _, rejects = search.validate_queries(rows)
    return rejects.groupBy("reason").agg(F.count("*").alias("n"), F.min("query_id").alias("first"))


def source_limits(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("item_id")
    share, pool = search.candidate_limits((q % 10 + 1).cast("int"), (q % 5).cast("int"), 3, q % 2 == 0)
    return I.table(spark, d, "benchmark").select(q.alias("query_id"), share.alias("share"), pool.alias("pool"), search.check_source_budget(q % 10 + 1, q % 5).alias("over"))


def retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    b = I.table(spark, d, "benchmark")
    out = search.retrieval_query(F.col("text"), F.array(F.lit("the"), F.lit("heen on"), F.lit("la")), F.array(F.lit("notice period")))
    return b.select(F.col("item_id").alias("query_id"), F.substring("text", 1, 1).alias("initial"), out.alias("query"))


def facet_country(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_country(I.chunks(spark, d))


def facet_values(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    return facets.facet_topic(c, None).withColumn("facet", F.lit("topic")).unionByName(facets.facet_subsection(c, None).withColumn("facet", F.lit("subsection")))


def facet_lang_source(spark: SparkSession, d: str) -> DataFrame:
    return facets.catalog(I.chunks(spark, d), None, None, None)


def document_inventory(spark: SparkSession, d: str) -> DataFrame:
    return facets.document_inventory(I.chunks(spark, d), limit=None)


def existing_documents(spark: SparkSession, d: str) -> DataFrame:
    return facets.existing_documents(I.chunks(spark, d).withColumn("source_filename", F.concat("country_code", F.lit(".docx"))), "SRC3")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The best hits of each query in groups by language, ranked within."""
    c, q = I.chunks(spark, d), I.queries(spark, d).withColumn("filtered", F.lit(True))
    # languages are few; a null one is a group too
    c = c.withColumn("kind", F.coalesce(F.concat(F.lit("="), "language"), F.lit("")))
    kinds = q.select("query_id").crossJoin(F.broadcast(c.select("kind").distinct()))
    hits = search.bm25_top_kinds(q, _index(c, q, ["content"], "kind"), CONTENT, kinds, 8)
    group = F.when(F.col("kind") == "=en", 0).when(F.col("kind") == "=fr", 1).when(F.col("kind") == "=de", 2).otherwise(3)
    return hits.withColumn("group_idx", group)


_RANKED = """ranked AS (SELECT * FROM (SELECT h.query_id, h.chunk_id, h.score, c.language, c.legal_topic, c.country_code, c.content,
  row_number() OVER (PARTITION BY query_id, language ORDER BY score DESC, chunk_id) AS rank,
  CASE language WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS group_idx FROM hits h JOIN chunks c USING (chunk_id)) WHERE rank <= 8)"""


def interleave_topk(spark: SparkSession, d: str) -> DataFrame:
    return select.interleave(_ranked(spark, d), 12).select("query_id", "chunk_id", "group_idx", "position")


def _by_score(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d).select("chunk_id", "legal_topic", "country_code", "content")
    return c.join(bounded(cut(_top(spark, d, CONTENT, True, 20), "pages")), "chunk_id")


def topic_balanced(spark: SparkSession, d: str) -> DataFrame:
    hits = _by_score(spark, d).withColumn("topics", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("beta"))).otherwise(F.array(F.lit("gamma"), F.lit("alpha"), F.lit("delta"))))
    return select.topic_balanced(hits, 9).select("query_id", "chunk_id", "position")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = _by_score(spark, d).where("rank <= 6")
    return select.context_budget(hits, 9000, 3000).select("query_id", "chunk_id", "position", "budget", F.length("excerpt").alias("chars"))


def truncate_paragraph(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", "\n", "\n\n")
    return I.table(spark, d, "documents").select("doc_id", F.sha2(X.truncate_at_paragraph(t, F.lit(1500)), 256).alias("digest"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    hits = _top(spark, d, CONTENT, True, 4)
    orders = I.queries(spark, d).select("query_id", F.when(F.col("query_id") % 3 == 0, "[4, 2, 1, 3]").when(F.col("query_id") % 3 == 1, "[1, 1, 2, 3]").otherwise("not json").alias("ranking"))
    return select.apply_ranking(hits, orders).select("query_id", "chunk_id", "position")


def retrieve_topics(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    q = I.queries(spark, d).withColumns({"topics": F.array(F.lit("beta"), F.when(F.col("query_id") % 2 == 0, "alpha").otherwise("nothing")), "limit": F.lit(5)})
    return select.retrieve_per_topic(q, c, _index(c, q, ["content"], "legal_topic"), CONTENT).select("query_id", "chunk_id", "position")


def retrieve_countries(spark: SparkSession, d: str) -> DataFrame:
    c = I.chunks(spark, d)
    q = I.queries(spark, d).withColumns({"codes": F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("SRC2"), F.lit("SRC0"))), "max_sources": F.lit(6)})
    return select.retrieve_multi_country(q, c, _index(c, q, ["content"]), CONTENT).select("query_id", "chunk_id", "position")


_TOPK = " SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {t}) WHERE rank > {a} AND rank <= {b}"
_TOP20 = "top AS (SELECT t.*, c.legal_topic, c.country_code, c.content FROM (" + _TOPK.format(t="hits", a=0, b=20) + ") t JOIN chunks c USING (chunk_id))"
_STOP = "('compare','comparison','explain','rules','rule','requirements','requirement','law','laws','the','a','an','in','on','at','for','to','of','and','or','is','are','what','which','how')"

def _budgets(ranks: int, total: int, per: int) -> str:
    """The first ``ranks`` hits cut to their budgets, as table ``cut``: the n-th budget follows from those before it."""
    steps = ""
    for i in range(2, ranks + 1):
        left = " - ".join(["share", *[f"b{x}" for x in range(1, i)]])
        steps += f", s{i} AS (SELECT *, CASE WHEN n >= {i} AND {left} > 0 THEN least({per}, greatest(1, ({left}) // greatest(n - {i - 1}, 1))) ELSE 0 END AS b{i} FROM s{i - 1})"
    pick = " ".join(f"WHEN {i} THEN b{i}" for i in range(1, ranks + 1))
    return f""", six AS (SELECT * FROM top WHERE rank <= {ranks}), c AS (SELECT query_id, country_code, count(*) AS n, min(rank) AS first FROM six GROUP BY query_id, country_code),
  d AS (SELECT *, greatest(1, {total} // count(*) OVER (PARTITION BY query_id)) AS share, row_number() OVER (PARTITION BY query_id ORDER BY first) AS no FROM c),
  e AS (SELECT s.*, d.n, d.share, d.no, row_number() OVER (PARTITION BY s.query_id, s.country_code ORDER BY rank) AS i FROM six s JOIN d USING (query_id, country_code)),
  s1 AS (SELECT *, least({per}, share) AS b1 FROM e){steps}, o AS (SELECT *, CASE i {pick} END AS budget FROM s{ranks}),
  cut AS (SELECT query_id, chunk_id, country_code, legal_topic, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY no, rank) AS INTEGER) AS position, CAST(budget AS INTEGER) AS budget,
   CASE WHEN length(trim(content)) <= budget THEN trim(content) ELSE regexp_replace(substr(trim(content), 1, budget), '\\s+$', '') END AS excerpt FROM o WHERE budget > 0)"""


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_multifield, bm25_msm70, bm25_filtered, search_totals, filter_counts, postings_stats, contact_lookup, query_validation, source_limits, retrieval_queries, facet_country, facet_values, facet_lang_source, document_inventory, existing_documents, interleave_topk, topic_balanced, context_budget, truncate_paragraph, reranked, retrieve_topics, retrieve_countries)}

ORACLE_SQL = {
    "bm25_topk": bm25(_ONE, "1") + _TOPK.format(t="hits", a=0, b=10),
    "bm25_multifield": bm25(_THREE, "1") + _TOPK.format(t="hits", a=5, b=15),
    "bm25_msm70": bm25(_THREE, _SEVENTY) + _TOPK.format(t="hits", a=0, b=10),
    "bm25_filtered": bm25(_ONE, "CASE WHEN query_id % 3 = 0 OR query_id % 4 = 0 OR query_id % 5 = 0 THEN 1 ELSE greatest(1, floor(0.7 * n_terms)) END") + ", " + _ALLOWED + _TOPK.format(t="hits SEMI JOIN allowed USING (query_id, chunk_id)", a=0, b=10),
    "search_totals": bm25(_ONE, _SEVENTY) + " SELECT query_id, count(*) AS total_hits FROM hits GROUP BY query_id",
    "filter_counts": WITH + I.CHUNKS_SQL + ", " + I.QUERIES_SQL + ", " + _ALLOWED + " SELECT query_id, count(*) AS n, min(chunk_id) AS first FROM allowed GROUP BY query_id",
    "postings_stats": bm25(_THREE, "1") + " SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, n, round(avgdl, 6) AS avgdl FROM postings JOIN fields USING (field) GROUP BY field, n, avgdl",
    "contact_lookup": WITH + I.CHUNKS_SQL + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, country_code FROM (SELECT b.item_id AS query_id, c.chunk_id, c.country_code, row_number() OVER (PARTITION BY b.item_id ORDER BY c.chunk_id) AS rank FROM benchmark b JOIN chunks c ON c.subsection = 'Contact' AND c.country_code IN ('SRC' || CAST(b.item_id % 4 AS VARCHAR), 'SRC9')) WHERE rank <= 20",
    "query_validation": """WITH q AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN ' x ' WHEN item_id % 9 = 1 THEN repeat(text, 9) ELSE text END AS query, item_id % 60 AS lim, CASE WHEN item_id % 8 = 3 THEN 1001 ELSE 0 END AS off FROM benchmark),
  r AS (SELECT item_id, CASE WHEN length(trim(query)) < 2 THEN 'query_too_short' WHEN length(query) > 1000 THEN 'query_too_long' WHEN lim < 1 OR lim > 50 THEN 'limit_range' WHEN off < 0 OR off > 1000 THEN 'offset_range' END AS reason FROM q)
  SELECT reason, count(*) AS n, min(item_id) AS first FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "source_limits": """SELECT query_id, CAST(share AS INTEGER) AS share, CAST(CASE WHEN query_id % 2 = 0 THEN least(share * 3, 20) ELSE share END AS INTEGER) AS pool, n >= 2 AND m < n AS over FROM (
  SELECT item_id AS query_id, item_id % 10 + 1 AS m, item_id % 5 AS n, greatest(ceil((item_id % 10 + 1) / greatest(item_id % 5, 1)), 4) AS share FROM benchmark)""",
    "retrieval_queries": f"""SELECT item_id AS query_id, substr(text, 1, 1) AS initial, trim(array_to_string(list_concat(list_filter(regexp_extract_all(t, '[A-Za-z0-9''-]+'), lambda w: lower(w) NOT IN {_STOP}), ['notice period']), ' ')) AS query
  FROM (SELECT item_id, text, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN lower(w) IN ('the', 'la') THEN ' ' ELSE w END), '') AS t FROM benchmark)""",
    "facet_country": WITH + I.CHUNKS_SQL + " SELECT country_code, min(country) AS country, count(*) AS chunk_count FROM chunks GROUP BY country_code ORDER BY country_code LIMIT 300",
    "facet_values": WITH + I.CHUNKS_SQL + " SELECT 'topic' AS facet, legal_topic AS value, count(*) AS chunk_count FROM chunks WHERE legal_topic IS NOT NULL GROUP BY legal_topic UNION ALL SELECT 'subsection', subsection, count(*) FROM chunks WHERE length(subsection) <= 512 GROUP BY subsection",
    "facet_lang_source": WITH + I.CHUNKS_SQL + " SELECT CASE WHEN grouping(country_code) = 0 THEN 'country' WHEN grouping(legal_topic) = 0 THEN 'topic' ELSE 'subsection' END AS facet, coalesce(country_code, legal_topic, subsection) AS value, count(*) AS chunk_count FROM chunks GROUP BY GROUPING SETS ((country_code), (legal_topic), (subsection)) HAVING coalesce(country_code, legal_topic, subsection) IS NOT NULL",
    "document_inventory": WITH + I.CHUNKS_SQL + " SELECT document_id, arg_min(country, chunk_id) AS country, arg_min(country_code, chunk_id) AS country_code, arg_min(language, chunk_id) AS language, arg_min(reference_year, chunk_id) AS reference_year, count(*) AS chunk_count FROM chunks GROUP BY document_id",
    "existing_documents": WITH + I.CHUNKS_SQL + " SELECT document_id, 'SRC3.docx' AS source_filename FROM chunks WHERE country_code = 'SRC3' GROUP BY document_id",
    "interleave_topk": bm25(_ONE, "1") + ", " + _RANKED + " SELECT query_id, chunk_id, CAST(group_idx AS INTEGER) AS group_idx, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, group_idx) AS position FROM ranked) WHERE position <= 12",
    "topic_balanced": bm25(_ONE, "1") + ", " + _TOP20 + """ SELECT query_id, chunk_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN t IS NULL THEN 1 ELSE 0 END, k, t, rank) AS position FROM (
  SELECT *, CASE WHEN t IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, legal_topic ORDER BY rank) END AS k FROM (
   SELECT *, CASE WHEN query_id % 3 <> 0 THEN CASE legal_topic WHEN 'gamma' THEN 1 WHEN 'alpha' THEN 2 WHEN 'delta' THEN 3 END END AS t FROM top))) WHERE position <= 9""",
    "context_budget": bm25(_ONE, "1") + ", " + _TOP20 + _budgets(6, 9000, 3000) + " SELECT query_id, chunk_id, position, budget, CAST(length(excerpt) AS INTEGER) AS chars FROM cut",
    "truncate_paragraph": """WITH t AS (SELECT doc_id, trim(replace(text, chr(10), chr(10) || chr(10))) AS t FROM documents), c AS (SELECT *, substr(t, 1, 1500) AS c FROM t),
  l AS (SELECT *, length(c) - strpos(reverse(c), chr(10) || chr(10)) - 1 AS last, strpos(c, chr(10) || chr(10)) > 0 AS has FROM c)
  SELECT doc_id, sha256(CASE WHEN length(t) <= 1500 THEN t ELSE regexp_replace(CASE WHEN has AND last >= 750 THEN substr(c, 1, last) ELSE c END, '\\s+$', '') END) AS digest FROM l""",
    "reranked": bm25(_ONE, "1") + ", t4 AS (" + _TOPK.format(t="hits", a=0, b=4) + "), n AS (SELECT query_id, count(*) AS n FROM t4 GROUP BY query_id) SELECT query_id, chunk_id, CAST(CASE WHEN query_id % 3 = 0 AND n = 4 THEN CASE rank WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END ELSE rank END AS INTEGER) AS position FROM t4 JOIN n USING (query_id)",
    "retrieve_topics": bm25(_ONE, "1") + """, g AS (SELECT h.query_id, h.chunk_id, h.score, c.legal_topic, CASE c.legal_topic WHEN 'beta' THEN 0 ELSE 1 END AS grp FROM hits h JOIN chunks c USING (chunk_id) WHERE c.legal_topic = 'beta' OR (c.legal_topic = 'alpha' AND h.query_id % 2 = 0)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, chunk_id) AS rank FROM g),
  i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, grp) AS p FROM r WHERE rank <= 20),
  hits70 AS (SELECT query_id, chunk_id, round(max(s) + 0.2 * (sum(s) - max(s)), 4) AS score FROM perfield WHERE matched >= greatest(1, floor(0.7 * n_terms)) GROUP BY query_id, chunk_id),
  broad AS (SELECT h.query_id, h.chunk_id, c.legal_topic, 0 AS grp, row_number() OVER (PARTITION BY h.query_id ORDER BY score DESC, h.chunk_id) AS p FROM hits70 h JOIN chunks c USING (chunk_id) ANTI JOIN r USING (query_id)),
  a AS (SELECT query_id, chunk_id, legal_topic, p FROM i WHERE p <= 20 UNION ALL SELECT query_id, chunk_id, legal_topic, p FROM broad WHERE p <= 20),
  b AS (SELECT *, CASE WHEN legal_topic = 'beta' THEN 1 WHEN legal_topic = 'alpha' AND query_id % 2 = 0 THEN 2 END AS t FROM a),
  k AS (SELECT *, CASE WHEN t IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, t ORDER BY p) END AS k FROM b)
  SELECT query_id, chunk_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN t IS NULL THEN 1 ELSE 0 END, k, t, p) AS position FROM k) WHERE position <= 5""",
    "retrieve_countries": bm25(_ONE, "CASE WHEN query_id % 4 = 0 THEN greatest(1, floor(0.7 * n_terms)) ELSE 1 END") + """, g AS (SELECT h.query_id, h.chunk_id, h.score, CASE WHEN h.query_id % 4 = 0 THEN 0 WHEN c.country_code = 'SRC2' THEN 0 ELSE 1 END AS grp FROM hits h JOIN chunks c USING (chunk_id) WHERE h.query_id % 4 = 0 OR c.country_code IN ('SRC2', 'SRC0')),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, chunk_id) AS rank FROM g)
  SELECT query_id, chunk_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, grp) AS position FROM r WHERE rank <= CASE WHEN query_id % 4 = 0 THEN 6 ELSE 4 END) WHERE position <= 6""",
}
