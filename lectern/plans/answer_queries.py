"""Answer checks over answers that are derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import values as V
from lectern.operators import answers as A
from lectern.operators import search, select
from lectern.plans import inputs as I
from lectern.plans import search_queries as S
from lectern.plans.text_queries import _EVW, CONCEPTS, _any, _strings
from lectern.sources.store import bounded, cut

NAMES = [(f"SRC{i}", f"SRC{i}") for i in range(6)]


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "code string, alias string")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """With a question and the requested codes: the answer's own country, for every third one another too."""
    a = I.answers(spark, d)
    k = F.col("answer_id")
    own = F.concat(F.lit("SRC"), (k % 5).cast("string"))
    return a.withColumns({"question": F.when(k % 6 == 0, "Paid leave?").otherwise("Notice?"), "codes": F.when(k % 3 == 0, F.array(own, F.lit("SRC5"))).otherwise(F.array(own))})


def citations(spark: SparkSession, d: str) -> DataFrame:
    return A.extract_citations(I.answers(spark, d))


def _odd(spark: SparkSession, d: str) -> DataFrame:
    """Answers with malformed, repeated and unknown citations."""
    k = F.col("answer_id")
    more = F.when(k % 5 == 0, " [1, 3; 2]").when(k % 5 == 1, " x [2], [2] [2] y").when(k % 5 == 2, " none").otherwise(" [1, 2]. [1, 2] end")
    return I.answers(spark, d).select("answer_id", F.concat(F.when(k % 5 == 2, "").otherwise(F.col("answer")), more).alias("answer"))


def citation_checks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("answer")
    return _odd(spark, d).select("answer_id", A.citation_format_error(t).alias("format_error"), A.citation_range_error(t, F.lit(6)).alias("range_error"), F.sha2(A.collapse_repeated(t), 256).alias("collapsed"))


def loose_sections(spark: SparkSession, d: str) -> DataFrame:
    p = A.parse_sections(I.answers(spark, d))
    return p.groupBy("answer_id", "section_no", "heading", "is_comparison").agg(F.count_if("is_bullet").alias("bullets"))


def canonical_lines(spark: SparkSession, d: str) -> DataFrame:
    p = A.parse_canonical(_answers(spark, d), _names(spark))
    return p.groupBy("answer_id", "kind", "section_no").agg(F.count("*").alias("n"), F.max("code").alias("code"), F.max("comparison").alias("comparison"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return A.extract_claims(A.parse_canonical(_answers(spark, d), _names(spark)))


def claims(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("answer_id", "bullet_no", F.sha2("claim", 256).alias("claim"), F.array_join(F.transform("cited", lambda c: c.cast("string")), ",").alias("cited"))


def structure_errors(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return A.structure_errors(a, A.parse_canonical(a, _names(spark)))


def uncited_claims(spark: SparkSession, d: str) -> DataFrame:
    return A.uncited_claims(_claims(spark, d))


def citation_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return A.citation_mismatch(_claims(spark, d), I.sources(spark, d)).select("answer_id", "bullet_no", "citation", "code", "country_code")


def bullet_limits(spark: SparkSession, d: str) -> DataFrame:
    """Every answer asks for two countries here, so the limits are tight."""
    a = _answers(spark, d).withColumn("codes", F.array(F.element_at("codes", 1), F.lit("SRC5")))
    return A.bullet_limits(a, A.parse_canonical(a, _names(spark)))


def missing_entities(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_entities(_answers(spark, d), _names(spark))


def repeated_bullets(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).withColumn("claim", F.when(F.col("answer_id") % 4 == 0, F.concat(F.lit("Same, "), (F.col("bullet_no") % 2).cast("string"))).otherwise(F.col("claim")))
    return A.repeated_bullets(c).select("answer_id", F.sha2("bullet", 256).alias("bullet"), "n")


_WORDINGS = ("The provided extracts say so.", "These sources agree.", "Unpaid leave is possible.", "No information is available.", "It is missing from the documents.", "Nothing to add.")


def wording_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every document's own text as an answer, and for each one of some fixed wordings under the id's negative; the text itself is the context."""
    k = F.col("doc_id")
    own = I.table(spark, d, "documents").select("doc_id", F.col("text").alias("a"), F.col("text").alias("c"))
    fixed = own.select((-1 - k).alias("doc_id"), F.get(F.array(*[F.lit(w) for w in _WORDINGS]), (k % 6).cast("int")).alias("a"), F.concat("c", F.when(k % 4 == 0, " within 3 months").otherwise("")).alias("c"))
    rows = own.unionByName(fixed).withColumn("q", F.when(k % 2 == 0, "Paid time off?").otherwise("Notice?"))
    return rows.select("doc_id", F.array_join(A.forbidden_phrases(F.col("a")), ",").alias("phrases"), A.paired_phrase_error(F.col("q"), F.col("a")).alias("paired"), A.false_absence(F.col("a"), F.col("c")).alias("absence"))


def _sources(spark: SparkSession, d: str, answers: DataFrame | None = None) -> DataFrame:
    return I.sources(spark, d, answers).withColumn("content", F.lit("text"))


def _drift(spark: SparkSession, d: str, answers: DataFrame | None = None) -> DataFrame:
    """Each answer with a spec of two concept groups, and one without any; the own code of every fourth is insufficient."""
    k = F.col("answer_id")
    mode = F.when(k % 3 == 0, "broad_topic").when(k % 3 == 1, "relation_required").otherwise("direct_topic")
    concepts = F.array(*[F.array(*[F.lit(t) for t in g]) for g in CONCEPTS])
    rows = (_answers(spark, d) if answers is None else answers).select("answer_id", "answer", F.slice("codes", 1, 1).alias("codes"))
    two = F.array(F.struct(F.lit(0).alias("spec_idx"), concepts.alias("concepts"), mode.alias("evidence_mode")), F.struct(F.lit(1).alias("spec_idx"), F.array().cast("array<array<string>>").alias("concepts"), F.lit("direct_topic").alias("evidence_mode")))
    specs = rows.select("answer_id", "codes", F.explode(two).alias("s")).select("answer_id", "codes", "s.*")
    poor = specs.where("answer_id % 4 = 0").select("answer_id", "spec_idx", F.explode("codes").alias("code"))
    return A.subject_drift(rows, specs, poor)


def subject_drift(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    # the made-up answers are put together once
    answers = cut(_answers(spark, d), "answers")
    q = A.quality_report(answers, _sources(spark, d, answers), _names(spark), _drift(spark, d, answers))
    return q.select("answer_id", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), "verdict")


def chosen_attempts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = I.table(spark, d, "documents").select(k.alias("answer_id"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("hard"))
    return A.choose_attempt(rows, rows.where("answer_id % 5 > 0").withColumn("hard", F.when(F.col("answer_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))))


def renumber_citations(spark: SparkSession, d: str) -> DataFrame:
    """The answers against their sources in reverse order; every fourth answer has an id twice."""
    s = I.sources(spark, d).select("answer_id", (7 - F.col("citation")).alias("source_order"), F.when((F.col("answer_id") % 4 == 0) & (F.col("citation") == 6), F.lit(2)).otherwise(F.col("citation")).alias("citation"))
    done = A.dense_renumber(I.answers(spark, d), s)
    return done.select("answer_id", F.sha2("answer", 256).alias("answer"), "renumbered")


def context_texts(spark: SparkSession, d: str) -> DataFrame:
    c, q = I.chunks(spark, d), I.queries(spark, d)
    index = search.build_postings(c, ["content"], search.query_terms(q).select("term"))
    # a page for each query is small: it meets the texts where they are
    top = cut(search.bm25_top(q.withColumn("filtered", F.lit(True)), index, {"content": 5.0}, 4), "pages")
    chosen = select.context_budget(c.join(bounded(top), "chunk_id"), 4000, 1000)
    return A.context_text(chosen).select("query_id", F.sha2("context", 256).alias("digest"), F.length("context").alias("chars"))


def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    return A.cited_sources(I.answers(spark, d), I.sources(spark, d))


def contact_sections(spark: SparkSession, d: str) -> DataFrame:
    q = I.queries(spark, d).select("query_id", F.array(F.lit("C1"), F.concat(F.lit("C"), (F.col("query_id") % 4).cast("string")), F.lit("C9")).alias("country_codes"), (F.col("query_id") % 3).alias("offset"))
    contacts = spark.createDataFrame([(f"C{i}", f"text {i}") for i in range(3)], "country_code string, content string")
    return A.contact_section(q, contacts)


def merged_scopes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") + F.col("conv_id")
    t = I.turns(spark, d)
    acts = t.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("action_idx"), F.array(F.concat(F.lit("C"), (k % 3).cast("string"))).alias("codes"), F.array(F.get(F.array(*[F.lit(x) for x in ("alpha", "odd", "gamma")]), (k % 3).cast("int"))).alias("topics"))
    explicit = t.where("conv_id % 4 = 0").select(F.col("conv_id").alias("query_id")).distinct().withColumn("topics", F.array(F.lit("beta"), F.lit("odd")))
    m = A.merge_action_scopes(acts, explicit, I.FIVE)
    return m.select("query_id", F.array_join("codes", ",").alias("codes"), F.array_join("topics", ",").alias("topics"))


QUERIES = {f.__name__: f for f in (citations, citation_checks, loose_sections, canonical_lines, claims, structure_errors, uncited_claims, citation_mismatch, bullet_limits, missing_entities, repeated_bullets, wording_checks, subject_drift, quality_report, chosen_attempts, renumber_citations, context_texts, cited_sources, contact_sections, merged_scopes)}

W = "WITH "
_LINES = I.ANSWERS_SQL + ", ls AS (SELECT answer_id, string_split(answer, chr(10)) AS l FROM answers), li AS (SELECT answer_id, unnest(l) AS raw, unnest(range(0, len(l))) AS n FROM ls), ln AS (SELECT *, trim(raw) AS line, starts_with(raw, '- ') AS bullet FROM li WHERE trim(raw) <> '')"
# A heading is the first line (the answer's own country) or Comparison; all other lines of these answers are bullets.
_PARSED = _LINES + """, ps AS (SELECT answer_id, n, line, bullet, CASE WHEN bullet THEN 'bullet' ELSE 'heading' END AS kind, CAST(sum(CASE WHEN bullet THEN 0 ELSE 1 END) OVER w AS BIGINT) AS section_no, CAST(sum(CASE WHEN bullet THEN 1 ELSE 0 END) OVER w AS BIGINT) AS bullet_no FROM ln WINDOW w AS (PARTITION BY answer_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
 pc AS (SELECT *, CASE WHEN section_no = 1 THEN 'SRC' || CAST(answer_id % 5 AS VARCHAR) END AS code, section_no > 1 AS comparison FROM ps)"""
_CITED = "list_transform(flatten(list_transform(regexp_extract_all({t}, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]'), lambda g: regexp_extract_all(g, '\\d+'))), lambda x: CAST(x AS INTEGER))"
# Each citation of these answers stands in brackets of its own; n becomes 7 - n.
_SWAPPED = "answer"
for _n in range(1, 7):
    _SWAPPED = f"replace({_SWAPPED}, '[{_n}]', '[#{7 - _n}]')"
_CLAIMS = _PARSED + ", cl AS (SELECT answer_id, section_no, bullet_no, code, comparison, regexp_replace(line, '^\\s*[-*•]\\s+', '') AS claim FROM pc WHERE bullet), cc AS (SELECT *, " + _CITED.format(t="claim") + " AS cited FROM cl)"
_ODD = I.ANSWERS_SQL + ", odd AS (SELECT answer_id, CASE WHEN answer_id % 5 = 2 THEN '' ELSE answer END || CASE answer_id % 5 WHEN 0 THEN ' [1, 3; 2]' WHEN 1 THEN ' x [2], [2] [2] y' WHEN 2 THEN ' none' ELSE ' [1, 2]. [1, 2] end' END AS answer FROM answers)"
_BROKEN = ", bad AS (SELECT answer_id, min(p) AS p FROM (SELECT answer_id, 3 AS p FROM pc WHERE section_no = 1 GROUP BY answer_id HAVING count(*) FILTER (bullet) = 0 UNION ALL SELECT answer_id, 4 FROM answers WHERE answer_id % 3 = 0) GROUP BY answer_id)"
_MISMATCH = ", mm AS (SELECT DISTINCT c.answer_id, c.bullet_no, s.citation, c.code, s.country_code FROM (SELECT answer_id, bullet_no, code, unnest(cited) AS x FROM cc WHERE code IS NOT NULL AND NOT comparison) c JOIN sources s ON s.answer_id = c.answer_id AND s.citation = c.x WHERE s.country_code <> c.code)"
_DRIFT = ", dw AS (SELECT answer_id, ' ' || array_to_string(" + _EVW.format(t="answer") + ", ' ') || ' ' AS w FROM answers), dg AS (SELECT answer_id, contains(w, ' of the ') OR contains(w, ' the and ') AS a, contains(w, ' in ') OR contains(w, ' la ') OR contains(w, ' die ') AS b FROM dw), drift AS (SELECT answer_id FROM dg WHERE answer_id % 4 > 0 AND NOT CASE answer_id % 3 WHEN 0 THEN true WHEN 1 THEN a AND b ELSE a OR b END)"

ORACLE_SQL = {
    "subject_drift": W + I.ANSWERS_SQL + _DRIFT + " SELECT answer_id, 0 AS spec_idx FROM drift",
    "citations": W + I.ANSWERS_SQL + ", c AS (SELECT answer_id, " + _CITED.format(t="answer") + " AS c FROM answers), u AS (SELECT answer_id, unnest(c) AS citation, unnest(range(0, len(c))) AS i FROM c), f AS (SELECT answer_id, citation, min(i) AS i FROM u GROUP BY answer_id, citation) SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS INTEGER) AS pos, citation FROM f",
    "citation_checks": W + _ODD + ", c AS (SELECT *, " + _CITED.format(t="answer") + " AS c FROM odd) SELECT answer_id, len(list_filter(regexp_extract_all(answer, '\\[[0-9][0-9,\\s;]*\\]'), lambda g: NOT regexp_matches(g, '^\\[\\d+(?:\\s*,\\s*\\d+)*\\]$'))) > 0 AS format_error, len(c) = 0 OR len(list_filter(c, lambda x: x < 1 OR x > 6)) > 0 AS range_error, sha256(replace(replace(answer, '[2], [2] [2]', '[2],'), '[1, 2]. [1, 2]', '[1, 2].')) AS collapsed FROM c",
    "loose_sections": W + _PARSED + " SELECT answer_id, section_no, max(CASE WHEN NOT bullet THEN line END) AS heading, max(CASE WHEN NOT bullet THEN line END) = 'Comparison' AS is_comparison, count(*) FILTER (bullet) AS bullets FROM pc GROUP BY answer_id, section_no",
    "canonical_lines": W + _PARSED + " SELECT answer_id, kind, section_no, count(*) AS n, max(code) AS code, max(comparison) AS comparison FROM pc GROUP BY answer_id, kind, section_no",
    "claims": W + _CLAIMS + " SELECT answer_id, bullet_no, sha256(claim) AS claim, array_to_string(list_transform(cited, lambda x: CAST(x AS VARCHAR)), ',') AS cited FROM cc",
    "structure_errors": W + _PARSED + _BROKEN + " SELECT answer_id, CASE p WHEN 3 THEN 'empty_section' ELSE 'missing_section' END AS error FROM bad",
    "uncited_claims": W + _CLAIMS + " SELECT answer_id, count(*) AS n FROM cc WHERE trim(claim) <> '' AND len(cited) = 0 GROUP BY answer_id",
    "citation_mismatch": W + _CLAIMS + ", " + I.SOURCES_SQL + _MISMATCH + " SELECT * FROM mm",
    "bullet_limits": W + _PARSED + ", s AS (SELECT answer_id, section_no, comparison, count(*) FILTER (bullet) AS b FROM pc GROUP BY answer_id, section_no, comparison) SELECT answer_id FROM s GROUP BY answer_id HAVING max(CASE WHEN NOT comparison THEN b END) > 4 OR count(*) FILTER (comparison) > 1 OR max(CASE WHEN comparison THEN b END) > 2",
    "missing_entities": W + I.ANSWERS_SQL + " SELECT answer_id, 'SRC5' AS code FROM answers WHERE answer_id % 3 = 0 AND NOT contains(lower(answer), 'src5')",
    "repeated_bullets": W + _CLAIMS + ", b AS (SELECT answer_id, trim(regexp_replace(lower(regexp_replace(CASE WHEN answer_id % 4 = 0 THEN 'Same, ' || CAST(bullet_no % 2 AS VARCHAR) ELSE claim END, '\\[[0-9][0-9,\\s;]*\\]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS b FROM cc) SELECT answer_id, sha256(b) AS bullet, count(*) AS n FROM b WHERE b <> '' GROUP BY answer_id, b HAVING count(*) > 1",
    "wording_checks": f"""WITH own AS (SELECT doc_id, text AS a, text AS c FROM documents), x AS (SELECT doc_id, a, c FROM own UNION ALL SELECT -1 - doc_id, ({_strings(_WORDINGS)})[doc_id % 6 + 1], c || CASE WHEN doc_id % 4 = 0 THEN ' within 3 months' ELSE '' END FROM own),
  f AS (SELECT *, list_filter({_strings(V.FORBIDDEN_PHRASES)}, lambda p: contains(lower(a), p)) AS p FROM x)
  SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ',') WHEN {_any("lower(a)", V.FORBIDDEN_PATTERNS)} THEN 'internal-mechanism phrasing' ELSE '' END AS phrases, doc_id % 2 = 0 AND contains(lower(a), 'unpaid leave') AS paired, {_any("lower(a)", V.ABSENCE_PATTERNS)} AND {_any("lower(c)", (V.DURATION,))} AS absence FROM f""",
    "quality_report": W + _CLAIMS + ", " + I.SOURCES_SQL + _BROKEN + _MISMATCH + _DRIFT + """, ok AS (SELECT * FROM cc WHERE answer_id NOT IN (SELECT answer_id FROM bad)),
  ct AS (SELECT answer_id, """ + _CITED.format(t="answer") + """ AS c, answer FROM answers),
  e AS (SELECT answer_id, 'citation_range' AS e FROM ct WHERE len(c) = 0 OR len(list_filter(c, lambda x: x < 1 OR x > 6)) > 0
   UNION SELECT answer_id, 'subject_drift' FROM drift UNION SELECT answer_id, 'structure' FROM bad UNION SELECT answer_id, 'uncited_claims' FROM ok WHERE trim(claim) <> '' AND len(cited) = 0
   UNION SELECT answer_id, 'citation_entity_mismatch' FROM mm WHERE answer_id NOT IN (SELECT answer_id FROM bad)
   UNION SELECT answer_id, 'missing_entities' FROM answers WHERE answer_id % 3 = 0 AND NOT contains(lower(answer), 'src5')
   UNION SELECT answer_id, 'bullet_limits' FROM (SELECT answer_id, comparison, section_no, count(*) FILTER (bullet) AS b FROM pc GROUP BY ALL) GROUP BY answer_id HAVING CASE WHEN answer_id % 3 = 0 THEN max(CASE WHEN NOT comparison THEN b END) > 4 OR count(*) FILTER (comparison) > 1 OR max(CASE WHEN comparison THEN b END) > 2 ELSE max(CASE WHEN NOT comparison THEN b END) > 6 END
   UNION SELECT answer_id, 'repeated_bullets' FROM (SELECT answer_id, trim(regexp_replace(lower(regexp_replace(claim, '\\[[0-9][0-9,\\s;]*\\]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS b FROM ok) WHERE b <> '' GROUP BY answer_id, b HAVING count(*) > 1),
  p AS (SELECT answer_id, coalesce(string_agg(e, ',' ORDER BY e) FILTER (e IN ('citation_range', 'uncited_claims', 'citation_entity_mismatch', 'missing_entities')), '') AS hard, coalesce(string_agg(e, ',' ORDER BY e) FILTER (e IN ('structure', 'bullet_limits', 'repeated_bullets', 'subject_drift')), '') AS soft FROM answers LEFT JOIN e USING (answer_id) GROUP BY answer_id)
  SELECT answer_id, hard, soft, CASE WHEN hard <> '' OR contains(soft, 'structure') OR contains(soft, 'subject_drift') THEN 'repair' WHEN soft <> '' THEN 'accept_soft' ELSE 'ok' END AS verdict FROM p""",
    "chosen_attempts": "SELECT doc_id AS answer_id, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 = 0 THEN 'second' WHEN doc_id % 2 = 0 THEN 'first' ELSE 'failed' END AS chosen FROM documents",
    "renumber_citations": W + I.ANSWERS_SQL + ", c AS (SELECT *, answer_id % 4 > 0 AND len(list_filter(" + _CITED.format(t="answer") + ", lambda x: x < 1 OR x > 6)) = 0 AS ok FROM answers) SELECT answer_id, sha256(CASE WHEN ok THEN replace(" + _SWAPPED + ", '[#', '[') ELSE answer END) AS answer, ok AS renumbered FROM c",
    "context_texts": S.bm25(S._ONE, "1") + ", " + S._TOP20 + S._budgets(4, 4000, 1000) + ", t AS (SELECT query_id, string_agg('[' || CAST(position AS VARCHAR) || ']' || chr(10) || concat_ws(' | ', country_code, cut.legal_topic, subsection) || chr(10) || excerpt, chr(10) || chr(10) ORDER BY position) AS t FROM cut JOIN (SELECT chunk_id, subsection FROM chunks) USING (chunk_id) GROUP BY query_id) SELECT query_id, sha256(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM t",
    "cited_sources": W + I.ANSWERS_SQL + ", " + I.SOURCES_SQL + ", c AS (SELECT answer_id, " + _CITED.format(t="answer") + " AS c FROM answers), u AS (SELECT answer_id, unnest(c) AS citation, unnest(range(0, len(c))) AS i FROM c), f AS (SELECT answer_id, citation, min(i) AS i FROM u GROUP BY answer_id, citation), g AS (SELECT *, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS INTEGER) AS pos FROM f) SELECT answer_id, citation, pos, country_code FROM g JOIN sources USING (answer_id, citation)",
    "contact_sections": """WITH a AS (SELECT item_id AS query_id, item_id % 3 AS off, unnest(range(0, 3)) AS i, unnest(['C1', 'C' || CAST(item_id % 4 AS VARCHAR), 'C9']) AS country_code FROM benchmark), b AS (SELECT *, country_code IN ('C0', 'C1', 'C2') AS found FROM a)
  SELECT query_id, CAST(i AS INTEGER) AS i, country_code, CASE WHEN found THEN off + CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS citation, CASE WHEN found THEN 'text ' || country_code[2] END AS content, found FROM b""",
    "merged_scopes": """WITH x AS (SELECT conv_id, turn, (turn + conv_id) % 3 AS k FROM conversations), c AS (SELECT conv_id, k, min(turn) AS t FROM x GROUP BY conv_id, k)
  SELECT conv_id AS query_id, string_agg('C' || CAST(k AS VARCHAR), ',' ORDER BY t) AS codes, CASE WHEN conv_id % 4 = 0 THEN 'beta' ELSE coalesce(string_agg(CASE k WHEN 0 THEN 'alpha' WHEN 2 THEN 'gamma' END, ',' ORDER BY t) FILTER (k <> 1), '') END AS topics FROM c GROUP BY conv_id""",
}
