"""Checks of generated answers against their sources: citations, structure, claims and wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import values as V
from lectern.operators.evidence import answer_mentions
from lectern.sources.dims import small

STRICT, LOOSE = r"\[\d+(?:\s*,\s*\d+)*\]", r"\[[0-9][0-9,\s;]*\]"
BULLET = r"^\s*[-*•]\s+"
# Error types by weight, and the soft ones that are repaired.
HARD = ("citation_format", "citation_range", "uncited_claims", "citation_entity_mismatch", "missing_entities", "internal_reference", "paid_leave_scope")
SOFT = ("structure", "bullet_limits", "repeated_bullets", "false_absence_claim", "subject_drift")
REPAIRED_SOFT = ("structure", "subject_drift")


def citations(text: Column) -> Column:
    """ANS1: the numbers of all citation groups, first-seen order, each once."""
    groups = F.regexp_extract_all(text, F.lit(STRICT), F.lit(0))
    flat = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0))))
    return F.array_distinct(F.transform(flat, lambda n: n.try_cast("int")))


def extract_citations(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", F.posexplode(citations(F.col("answer"))).alias("pos", "citation"))


def citation_format_error(text: Column) -> Column:
    """ANS2: a bracket of digits that is no citation group."""
    return F.exists(F.regexp_extract_all(text, F.lit(LOOSE), F.lit(0)), lambda g: ~g.rlike(f"^{STRICT}$"))


def citation_range_error(text: Column, n_sources: Column) -> Column:
    """ANS3: no citation, or one outside 1..n."""
    return X.let(citations(text), lambda c: (F.size(c) == 0) | F.exists(c, lambda n: n.isNull() | (n < 1) | (n > n_sources)))


def collapse_repeated(text: Column) -> Column:
    """ANS4: adjacent equal citation groups as one, with the first punctuation between them."""
    # a repeat right after another leaves one group and its punctuation
    return F.regexp_replace(text, rf"({STRICT})(?:([.,;])?\s+\1)(?:[.,;]?\s+\1)*", "$1$2")


def lines_of(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", F.posexplode(F.split("answer", "\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))


def parse_sections(answers: DataFrame) -> DataFrame:
    """ANS5, loose: each non-blank line with ``is_bullet``, its ``section_no`` and ``heading``; any line that is no bullet is a heading."""
    rows = lines_of(answers).where("line <> ''").withColumn("is_bullet", F.col("raw").rlike(BULLET))
    w = Window.partitionBy("answer_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(~F.col("is_bullet"), F.regexp_replace("line", r"^[#*\s]+|[*:\s]+$", ""))
    rows = rows.withColumns({"section_no": F.sum((~F.col("is_bullet")).cast("int")).over(w), "heading": F.last(head, ignorenulls=True).over(w)})
    return rows.withColumn("is_comparison", F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.lit("comparison")))


def parse_canonical(answers: DataFrame, names: DataFrame) -> DataFrame:
    """ANS5, canonical: lines of ``answers(answer_id, answer, codes)`` with ``kind, section_no, code, bullet_no``.

    A heading equals a name of a requested entity or ``Comparison``. Text before the first heading is ``unresolved``;
    an indented line after a bullet continues it; another plain line is ``standalone``.
    """
    told = answers.select("answer_id", "answer", "codes").crossJoin(F.broadcast(_dimension(names)))
    rows = told.select("answer_id", "codes", "by_label", F.posexplode(F.split("answer", "\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    rows = rows.withColumns({"bullet": F.col("raw").rlike(BULLET), "label": F.lower(F.regexp_replace("line", r"^[#*\s]+|[*:\s]+$", ""))})
    own = F.array_max(F.array_intersect(F.try_element_at("by_label", F.col("label")), F.col("codes")))
    rows = rows.select("answer_id", "line_no", "raw", "line", "bullet", "label", own.alias("code"))
    head = ~F.col("bullet") & (F.col("code").isNotNull() | (F.col("label") == "comparison"))
    w = Window.partitionBy("answer_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h", head).withColumns({"section_no": F.sum(F.col("_h").cast("int")).over(w), "bullet_no": F.sum((F.col("bullet") & ~F.col("_h")).cast("int")).over(w)})
    s = Window.partitionBy("answer_id", "section_no").orderBy("line_no")
    rows = rows.withColumns({"code": F.max("code").over(Window.partitionBy("answer_id", "section_no")), "comparison": F.max(F.when(F.col("_h") & (F.col("label") == "comparison"), True)).over(Window.partitionBy("answer_id", "section_no")), "_b": F.max(F.col("bullet").cast("int")).over(s)})
    kind = (
        F.when(F.col("_h"), "heading").when(F.col("section_no") == 0, "unresolved").when(F.col("bullet"), "bullet").when(F.col("raw").rlike(r"^\s+\S") & (F.col("_b") == 1), "continuation").otherwise("standalone")
    )
    return rows.select("answer_id", "line_no", "line", kind.alias("kind"), "section_no", "bullet_no", "code", F.coalesce("comparison", F.lit(False)).alias("comparison"))


def extract_claims(parsed: DataFrame) -> DataFrame:
    """ANS6: one claim per bullet with its continuations: ``answer_id, section_no, bullet_no, code, comparison, claim, cited``."""
    rows = parsed.where("kind in ('bullet', 'continuation')").groupBy("answer_id", "section_no", "bullet_no", "code", "comparison").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    claim = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), " "), BULLET, "")
    return rows.withColumn("claim", claim).withColumn("cited", citations(F.col("claim"))).drop("l")


def structure_errors(answers: DataFrame, parsed: DataFrame) -> DataFrame:
    """ANS7: ``answer_id, error``, the first of: unresolved text, standalone text, an empty country section, a requested country without its own section."""
    # lines are read once: first by section, then by answer
    loose = F.min(F.when(F.col("kind") == "unresolved", 1).when(F.col("kind") == "standalone", 2))
    sections = parsed.groupBy("answer_id", "section_no").agg(F.max("code").alias("code"), F.count_if(F.col("kind") == "bullet").alias("bullets"), loose.alias("p"))
    own = F.when(F.col("section_no") > 0, F.col("code"))
    per = sections.groupBy("answer_id").agg(F.min(F.coalesce("p", F.when(own.isNotNull() & (F.col("bullets") == 0), 3))).alias("p"), F.collect_set(own).alias("have"))
    lost = F.size(F.array_except("codes", F.coalesce("have", F.array().cast("array<string>")))) > 0
    found = answers.select("answer_id", "codes").join(per, "answer_id", "left").select("answer_id", F.coalesce("p", F.when(lost, 4)).alias("p")).where("p is not null")
    names = F.array(F.lit("unresolved_content"), F.lit("standalone_text"), F.lit("empty_section"), F.lit("missing_section"))
    return found.select("answer_id", F.get(names, F.col("p") - 1).alias("error"))


def uncited_claims(claims: DataFrame) -> DataFrame:
    """ANS8: ``answer_id, n`` of answers with bullets that cite nothing."""
    return claims.where((F.trim("claim") != "") & (F.size("cited") == 0)).groupBy("answer_id").agg(F.count("*").alias("n"))


def citation_mismatch(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """ANS9 with JN6: bullets of a country section that cite another country's source; numbers without a source and comparisons are left out."""
    cited = claims.where("code is not null and not comparison").select("answer_id", "section_no", "bullet_no", "code", F.explode("cited").alias("citation"))
    return cited.join(sources.select("answer_id", "citation", "country_code"), ["answer_id", "citation"]).where("country_code <> code")


def bullet_limits(answers: DataFrame, parsed: DataFrame) -> DataFrame:
    """ANS10: ``answer_id`` over the limits: six bullets for one country; four for each of several, one comparison of two."""
    per = parsed.where("section_no > 0").groupBy("answer_id", "section_no", "comparison").agg(F.count_if(F.col("kind") == "bullet").alias("b"))
    stats = per.groupBy("answer_id").agg(F.max(F.when(~F.col("comparison"), F.col("b"))).alias("most"), F.count_if("comparison").alias("comparisons"), F.max(F.when(F.col("comparison"), F.col("b"))).alias("compared"))
    rows = answers.select("answer_id", F.size("codes").alias("n")).join(stats, "answer_id")
    one = (F.col("n") <= 1) & (F.col("most") > 6)
    many = (F.col("n") > 1) & ((F.col("most") > 4) | (F.col("comparisons") > 1) | (F.col("compared") > 2))
    return rows.where(F.coalesce(one, F.lit(False)) | F.coalesce(many, F.lit(False))).select("answer_id")


def missing_entities(answers: DataFrame, names: DataFrame) -> DataFrame:
    """ANS11: ``answer_id, code`` of requested codes none of whose names is in the answer, case aside."""
    rows = answers.select("answer_id", F.lower("answer").alias("a"), F.explode("codes").alias("code")).join(small(names.select("code", F.lower("alias").alias("n")).distinct()), "code")
    return rows.groupBy("answer_id", "code").agg(F.bool_or(F.contains("a", "n")).alias("there")).where("not there").select("answer_id", "code")


def repeated_bullets(claims: DataFrame) -> DataFrame:
    """ANS12: ``answer_id, bullet, n`` of bullets that are equal as letters and digits."""
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace("claim", LOOSE, "")), "[^a-z0-9]+", " "))
    return claims.select("answer_id", key.alias("bullet")).where("bullet <> ''").groupBy("answer_id", "bullet").agg(F.count("*").alias("n")).where("n > 1")


def forbidden_phrases(text: Column) -> Column:
    """ANS13: the forbidden phrases in the text; one general entry if only a pattern matches."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(p) for p in V.FORBIDDEN_PHRASES]), lambda p: F.contains(low, p))
    general = X.any_pattern(low, V.FORBIDDEN_PATTERNS)
    return F.when(F.size(found) > 0, found).when(general, F.array(F.lit("internal-mechanism phrasing"))).otherwise(F.array().cast("array<string>"))


def paired_phrase_error(question: Column, answer: Column) -> Column:
    """ANS14: paid leave was asked about and unpaid leave is answered."""
    q = F.lower(question)
    return (F.contains(q, F.lit("paid leave")) | F.contains(q, F.lit("paid time off"))) & F.contains(F.lower(answer), F.lit("unpaid leave"))


def false_absence(answer: Column, context: Column) -> Column:
    """ANS15: the answer says that something is missing while the context holds a concrete duration."""
    return X.any_pattern(F.lower(answer), V.ABSENCE_PATTERNS) & F.coalesce(F.lower(context).rlike(V.DURATION), F.lit(False))


def subject_drift(answers: DataFrame, specs: DataFrame, insufficient: DataFrame) -> DataFrame:
    """ANS16: ``answer_id, spec_idx`` of answers that don't engage the subject of a spec.

    ``specs(answer_id, spec_idx, codes, concepts (array of arrays), evidence_mode)``; specs without mode or concepts
    are not checked, nor are those all of whose codes are in ``insufficient(answer_id, spec_idx, code)``.
    """
    keys = ["answer_id", "spec_idx"]
    own = specs.where(F.col("evidence_mode").isNotNull() & (F.size("concepts") > 0))
    alive = own.select(*keys, F.explode("codes").alias("code")).join(insufficient, [*keys, "code"], "left_anti").select(*keys).distinct()
    own = own.join(alive, keys, "left_semi")
    terms = own.select(*keys, F.posexplode("concepts").alias("group_idx", "g")).select(*keys, "group_idx", F.explode("g").alias("term"))
    bodies = answers.select("answer_id", F.col("answer").alias("body")).join(own.select(*keys), "answer_id")
    said = answer_mentions(bodies, terms, own.select(*keys, F.col("evidence_mode").alias("mode"), F.size("concepts").alias("n_groups")), tuple(keys))
    return said.where("not mentions").select(*keys)


def _dimension(names: DataFrame) -> DataFrame:
    """One row: ``by_code``, the lower-case names of each code, and ``by_label``, the codes of each name. ``names`` is a checked dimension."""
    pairs = small(names.select("code", F.lower("alias").alias("label")).distinct())
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    by_code = pairs.groupBy("code").agg(F.collect_list("label").alias("labels")).agg(entries("code", "labels").alias("by_code"))
    by_label = pairs.groupBy("label").agg(F.collect_list("code").alias("codes")).agg(entries("label", "codes").alias("by_label"))
    return by_code.crossJoin(by_label)


def sections_of(answers: DataFrame) -> DataFrame:
    """``answer_id, loose, sections`` of ``answers(answer_id, answer, codes, by_label)``: whether text is unresolved or standalone, and an array of the sections with ``code, comparison, bullets`` and their ``claims``.

    The rules are those of ``parse_canonical``; lines are dealt by answer once, and one ordered pass over them tells all.
    """
    bare = F.regexp_replace("line", r"^[#*\s]+|[*:\s]+$", "")
    rows = answers.select("answer_id", "codes", "by_label", F.posexplode(F.split("answer", "\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    rows = rows.withColumns({"bullet": F.col("raw").rlike(BULLET), "label": F.lower(bare)})
    rows = rows.withColumn("own", F.array_max(F.array_intersect(F.try_element_at("by_label", F.col("label")), F.col("codes"))))
    head = ~F.col("bullet") & (F.col("own").isNotNull() | (F.col("label") == "comparison"))
    rows = rows.select("answer_id", "line_no", "line", F.col("raw").rlike(r"^\s+\S").alias("indented"), "bullet", head.alias("head"), F.struct("own", (F.col("label") == "comparison").alias("comparison")).alias("h"))
    w = Window.partitionBy("answer_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when, value: F.last(F.when(F.col(when), F.col(value)), ignorenulls=True).over(w)
    rows = rows.select("*", F.sum(F.col("head").cast("int")).over(w).alias("section_no"), F.sum(F.col("bullet").cast("int")).over(w).alias("bullet_no"), last("head", "h").alias("under"), last("head", "line_no").alias("head_at"), last("bullet", "line_no").alias("bullet_at"))
    kind = F.when(F.col("head"), "heading").when(F.col("section_no") == 0, "unresolved").when(F.col("bullet"), "bullet").when(F.col("indented") & (F.col("bullet_at") > F.col("head_at")), "continuation").otherwise("standalone")
    rows = rows.withColumn("kind", kind)
    said = F.col("kind").isin("bullet", "continuation")
    bullets = rows.groupBy("answer_id", "section_no", "bullet_no").agg(
        F.first("under").alias("under"),
        F.bool_or(F.col("kind").isin("unresolved", "standalone")).alias("loose"),
        F.count_if(F.col("kind") == "bullet").alias("bullets"),
        F.array_sort(F.collect_list(F.when(said, F.struct("line_no", "line")))).alias("l"),
    )
    claim = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), " "), BULLET, "")
    bullets = bullets.withColumn("claim", F.when(F.size("l") > 0, claim)).withColumn("claim", F.when(F.col("claim").isNotNull(), F.struct(F.col("claim").alias("text"), citations(F.col("claim")).alias("cited"))))
    sections = bullets.groupBy("answer_id", "section_no").agg(F.first("under").alias("under"), F.bool_or("loose").alias("loose"), F.sum("bullets").alias("bullets"), F.collect_list("claim").alias("claims"))
    one = F.struct(F.col("under.own").alias("code"), F.coalesce("under.comparison", F.lit(False)).alias("comparison"), "bullets", "claims")
    return sections.groupBy("answer_id").agg(F.bool_or("loose").alias("loose"), F.collect_list(F.when(F.col("section_no") > 0, one)).alias("sections"))


def quality_report(answers: DataFrame, sources: DataFrame, names: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """ANS17: ``answer_id, hard, soft, verdict``: sorted error types and ``ok``, ``repair`` or ``accept_soft``.

    ``answers(answer_id, question, answer, codes)``, ``sources(answer_id, citation, country_code, content)``;
    ``drift(answer_id)`` lists subject drift (ANS16). Claims are checked only where the structure is clean. An answer's
    sections and sources become arrays of its row, and every check is an expression over that row.
    """
    per = sources.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("citation", "country_code", "content"))).alias("s"))
    told = answers.select("answer_id", "question", "answer", "codes").crossJoin(F.broadcast(_dimension(names)))
    rows = told.join(per, "answer_id", "left").join(sections_of(told), "answer_id", "left")
    rows = rows.withColumns({"s": F.coalesce("s", F.array().cast(per.schema["s"].dataType)), "loose": F.coalesce("loose", F.lit(False))})
    if drift is not None:
        rows = rows.join(drift.select("answer_id", F.lit(True).alias("drifts")).distinct(), "answer_id", "left")
    secs, codes = F.coalesce("sections", F.array().cast(rows.schema["sections"].dataType)), F.coalesce("codes", F.array().cast("array<string>"))
    rows = rows.withColumn("sections", secs).withColumn("codes", codes)

    def most(of: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter("sections", lambda x: x["comparison"] == of), lambda x: x["bullets"])), F.lit(0))

    def mismatch(section: Column) -> Column:
        foreign = lambda n: F.exists("s", lambda s: (s["citation"] == n) & (s["country_code"] != section["code"]))
        return section["code"].isNotNull() & ~section["comparison"] & F.exists(section["claims"], lambda c: F.exists(c["cited"], lambda n: F.coalesce(foreign(n), F.lit(False))))

    low = F.lower("answer")
    unnamed = F.exists("codes", lambda c: X.let(F.try_element_at("by_code", c), lambda n: n.isNotNull() & ~F.exists(n, lambda x: F.contains(low, x))))
    claims = F.flatten(F.transform("sections", lambda x: x["claims"]))
    plain = F.filter(F.transform(claims, lambda c: F.trim(F.regexp_replace(F.lower(F.regexp_replace(c["text"], LOOSE, "")), "[^a-z0-9]+", " "))), lambda k: k != "")
    broken = F.col("loose") | F.exists("sections", lambda x: x["code"].isNotNull() & (x["bullets"] == 0)) | (F.size(F.array_except("codes", F.transform("sections", lambda x: x["code"]))) > 0)
    context = F.array_join(F.transform("s", lambda x: x["content"]), "\n")
    rows = rows.withColumn("broken", broken)
    sound, n = ~F.col("broken"), F.size("codes")
    over = F.when(n <= 1, most(F.lit(False)) > 6).otherwise((most(F.lit(False)) > 4) | (F.size(F.filter("sections", lambda x: x["comparison"])) > 1) | (most(F.lit(True)) > 2))
    flags = {
        "citation_format": citation_format_error(F.col("answer")),
        "citation_range": citation_range_error(F.col("answer"), F.size("s")),
        "internal_reference": F.size(forbidden_phrases(F.col("answer"))) > 0,
        "paid_leave_scope": paired_phrase_error(F.col("question"), F.col("answer")),
        "false_absence_claim": false_absence(F.col("answer"), context),
        "structure": F.col("broken"),
        "uncited_claims": sound & F.exists(claims, lambda c: (F.trim(c["text"]) != "") & (F.size(c["cited"]) == 0)),
        "citation_entity_mismatch": sound & F.exists("sections", mismatch),
        "bullet_limits": over,
        "missing_entities": unnamed,
        "repeated_bullets": sound & X.let(plain, lambda k: F.size(k) > F.size(F.array_distinct(k))),
        **({"subject_drift": F.col("drifts")} if drift is not None else {}),
    }
    found = rows.select("answer_id", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()])).alias("e"))
    pick = lambda names: F.array_sort(F.array_intersect("e", F.array(*[F.lit(n) for n in names])))
    out = found.select("answer_id", pick(HARD).alias("hard"), pick(SOFT).alias("soft"), pick(REPAIRED_SOFT).alias("r"))
    verdict = F.when((F.size("hard") > 0) | (F.size("r") > 0), "repair").when(F.size("soft") > 0, "accept_soft").otherwise("ok")
    return out.select("answer_id", "hard", "soft", verdict.alias("verdict"))


def choose_attempt(first: DataFrame, second: DataFrame) -> DataFrame:
    """ANS17: ``answer_id, chosen``: the repaired answer if it has no hard error, else the first if it had none, else ``failed``."""
    rows = first.select("answer_id", F.size("hard").alias("a")).join(second.select("answer_id", F.size("hard").alias("b")), "answer_id", "left")
    return rows.select("answer_id", F.when(F.col("b") == 0, "second").when(F.col("a") == 0, "first").otherwise("failed").alias("chosen"))


def context_text(hits: DataFrame) -> DataFrame:
    """ANS18: ``query_id, context``: numbered source blocks in order of position."""
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]")), F.concat_ws(" | ", "country_code", "legal_topic", "subsection"), "excerpt")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["b"]), "\n\n").alias("context"))


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """ANS18: the cited hits in citation order."""
    return extract_citations(answers).join(sources, ["answer_id", "citation"])


def contact_section(queries: DataFrame, contacts: DataFrame) -> DataFrame:
    """ANS19: ``queries(query_id, country_codes, offset)``: per code in order its contact text with a citation number counting on from ``offset``, or not found."""
    asked = queries.select("query_id", "offset", F.posexplode("country_codes").alias("i", "country_code"))
    rows = asked.join(contacts.select("country_code", "content"), "country_code", "left")
    w = Window.partitionBy("query_id").orderBy("i", "content").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("content").isNotNull().cast("int")).over(w)
    return rows.select("query_id", "i", "country_code", F.when(F.col("content").isNotNull(), F.col("offset") + n).alias("citation"), "content", F.col("content").isNotNull().alias("found"))


def merge_action_scopes(actions: DataFrame, explicit_topics: DataFrame, valid: list[str]) -> DataFrame:
    """ANS20: per query the ordered union of codes and topics over its actions; explicit topics replace them, unknown topics go."""
    per = actions.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("action_idx", "codes", "topics"))).alias("a"))
    merged = per.select("query_id", F.array_distinct(F.flatten(F.transform("a", lambda x: x["codes"]))).alias("codes"), F.array_distinct(F.flatten(F.transform("a", lambda x: x["topics"]))).alias("t"))
    rows = merged.join(explicit_topics.select("query_id", F.col("topics").alias("e")), "query_id", "left")
    chosen = F.when(F.size(F.coalesce("e", F.array().cast("array<string>"))) > 0, F.col("e")).otherwise(F.col("t"))
    return rows.select("query_id", "codes", F.array_intersect(chosen, F.array(*[F.lit(v) for v in valid])).alias("topics"))


def dense_renumber(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """RNK19: citation ids of an answer as 1..n in source order; untouched if an id repeats, is not positive, or a citation is unknown.

    ``sources(answer_id, source_order, citation)``.
    """
    per = sources.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("source_order", "citation"))).alias("s")).select("answer_id", F.transform("s", lambda x: x["citation"].cast("int")).alias("ids"))
    rows = answers.join(per, "answer_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    bad = (F.size(F.array_distinct("ids")) < F.size("ids")) | F.exists("ids", lambda i: i < 1) | (F.size(F.array_except(citations(F.col("answer")), F.col("ids"))) > 0)
    parts, groups = F.split("answer", STRICT, -1), F.regexp_extract_all("answer", F.lit(STRICT), F.lit(0))
    number = lambda g: F.concat(F.lit("["), F.array_join(F.transform(F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0)), lambda n: F.array_position("ids", n.cast("int")).cast("string")), ", "), F.lit("]"))
    new = X.let(F.transform(groups, number), lambda gs: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(gs, i), F.lit("")))), ""))
    return rows.select("answer_id", F.when(bad, F.col("answer")).otherwise(new).alias("answer"), (~bad).alias("renumbered"))
