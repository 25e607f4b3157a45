"""Detection, evidence and conversation jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import values as V
from lectern.operators import detect, evidence, turns
from lectern.operators.select import merge_codes
from lectern.plans import inputs as I
from lectern.sources import dims
from lectern.sources.corpus import spread
from lectern.sources.dims import small
from lectern.sources.store import cut

# An inline dictionary of words that occur in the tables: code and alias in the form of `ascii_words`.
ALIASES = (("EN", "the"), ("EN", "of the"), ("FR", "la"), ("FR", "de la"), ("DE", "und"), ("ES", "el"), ("ES", "de"), ("IT", "in"))
RULES = (("tion", "Topic T", 0), ("heit", "Topic H", 100), ("the th", "Topic W", 200), ("eau", "Topic E", 300), ("eau", "Topic T", 301), ("corr", "Topic C", 400))
CONCEPTS = (("of the", "the and"), ("in", "la", "die"))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES), "code string, alias_words string")


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "phrase string, topic string, rank int")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return I.turns(spark, d).withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect_entities(_keyed(spark, d), _aliases(spark)).select("text_id", F.array_join("codes", ",").alias("codes"))


def entity_availability(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_entities(_keyed(spark, d), _aliases(spark))
    rows = found.withColumn("explicit_codes", F.when(F.col("text_id") % 4 == 0, F.array(F.lit("XX"), F.lit("FR"))))
    catalog = I.table(spark, d, "documents").select(F.upper("lang").alias("code")).distinct()
    out = detect.split_availability(rows, catalog)
    return out.select("text_id", F.array_join("available", ",").alias("available"), F.array_join("unavailable", ",").alias("unavailable"))


def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect_topics(_keyed(spark, d), _rules(spark)).select("text_id", F.array_join("topics", ",").alias("topics"))


def scope_support(spark: SparkSession, d: str) -> DataFrame:
    t = _keyed(spark, d)
    rows = t.join(detect.detect_topics(t, _rules(spark)), "text_id", "left")
    explicit = F.when(F.col("text_id") % 5 == 0, F.array(F.lit("Given")))
    topics, supported = detect.resolve_scope(explicit, F.col("topics"), F.array().cast("array<string>"), F.col("text"))
    return rows.select("text_id", F.array_join(topics, ",").alias("topics"), supported.alias("supported"))


#: Fixed wordings that stand beside the tables' own texts, so that every rule has something to find.
_ONLY = ("What about Peru?", "For the Ireland", "Overtime in Peru?", "Peru", "Irish and Peru", "Peruvian")
_TEXTS = (
    "Hello!", "Thanks for your help", "What countries do you cover?", "can you do comparisons too", "Which topics can you explain", "who are you?", "A ok", "Bye", "give me the email of a law firm", "Should I sue?", "How can I contact you",
    "compare Spain and Peru", "What's this bot", "something else entirely", "Find us a lawyer.", "What is the website of the law firm?", "show me the Madrid office phone number", "show me his office phone number", "I need a lawyer's opinion", "could you find me a law firm contact in Peru",
)
_SAME = ("same for Peru", "Give me the same information for Peru", "and do the same in Peru?", "overtime in Peru", "Peru", "the same")


def _beside(spark: SparkSession, d: str, wordings: tuple[str, ...]) -> DataFrame:
    """``text_id, text``: every turn's own text, and for each turn one of some fixed wordings under the id's negative."""
    own = _keyed(spark, d).select("text_id", "text")
    pick = F.get(F.array(*[F.lit(t) for t in wordings]), (F.col("text_id") % len(wordings)).cast("int"))
    return own.unionByName(own.select((-1 - F.col("text_id")).alias("text_id"), pick.alias("text")))


def entity_only(spark: SparkSession, d: str) -> DataFrame:
    rows = _beside(spark, d, _ONLY)
    return rows.select("text_id", F.array_join(detect.entity_only(F.col("text"), F.array(F.lit("PE"), F.lit("IE")), F.array(F.lit("Peru"), F.lit("Ireland"), F.lit("Irish"))), ",").alias("only"))


def intent_labels(spark: SparkSession, d: str) -> DataFrame:
    return _beside(spark, d, _TEXTS).select("text_id", detect.intent_label(F.col("text")).alias("intent"))


def signal_flags(spark: SparkSession, d: str) -> DataFrame:
    return _beside(spark, d, _TEXTS).select("text_id", *[c.alias(n) for n, c in detect.signal_flags(F.col("text")).items()])


def turn_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("text_id")
    codes = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    topics = F.when(k % 3 == 0, F.array(F.lit("T"))).otherwise(F.array().cast("array<string>"))
    return _keyed(spark, d).select("text_id", detect.route_turn(codes, topics, k % 2 == 0, k % 5 == 0, k % 7 == 0).alias("route"))


def turn_hints(spark: SparkSession, d: str) -> DataFrame:
    h = detect.hints(I.turns(spark, d), _aliases(spark), _rules(spark))
    return h.select("conv_id", "turn", *[F.array_join(c, ",").alias(c) for c in ("codes", "topics", "recent_codes", "recent_topics")])


def _misspelt(spark: SparkSession, d: str) -> DataFrame:
    """A supported name for each customer, one of its letters left out."""
    names = spark.createDataFrame([(i, name) for i, (_, name, _) in enumerate(V.ENTITIES)], "k int, name string")
    c = spread(I.table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("text_id"), (F.col("c_custkey") % len(V.ENTITIES)).cast("int").alias("k"))
    word = F.expr("concat(substring(name, 1, cast(text_id % length(name) as int)), substring(name, cast(text_id % length(name) as int) + 2))")
    return c.join(F.broadcast(names), "k").select("text_id", word.alias("fragment"))


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    return detect.suggest_entity(_misspelt(spark, d), dims.entity_names(spark)).select("text_id", "code", F.round("ratio", 6).alias("ratio"))


def fuzzy_names_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return detect.suggest_entity(_misspelt(spark, d), dims.entity_names(spark), exact=False).select("text_id", "code", F.round("ratio", 6).alias("ratio"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    n = F.initcap(F.lower("n_name"))
    k = F.col("c_custkey")
    frames = F.array(F.concat(F.lit("notice rules in "), n), F.concat(n, F.lit("'s notice rules")), F.concat(n, F.lit(": overtime")), F.concat(F.lit("In the "), n, F.lit(", paid leave")), F.concat(F.lit("differences between "), n, F.lit(" and "), n), n, F.concat(F.lit("severance under "), n, F.lit("ian law")), F.lit("inland notice"))
    customers = spread(I.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rows = customers.join(F.broadcast(I.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(k.alias("subject_id"), F.get(frames, (k % 8).cast("int")).alias("subject_text"), F.array(F.array(F.concat(F.lit("pay in "), n), F.lit("Pay"), n), F.array(n)).alias("concepts"), F.array(n).alias("names"), F.array(F.concat(n, F.lit("ian"))).alias("demonyms"), n.alias("n"))


def strip_scope(spark: SparkSession, d: str) -> DataFrame:
    s = detect.canonicalize_subjects(_subjects(spark, d))
    return s.select("subject_id", "subject_out", "changed", "became_empty", F.array_join(F.flatten("concepts_out"), "|").alias("terms"))


def lost_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Requests one of whose actions is left without a subject once its frames are gone."""
    s = detect.canonicalize_subjects(_subjects(spark, d))
    acts = s.select(F.floor(F.col("subject_id") / 4).alias("query_id"), F.when(F.col("subject_id") % 3 == 0, "contact").otherwise("information").alias("type"), "became_empty")
    return detect.missing_subject(acts)


def removed_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The codes that the subjects name: nations, and one that stands in none of them."""
    n = F.col("n")
    scope = F.array(F.struct(F.lit("n1").alias("code"), F.array(n, F.concat(n, F.lit("ian"))).alias("names")), F.struct(F.lit("ZZ").alias("code"), F.array(F.lit("Inland Empire")).alias("names")))
    s = detect.canonicalize_subjects(_subjects(spark, d).withColumn("scope", scope))
    return s.select("subject_id", F.array_join("removed", ",").alias("removed"))


def merged_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each user turn in front of those of its recent questions, cut to three."""
    h = detect.hints(I.turns(spark, d), _aliases(spark), _rules(spark))
    return h.select("conv_id", "turn", F.array_join(merge_codes(F.col("codes"), F.col("recent_codes"), 3), ",").alias("merged"))


def subject_modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast("array<array<string>>")
    concepts = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.array(F.lit("overtime pay")))).otherwise(F.array(F.array(F.lit("a")), F.array(F.lit("b"))))
    mode = detect.subject_precision(F.when(k % 11 == 0, "broad_topic"), F.when(k % 7 == 0, "contact").otherwise("information"), concepts, F.array(F.lit("Working Time")), k % 2 == 0)
    return I.table(spark, d, "customer").select(k.alias("id"), mode.alias("mode"))


# ---- evidence ------------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a hit: dealt to the queries by its id."""
    q = I.queries(spark, d).select("query_id")
    n = F.lit(max(q.count(), 1))
    dealt = q.withColumn("_r", F.pmod("query_id", n))
    return I.chunks(spark, d).withColumn("_r", F.pmod("chunk_id", n)).join(small(dealt), "_r").drop("_r")


def concept_positions(spark: SparkSession, d: str) -> DataFrame:
    at = _positions(spark, d)
    return at.groupBy("query_id", "chunk_id", "group_idx").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    pairs = [(g, t) for g, terms in enumerate(CONCEPTS) for t in terms]
    arr = F.array(*[F.struct(F.lit(g).alias("group_idx"), F.lit(t).alias("term")) for g, t in pairs])
    return I.queries(spark, d).select("query_id", F.explode(arr).alias("t")).select("query_id", "t.group_idx", "t.term")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).select("query_id", "chunk_id", F.col("content").alias("body"))
    return evidence.concept_positions(hits, _terms(spark, d), ["query_id", "chunk_id"])


def relation_proximity(spark: SparkSession, d: str) -> DataFrame:
    groups = I.queries(spark, d).select("query_id", F.lit(len(CONCEPTS)).alias("n_groups"))
    hits = _hits(spark, d).select("query_id", "chunk_id", F.col("content").alias("body"))
    return evidence.relation_hits(evidence.concept_places(hits, _terms(spark, d), ["query_id", "chunk_id"]), groups, ["query_id", "chunk_id"], 6)


def subject_overlap(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).join(I.queries(spark, d), "query_id")
    return hits.select("query_id", "chunk_id", evidence.subject_overlap(F.col("query"), F.col("content")).alias("overlap"))


def _specs(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_id")
    concepts = F.array(*[F.array(*[F.lit(t) for t in g]) for g in CONCEPTS])
    return I.queries(spark, d).select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("spec_idx"), "query").select(
        "query_id", "spec_idx", F.array(F.lit("SRC0"), F.lit("SRC5"), F.lit("SRC9")).alias("codes"), F.when(q % 2 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array().cast("array<string>")).alias("topics"),
        F.col("query").alias("subject_text"), F.when(q % 3 == 0, concepts).otherwise(F.array().cast("array<array<string>>")).alias("concepts"), F.when((q % 5 == 0) & (F.col("spec_idx") == 1), "broad_topic").alias("evidence_mode"),
    )


def evidence_grade(spark: SparkSession, d: str) -> DataFrame:
    return evidence.grade_evidence(_specs(spark, d), _hits(spark, d))


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    # read three times below
    grades = cut(evidence.grade_evidence(_specs(spark, d), _hits(spark, d)), "grades")
    kept, keys, out = evidence.gate_hits(_specs(spark, d), _hits(spark, d).withColumn("rank", F.col("chunk_id")), grades)
    a = kept.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit("kept").alias("what"), "n")
    b = keys.groupBy("query_id").agg(F.countDistinct("key").alias("n")).select("query_id", F.lit("keys").alias("what"), "n")
    return a.unionByName(b).unionByName(out.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit("excluded").alias("what"), "n"))


# ---- conversations -------------------------------------------------------------------------------------------------


def history_violations(spark: SparkSession, d: str) -> DataFrame:
    return turns.validate_history(I.turns(spark, d), 6, 1500, 4000)


def action_violations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") + F.col("conv_id")
    t = I.turns(spark, d)
    acts = t.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("action_idx"), F.when(k % 13 == 0, "clarify").otherwise("resolved").alias("status"), F.when(k % 3 == 0, "contact").when(k % 3 == 1, "comparison").otherwise("information").alias("type"),
        F.when(k % 4 == 0, F.array(F.lit("AA"))).otherwise(F.array(F.lit("AA"), F.lit("BB"))).alias("codes"), F.when(k % 5 == 0, F.array(F.lit("odd"))).when(k % 5 == 1, F.array(F.lit("alpha"))).otherwise(F.array().cast("array<string>")).alias("topics"),
        F.when(k % 2 == 0, "subject").alias("subject_text"), F.array().cast("array<array<string>>").alias("concepts"),
    )
    return turns.validate_actions(acts, ["AA", "BB"], I.FIVE).groupBy("violation").agg(F.count("*").alias("n"))


def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    h = turns.bounded_history(I.turns(spark, d), 100, 400, 900, 6)
    return h.select("conv_id", "turn", F.length("question").alias("q"), F.length("answer").alias("a"))


def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    return turns.recent_questions(I.turns(spark, d)).select("conv_id", "turn", F.sha2(F.array_join("recent", "|"), 256).alias("digest"))


def _operations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn")
    c = F.col("conv_id")
    op = F.when(k == 0, F.lit(None)).when((k + c) % 6 == 0, "ambiguous").when((k + c) % 4 == 1, "add_country").when((k + c) % 4 == 2, "replace_country").otherwise("continue")
    codes = F.when((k + c) % 3 == 0, F.array(F.lit("A"))).when((k + c) % 3 == 1, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array().cast("array<string>"))
    return I.turns(spark, d).select("conv_id", "turn", op.alias("operation"), F.lit("information").alias("type"), codes.alias("codes"), F.when((k + c) % 5 < 2, F.concat(F.lit("s"), k.cast("string"))).alias("subject"))


def carry_context(spark: SparkSession, d: str) -> DataFrame:
    rows = turns.carry_context(_operations(spark, d))
    return rows.select("conv_id", "turn", "resolution", "type", F.array_join("codes", ",").alias("codes"), "subject", "reason")


def last_context(spark: SparkSession, d: str) -> DataFrame:
    rows = turns.last_context(_operations(spark, d))
    return rows.select("conv_id", "turn", F.array_join("context_codes", ",").alias("codes"), F.col("context_subject").alias("subject"))


def next_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") + F.col("conv_id")
    ex = I.turns(spark, d).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("action_idx"), F.when(k % 2 == 0, "comparison").otherwise("information").alias("type"), F.array(F.concat(F.lit("C"), (k % 4).cast("string")), F.lit("Z")).alias("codes"), F.when(k % 3 == 0, F.array(F.lit("C9"))).otherwise(F.array(F.lit("C0"), F.lit("C1"), F.lit("C2"))).alias("available"), F.when(F.col("conv_id") % 9 == 0, "which").alias("clarification"))
    s = turns.next_state(ex)
    return s.select("query_id", F.size("actions").alias("actions"), F.coalesce("focus", F.lit(-1)).alias("focus"), F.array_join("ordered_codes", ",").alias("codes"), "pending")


def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return I.table(spark, d, "documents").select("doc_id", F.sha2(X.squash_ws(t), 256).alias("squashed"), F.sha2(X.ascii_words(t), 256).alias("words"), F.size(X.evidence_tokens(t)).alias("tokens"))


def heading_entities(spark: SparkSession, d: str) -> DataFrame:
    """Headings made from one or two nation names, against three requested codes each."""
    n = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = I.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 25).alias("k"), ((F.col("c_custkey") * 7 + 1) % 25).alias("k2"))
    two = c.join(F.broadcast(n), "k").join(F.broadcast(n.select(F.col("k").alias("k2"), F.col("n_name").alias("other"))), "k2")
    code = lambda key: F.concat(F.lit("N"), F.col(key).cast("string"))
    heads = two.select("c_custkey", F.concat(F.lit("Rules in "), "n_name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" and "), "other")).otherwise("")).alias("heading"), F.array(code("k"), code("k2"), F.lit("N24")).alias("codes"))
    dim = n.select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("code"), X.ascii_words(F.col("n_name")).alias("alias_words"))
    return dims.heading_entity(heads, F.col("heading"), "codes", dim, "c_custkey").select("c_custkey", "entity_code")


def filter_conflicts(spark: SparkSession, d: str) -> DataFrame:
    from lectern.operators.search import filter_conflict

    k = F.col("text_id")
    explicit = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B")))
    action = F.when(k % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("C")))
    return _keyed(spark, d).select("text_id", filter_conflict(explicit, action).alias("conflict"))


def answer_mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.col("text").alias("body"))
    pairs = F.array(*[F.struct(F.lit(g).alias("group_idx"), F.lit(t).alias("term")) for g, terms in enumerate(CONCEPTS) for t in terms])
    terms = docs.select("answer_id", F.explode(pairs).alias("t")).select("answer_id", "t.group_idx", "t.term")
    k = F.col("answer_id")
    modes = docs.select("answer_id", F.when(k % 3 == 0, "broad_topic").when(k % 3 == 1, "relation_required").otherwise("direct_topic").alias("mode"), F.lit(2).alias("n_groups"))
    return evidence.answer_mentions(docs, terms, modes)


def same_subjects(spark: SparkSession, d: str) -> DataFrame:
    codes = F.when(F.col("text_id") % 5 == 0, F.array(F.lit("PE"), F.lit("ES"))).otherwise(F.array(F.lit("PE")))
    return _beside(spark, d, _SAME).select("text_id", turns.same_subject(F.col("text"), codes, F.array(F.lit("Peru"))).alias("same"))


def local_followups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") + F.col("conv_id")
    t = I.turns(spark, d)
    now = t.select("conv_id", "turn", F.when(k % 2 == 0, F.when(k % 4 == 0, F.array(F.lit("PE"))).otherwise(F.array(F.lit("PE"), F.lit("ES")))).alias("only_codes"))
    before = t.select("conv_id", "turn", F.when(k % 3 == 0, F.array(F.lit("comparison"))).when(k % 3 == 1, F.array(F.lit("information"))).otherwise(F.array(F.lit("contact"), F.lit("information"))).alias("types"), F.lit("s").alias("subject"))
    return turns.local_followup(now, before).select("conv_id", "turn", "operation", "type", F.array_join("codes", ",").alias("codes"), "subject")


QUERIES = {f.__name__: f for f in (normalised_texts, heading_entities, filter_conflicts, answer_mentions, same_subjects, local_followups, entity_mentions, entity_availability, topic_labels, scope_support, entity_only, intent_labels, signal_flags, turn_routes, turn_hints, fuzzy_names, fuzzy_names_levenshtein, strip_scope, lost_subjects, removed_scopes, merged_codes, subject_modes, concept_positions, relation_proximity, subject_overlap, evidence_grade, evidence_gate, history_violations, action_violations, bounded_history, recent_questions, carry_context, last_context, next_states)}

W = "WITH "
_ACC = "'" + "".join(c for c in X._LATIN if ord(c) < 0x100) + "', '" + "".join(X._LATIN[c] for c in X._LATIN if ord(c) < 0x100) + "'"
_ASCII = "trim(lower(regexp_replace(translate({t}, " + _ACC + "), '[^0-9A-Za-z]+', ' ', 'g')))"
_KEYED = "k AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS text_id, " + _ASCII.format(t="text") + " AS w FROM conversations)"
_AL = "al AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in ALIASES) + ") v(code, alias))"
_RU = "ru AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', {r})" for p, t, r in RULES) + ") v(phrase, topic, rank))"


def _entities(src: str, key: str, words: str = "w") -> str:
    """Entities by word position, then longest alias; the position is the number of words before the alias."""
    return f"""SELECT {key}, list(code ORDER BY pos, neg, code) AS codes FROM (SELECT {key}, code, min(pos) AS pos, arg_min(neg, pos * 1000 + neg) AS neg FROM (
      SELECT {key}, code, -length(alias) AS neg, len(string_split(substr({words} || ' ', 1, strpos(' ' || {words} || ' ', ' ' || alias || ' ')), ' ')) AS pos FROM {src}, al WHERE contains(' ' || {words} || ' ', ' ' || alias || ' ')) GROUP BY {key}, code) GROUP BY {key}"""


def _topics(src: str, key: str, words: str = "w") -> str:
    return f"SELECT {key}, list(topic ORDER BY rank, topic) AS topics FROM (SELECT {key}, topic, min(rank) AS rank FROM {src}, ru WHERE contains({words}, phrase) GROUP BY {key}, topic) GROUP BY {key}"




def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strings(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


def _replaced(column: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, {_quote(pattern)}, {_quote(to)}, 'g')"
    return column


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_quote(p)})" for p in patterns) + ")"


def _beside_sql(wordings: tuple[str, ...]) -> str:
    """The rows of ``_beside`` as table x."""
    own = "SELECT conv_id * 1000 + turn AS text_id, text FROM conversations"
    return f"own AS ({own}), x AS (SELECT text_id, text FROM own UNION ALL SELECT -1 - text_id, ({_strings(wordings)})[text_id % {len(wordings)} + 1] FROM own)"


_CHAT = "trim(" + _replaced("translate(translate(lower(text), " + _ACC + "), '’', '''')", ((r"\bwhitch\b", "which"), (r"\bu\b", "you"), (r"\bwhats\b", "what is"), (r"[^a-z0-9' ]+", " "), ("'", " "), (r"\bthat\s+s\b", "thats"), (r"\bi\s+m\b", "im"), (r"\s+", " "))) + ")"
_HELP = _replaced("trim(" + _replaced("t", ((r"\b(?:whats|what's)\b", "what is"), (r"\b(?:cant|can't)\b", "cannot"), (r"[^\w\s']", " "), ("'", " "), (r"\s+", " "))) + ")", ((r"\bu\b", "you"),))
_INTENT = " ".join(
    [
        *[f"WHEN t IN ({', '.join(map(_quote, phrases))}) THEN '{name}'" for name, phrases in V.INTENT_PHRASES],
        *[f"WHEN {_any('t', patterns)} THEN '{name}'" for name, patterns in V.INTENT_FULL_PATTERNS],
        *[f"WHEN {_any('h', patterns)} THEN '{name}'" for name, patterns in V.INTENT_SEARCH_PATTERNS],
        *["WHEN " + " AND ".join(f"list_has_any(string_split(h, ' '), {_strings(words)})" for words in sets) + f" THEN '{name}'" for name, sets in V.INTENT_WORD_SETS],
    ]
)


def _words_of(phrases) -> str:
    return "(?:" + "|".join(p.replace(" ", r"\s+") for p in sorted(phrases, key=len, reverse=True)) + ")"


# Contact requests as patterns without look-around: the characters around a match are taken into it.
_B, _E, _ART, _TGT, _DAT = r"(?:^|[^a-z0-9_])", r"\s*(?:[.?!]|$|\s(?:" + "|".join(V.PLACE_WORDS) + r")(?:$|[^a-z0-9_]))", r"\s+(?:an?\s+|the\s+)?", _words_of(V.CONTACT_TARGETS), _words_of(V.CONTACT_DATA)
_OFFICE = r"offices?\s+" + _words_of(V.OFFICE_DATA) + r"\s*[?.!]*$"
_CONTACT = (
    _B + _words_of(V.CONTACT_SEARCHES) + _ART + _TGT + _E,
    _B + _words_of(V.CONTACT_ASKS) + _ART + _DAT + r"\s+(?:of|for)" + _ART + _TGT + r"(?:$|[^a-z0-9_'])",
    r"^\s*what\s+is\s+the\s+" + _DAT + r"\s+(?:of|for)" + _ART + _TGT + r"(?:\s+(?:in|for)(?:\s+[a-z0-9_]+)+)?\s*[?.!]*$",
    _B + _words_of(V.CONTACT_NOUN_ASKS) + r"(?:\s+me|\s+us)?" + _ART + _TGT + r"\s+contacts?" + _E,
)
_ASKED_OFFICE = _B + _words_of(V.CONTACT_ASKS) + r"[^a-z0-9_](?:.*[^a-z0-9_])?" + _OFFICE
_OWN_OFFICE = r"(?:'s|s'|" + "|".join(V.POSSESSIVES) + r")\s+" + _OFFICE
_EVW = "regexp_extract_all(lower(translate(regexp_replace(replace({t}, 'ß', 'ss'), '([À-ɏ])', '\\1 ', 'g'), " + _ACC + ")), '[a-z0-9]+')"
_HITS = I.CHUNKS_SQL + ", " + I.QUERIES_SQL + ", hits AS (SELECT c.*, q.query_id FROM chunks c JOIN queries q ON c.chunk_id % (SELECT count(*) FROM queries) = q.query_id % (SELECT count(*) FROM queries))"
_POS = _HITS + ", hw AS (SELECT query_id, chunk_id, " + _EVW.format(t="content") + " AS w FROM hits), hp AS (SELECT query_id, chunk_id, unnest(range(1, len(w) + 1)) AS i, w FROM hw), hg AS (SELECT query_id, chunk_id, i - 1 AS pos, w[i] AS g1, w[i] || ' ' || w[i + 1] AS g2 FROM hp), found AS (SELECT query_id, chunk_id, pos, 0 AS grp FROM hg WHERE g2 IN ('of the', 'the and') UNION SELECT query_id, chunk_id, pos, 1 FROM hg WHERE g1 IN ('in', 'la', 'die'))"
_FRAME = "(" + ", ".join(f"'{w}'" for w in sorted(set(__import__("lectern.functions.values", fromlist=["FRAMING_WORDS"]).FRAMING_WORDS))) + ")"
_SIG = "list_filter({w}, lambda w: length(w) > 2 AND w NOT IN " + _FRAME + ")"
# The grade of each spec and country; q8 holds the query's words.
_GRADE = _HITS + """,
 hw AS (SELECT query_id, chunk_id, country_code, legal_topic, """ + _EVW.format(t="coalesce(subsection || ' ', '') || content") + """ AS w FROM hits WHERE country_code IN ('SRC0', 'SRC5', 'SRC9')),
 q AS (SELECT query_id, """ + _EVW.format(t="array_to_string(words, ' ')") + """ AS s FROM queries),
 hp AS (SELECT query_id, chunk_id, unnest(range(1, len(w) + 1)) AS i, w FROM hw), hg AS (SELECT query_id, chunk_id, i AS pos, w[i] AS g1, w[i] || ' ' || w[i + 1] AS g2 FROM hp),
 found AS (SELECT query_id, chunk_id, pos, 0 AS grp FROM hg WHERE g2 IN ('of the', 'the and') UNION SELECT query_id, chunk_id, pos, 1 FROM hg WHERE g1 IN ('in', 'la', 'die')),
 rel AS (SELECT DISTINCT a.query_id, a.chunk_id FROM found a JOIN found b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND a.grp = 0 AND b.grp = 1 AND abs(a.pos - b.pos) <= 40),
 f AS (SELECT h.query_id, h.chunk_id, h.country_code AS code, CASE WHEN h.query_id % 3 = 0 THEN EXISTS (SELECT 1 FROM found WHERE found.query_id = h.query_id AND found.chunk_id = h.chunk_id) ELSE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(s, ' ') || ' ') END AS any_concept,
   EXISTS (SELECT 1 FROM rel WHERE rel.query_id = h.query_id AND rel.chunk_id = h.chunk_id) AS relation,
   len(""" + _SIG.format(w="s") + """) > 0 AND len(list_filter(""" + _SIG.format(w="s") + """, lambda x: list_contains(w, x))) >= greatest(1, (len(""" + _SIG.format(w="s") + """) + 1) // 2) AS overlap
   FROM hw h JOIN q USING (query_id) WHERE h.query_id % 2 = 1 OR coalesce(h.legal_topic IN ('alpha', 'beta'), false)),
 p AS (SELECT query_id, code, count(*) AS n, bool_or(any_concept) AS c, bool_or(relation) AS r, bool_or(overlap) AS o FROM f GROUP BY query_id, code),
 g AS (SELECT query_id, spec_idx, code, CASE WHEN n IS NULL THEN 'insufficient' WHEN query_id % 5 = 0 AND spec_idx = 1 THEN 'direct' WHEN query_id % 3 = 0 THEN CASE WHEN r THEN 'direct' WHEN c OR o THEN 'partial' ELSE 'insufficient' END WHEN c THEN 'direct' WHEN o THEN 'partial' ELSE 'insufficient' END AS status
  FROM (SELECT query_id, unnest([0, 1]) AS spec_idx FROM queries) s CROSS JOIN (SELECT unnest(['SRC0', 'SRC5', 'SRC9']) AS code) LEFT JOIN p USING (query_id, code))"""
_NAMES = "al AS (SELECT *, " + _ASCII.format(t="alias") + " AS n FROM (VALUES " + ", ".join(f"({i}, '{c}', {_quote(n)}, {_quote(a)})" for i, (c, n, more) in enumerate(V.ENTITIES) for a in (n, *more)) + ") v(k, code, name, alias))"
_OPS = """ops AS (SELECT conv_id, turn, turn + conv_id AS k, CASE WHEN turn = 0 THEN NULL WHEN (turn + conv_id) % 6 = 0 THEN 'ambiguous' WHEN (turn + conv_id) % 4 = 1 THEN 'add_country' WHEN (turn + conv_id) % 4 = 2 THEN 'replace_country' ELSE 'continue' END AS op,
  CASE (turn + conv_id) % 3 WHEN 0 THEN ['A'] WHEN 1 THEN ['B', 'A'] ELSE [] END AS codes, CASE WHEN (turn + conv_id) % 5 < 2 THEN 's' || CAST(turn AS VARCHAR) END AS subject FROM conversations)"""

ORACLE_SQL = {
    "entity_mentions": W + _KEYED + ", " + _AL + ", e AS (" + _entities("k", "text_id") + ") SELECT text_id, array_to_string(codes, ',') AS codes FROM e",
    "entity_availability": W + _KEYED + ", " + _AL + ", e AS (" + _entities("k", "text_id") + "), u AS (SELECT text_id, CASE WHEN text_id % 4 = 0 THEN ['XX', 'FR'] ELSE codes END AS c FROM e), cat AS (SELECT list(DISTINCT upper(lang)) AS l FROM documents) SELECT text_id, array_to_string(list_filter(c, lambda x: list_contains(l, x)), ',') AS available, array_to_string(list_filter(c, lambda x: NOT list_contains(l, x)), ',') AS unavailable FROM u, cat",
    "topic_labels": W + _KEYED + ", " + _RU + ", t AS (" + _topics("k", "text_id") + ") SELECT text_id, array_to_string(topics, ',') AS topics FROM t",
    "scope_support": W + _KEYED + ", " + _RU + ", t AS (" + _topics("k", "text_id") + ") SELECT k.text_id, CASE WHEN k.text_id % 5 = 0 THEN 'Given' ELSE coalesce(array_to_string(topics, ','), '') END AS topics, k.text_id % 5 = 0 OR topics IS NOT NULL AS supported FROM k LEFT JOIN t USING (text_id)",
    "entity_only": W + _beside_sql(_ONLY) + f" SELECT text_id, CASE WHEN len(list_filter(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda w: NOT list_contains({_strings((*V.CONNECTOR_WORDS, 'peru', 'ireland', 'irish'))}, lower(w)))) = 0 THEN 'PE,IE' END AS only FROM x",
    "intent_labels": W + _beside_sql(_TEXTS) + ", c AS (SELECT text_id, " + _CHAT + " AS t FROM x), h AS (SELECT *, " + _HELP + " AS h FROM c) SELECT text_id, CASE " + _INTENT + " END AS intent FROM h",
    "signal_flags": W + _beside_sql(_TEXTS) + ", c AS (SELECT text_id, regexp_replace(lower(translate(text, '’', '''')), '\\s+', ' ', 'g') AS low, " + _CHAT + " AS t FROM x) SELECT text_id, " + _any("low", _CONTACT) + f" OR (regexp_matches(low, {_quote(_ASKED_OFFICE)}) AND NOT regexp_matches(low, {_quote(_OWN_OFFICE)})) AS contact_request, " + _any("low", (V.REACH_PATTERN,)) + " AS who_to_reach, " + _any("low", (V.COMPARISON_PATTERN,)) + " AS comparison_wording, " + _any("t", V.ADVICE_PATTERNS) + " AS personal_advice FROM c",
    "turn_routes": "SELECT k AS text_id, CASE WHEN k % 5 = 0 AND k % 4 > 0 AND k % 3 > 0 AND k % 7 > 0 THEN 'contact' WHEN k % 4 > 0 AND k % 2 = 0 AND NOT (k % 5 = 0 AND k % 3 = 0) THEN CASE WHEN k % 4 > 1 THEN 'comparison' ELSE 'information' END ELSE 'clarify' END AS route FROM (SELECT conv_id * 1000 + turn AS k FROM conversations)",
    "merged_codes": W + _KEYED + ", " + _AL + ", " + _RU + ", u AS (SELECT *, array_to_string(list_reverse(list(CASE WHEN trim(text) <> '' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), chr(10)) AS recent FROM k WHERE role = 'user'), r AS (SELECT text_id, " + _ASCII.format(t="recent") + " AS w FROM u), a AS (" + _entities("u", "text_id") + "), b AS (" + _topics("u", "text_id") + "), c AS (" + _entities("r", "text_id") + "), e AS (" + _topics("r", "text_id") + ") SELECT conv_id, turn, array_to_string(list_slice(list_concat(coalesce(a.codes, []), list_filter(coalesce(c.codes, []), lambda x: NOT list_contains(coalesce(a.codes, []), x))), 1, 3), ',') AS merged FROM u LEFT JOIN a USING (text_id) LEFT JOIN c USING (text_id)",
    "turn_hints": W + _KEYED + ", " + _AL + ", " + _RU + ", u AS (SELECT *, array_to_string(list_reverse(list(CASE WHEN trim(text) <> '' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), chr(10)) AS recent FROM k WHERE role = 'user'), r AS (SELECT text_id, " + _ASCII.format(t="recent") + " AS w FROM u), a AS (" + _entities("u", "text_id") + "), b AS (" + _topics("u", "text_id") + "), c AS (" + _entities("r", "text_id") + "), e AS (" + _topics("r", "text_id") + ") SELECT conv_id, turn, coalesce(array_to_string(a.codes, ','), '') AS codes, coalesce(array_to_string(b.topics, ','), '') AS topics, coalesce(array_to_string(c.codes, ','), '') AS recent_codes, coalesce(array_to_string(e.topics, ','), '') AS recent_topics FROM u LEFT JOIN a USING (text_id) LEFT JOIN b USING (text_id) LEFT JOIN c USING (text_id) LEFT JOIN e USING (text_id)",
    "fuzzy_names_levenshtein": W + _NAMES + """, f AS (SELECT c_custkey AS text_id, """ + _ASCII.format(t="substr(name, 1, c_custkey % length(name)) || substr(name, c_custkey % length(name) + 2)") + f""" AS f FROM customer JOIN (SELECT DISTINCT k, name FROM al) ON c_custkey % {len(V.ENTITIES)} = k),
  p AS (SELECT text_id, f, code, max(1 - levenshtein(f, n) / greatest(length(f), length(n))) AS ratio FROM f JOIN al ON abs(length(n) - length(f)) <= 3 WHERE f <> '' GROUP BY text_id, f, code),
  r AS (SELECT *, row_number() OVER w AS r, lead(ratio) OVER w AS second FROM p WINDOW w AS (PARTITION BY text_id ORDER BY ratio DESC, code))
  SELECT text_id, code, round(ratio, 6) AS ratio FROM r WHERE r = 1 AND ratio >= CASE WHEN length(f) <= 4 THEN 0.86 ELSE 0.75 END AND ratio - coalesce(second, 0) >= 0.07""",
    "strip_scope": """SELECT c_custkey AS subject_id, CASE c_custkey % 8 WHEN 0 THEN 'notice rules' WHEN 1 THEN 'notice rules' WHEN 2 THEN 'overtime' WHEN 3 THEN 'paid leave' WHEN 4 THEN 'differences' WHEN 6 THEN 'severance' WHEN 7 THEN 'inland notice' END AS subject_out, true AS changed, c_custkey % 8 = 5 AS became_empty, 'pay' AS terms FROM customer""",
    "lost_subjects": "SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS query_id, 'missing_topic' AS reason FROM customer WHERE c_custkey % 8 = 5 AND c_custkey % 3 <> 0 GROUP BY floor(c_custkey / 4)",
    "removed_scopes": "SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 8 = 7 THEN '' ELSE 'N1' END AS removed FROM customer",
    "subject_modes": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'broad_topic' ELSE 'direct_topic' END WHEN c_custkey % 3 = 2 THEN 'relation_required' WHEN c_custkey % 3 = 1 OR c_custkey % 2 = 0 THEN 'direct_topic' ELSE 'broad_topic' END AS mode FROM customer",
    "concept_positions": W + _POS + " SELECT query_id, chunk_id, grp AS group_idx, count(*) AS n, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM found GROUP BY query_id, chunk_id, grp",
    "relation_proximity": W + _POS + " SELECT query_id, chunk_id, bool_or(near) AS related FROM (SELECT a.query_id, a.chunk_id, EXISTS (SELECT 1 FROM found b WHERE b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.grp = 1 AND abs(a.pos - b.pos) <= 6) AS near FROM found a WHERE a.grp = 0) GROUP BY query_id, chunk_id",
    "subject_overlap": W + _HITS + ", o AS (SELECT query_id, chunk_id, " + _SIG.format(w=_EVW.format(t="array_to_string(words, ' ')")) + " AS s, " + _EVW.format(t="content") + " AS w FROM hits JOIN queries USING (query_id)) SELECT query_id, chunk_id, len(s) > 0 AND len(list_filter(s, lambda x: list_contains(w, x))) >= greatest(1, (len(s) + 1) // 2) AS overlap FROM o",
    "evidence_grade": W + _GRADE + " SELECT query_id, spec_idx, code, status FROM g",
    "evidence_gate": W + _GRADE + ", good AS (SELECT DISTINCT query_id, code FROM g WHERE status <> 'insufficient') SELECT query_id, 'kept' AS what, count(DISTINCT chunk_id) AS n FROM hits h JOIN good USING (query_id) WHERE h.country_code = good.code GROUP BY query_id UNION ALL SELECT query_id, 'keys', count(*) FROM g GROUP BY query_id UNION ALL SELECT query_id, 'excluded', count(*) FROM (SELECT query_id, code FROM g GROUP BY query_id, code HAVING bool_and(status = 'insufficient')) GROUP BY query_id",
    "history_violations": """WITH r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS f, arg_max(role, turn) AS l, bool_or(coalesce(role = b, false)) AS rep, bool_or(trim(coalesce(text, '')) = '') AS blank, max(length(text)) AS m, sum(length(text)) AS t FROM r GROUP BY conv_id)
  SELECT conv_id, 'roles_repeat' AS violation FROM p WHERE rep UNION ALL SELECT conv_id, 'first_not_user' FROM p WHERE f <> 'user' UNION ALL SELECT conv_id, 'last_not_assistant' FROM p WHERE l <> 'assistant' UNION ALL SELECT conv_id, 'blank_message' FROM p WHERE blank UNION ALL SELECT conv_id, 'message_too_long' FROM p WHERE m > 1500 UNION ALL SELECT conv_id, 'too_many_messages' FROM p WHERE n > 6 UNION ALL SELECT conv_id, 'history_too_long' FROM p WHERE t > 4000""",
    "action_violations": """WITH a AS (SELECT conv_id AS q, turn + conv_id AS k FROM conversations), x AS (SELECT q, k, CASE k % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'comparison' ELSE 'information' END AS type, k % 4 = 0 AS one, k % 5 AS t, k % 2 = 0 AS s FROM a),
  v AS (SELECT q, 'contact_with_subject' AS violation FROM x WHERE type = 'contact' AND (s OR t < 2) UNION SELECT q, 'subject_missing' FROM x WHERE type <> 'contact' AND NOT s AND t > 1 UNION SELECT q, 'comparison_needs_two' FROM x WHERE type = 'comparison' AND one UNION SELECT q, 'unknown_topic' FROM x WHERE t = 0 UNION SELECT q, 'clarification_with_action' FROM x WHERE k % 13 = 0
   UNION SELECT q, 'too_many_actions' FROM x GROUP BY q HAVING count(*) > 3 UNION SELECT q, 'repeated_action' FROM x GROUP BY q, type, one HAVING count(*) > 1)
  SELECT violation, count(*) AS n FROM v GROUP BY violation""",
    "bounded_history": """WITH l AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, length(substr(text, 1, 100)) AS q, length(substr(nt, 1, 400)) AS a FROM l WHERE role = 'user' AND nr = 'assistant'),
  c AS (SELECT *, row_number() OVER w AS n, sum(q + a) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, CAST(q AS INTEGER) AS q, CAST(a AS INTEGER) AS a FROM c WHERE n <= 3 AND t <= 900""",
    "recent_questions": "SELECT conv_id, turn, sha256(coalesce(array_to_string(list_reverse(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), '|'), '')) AS digest FROM conversations WHERE role = 'user' AND trim(text) <> ''",
    "last_context": W + _OPS + ", l AS (SELECT conv_id, turn, last_value(CASE WHEN len(codes) > 0 THEN codes END IGNORE NULLS) OVER w AS c, last_value(subject IGNORE NULLS) OVER w AS s FROM ops WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, array_to_string(c, ',') AS codes, s AS subject FROM l",
    "next_states": """WITH x AS (SELECT conv_id, turn, turn + conv_id AS k FROM conversations), a AS (SELECT conv_id, turn, CASE WHEN k % 2 = 0 THEN 'comparison' ELSE 'information' END AS type, 'C' || CAST(k % 4 AS VARCHAR) AS c, conv_id % 9 <> 0 AND k % 3 <> 0 AND k % 4 < 3 AS ok FROM x)
  SELECT conv_id AS query_id, CAST(count(*) FILTER (ok) AS INTEGER) AS actions, CASE WHEN count(*) FILTER (ok) = 1 THEN 0 ELSE -1 END AS focus, coalesce(array_to_string(list_filter(list(c ORDER BY turn) FILTER (ok AND type = 'comparison'), lambda x, i: list_position(list(c ORDER BY turn) FILTER (ok AND type = 'comparison'), x) = i), ','), '') AS codes, CASE WHEN conv_id % 9 = 0 THEN 'which' END AS pending FROM a GROUP BY conv_id""",
    "normalised_texts": "SELECT doc_id, sha256(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS squashed, sha256(" + _ASCII.format(t="text") + ") AS words, CAST(len(" + _EVW.format(t="text") + ") AS INTEGER) AS tokens FROM documents",
    "heading_entities": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 25 <> (c_custkey * 7 + 1) % 25 THEN NULL ELSE 'N' || CAST(c_custkey % 25 AS VARCHAR) END AS entity_code FROM customer",
    "filter_conflicts": "SELECT k AS text_id, k % 3 > 0 AND k % 2 = 1 AS conflict FROM (SELECT conv_id * 1000 + turn AS k FROM conversations)",
    "answer_mentions": "WITH w AS (SELECT doc_id, ' ' || array_to_string(" + _EVW.format(t="text") + ", ' ') || ' ' AS w FROM documents), g AS (SELECT doc_id, contains(w, ' of the ') OR contains(w, ' the and ') AS a, contains(w, ' in ') OR contains(w, ' la ') OR contains(w, ' die ') AS b FROM w) SELECT doc_id AS answer_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN a AND b ELSE a OR b END AS mentions FROM g",
    "same_subjects": W + _beside_sql(_SAME) + ", r AS (SELECT text_id, " + _ASCII.format(t="array_to_string(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda w: lower(w) <> 'peru'), ' ')") + " AS rest FROM x) SELECT text_id, text_id % 5 <> 0 AND " + _any("rest", V.SAME_SUBJECT_PATTERNS) + " AS same FROM r",
    "local_followups": "SELECT conv_id, turn, 'replace_country' AS operation, CASE WHEN k % 3 = 0 THEN 'comparison' ELSE 'information' END AS type, CASE WHEN k % 4 = 0 THEN 'PE' ELSE 'PE,ES' END AS codes, 's' AS subject FROM (SELECT *, turn + conv_id AS k FROM conversations) WHERE k % 2 = 0 AND k % 3 < 2 AND (k % 3 = 1 OR k % 4 > 0)",
    "carry_context": "WITH RECURSIVE " + _OPS + """, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM ops),
  r AS (SELECT conv_id, turn, i, 'pass' AS resolution, 'information' AS type, codes AS out_codes, subject AS out_subject, CAST(NULL AS VARCHAR) AS reason, len(codes) > 0 AND coalesce(op, '') <> 'ambiguous' AS live FROM o WHERE i = 1
   UNION ALL
   SELECT conv_id, turn, i, CASE WHEN op = 'ambiguous' OR (NOT passes AND text IS NULL) THEN 'clarify' WHEN passes THEN 'pass' ELSE 'carried' END, CASE WHEN op = 'ambiguous' OR passes OR text IS NULL THEN 'information' ELSE kind END,
    CASE WHEN op = 'ambiguous' OR passes OR text IS NULL THEN codes ELSE now END, CASE WHEN op = 'ambiguous' OR passes OR text IS NULL THEN subject ELSE text END, CASE WHEN op = 'ambiguous' THEN 'ambiguous' WHEN NOT passes AND text IS NULL THEN 'missing_topic' END,
    CASE WHEN op = 'ambiguous' OR (NOT passes AND text IS NULL) THEN false WHEN passes THEN len(codes) > 0 ELSE len(now) > 0 END
   FROM (SELECT *, NOT live OR op IS NULL OR (was = 'comparison' AND len(now) < 2) AS passes, CASE WHEN was = 'information' AND op = 'add_country' AND len(now) >= 2 THEN 'comparison' ELSE was END AS kind FROM (
     SELECT o.conv_id, o.turn, o.i, o.op, o.codes, o.subject, r.live, r.type AS was, coalesce(o.subject, r.out_subject) AS text,
      CASE o.op WHEN 'replace_country' THEN CASE WHEN len(o.codes) > 0 THEN o.codes ELSE r.out_codes END WHEN 'add_country' THEN list_concat(r.out_codes, list_filter(o.codes, lambda c: NOT list_contains(r.out_codes, c))) ELSE r.out_codes END AS now
     FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)))
  SELECT conv_id, turn, resolution, type, array_to_string(out_codes, ',') AS codes, out_subject AS subject, reason FROM r""",
}
