"""The operators of this package as queries over whole tables, and their oracle SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, exact, knn, langid, merkle, minhash, mixing, periodic, pii, secrets, toxicity, warc
from lectern.llm.textcols import let
from lectern.sources.corpus import spread
from lectern.sources.store import bounded, cut, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; small scans of texts are dealt to all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC archives in the shared folder, read back."""
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage: one row for each document and item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "distance")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.round("b.similarity", 6).alias("similarity"), "b.distance")


def chat_records(conversations: DataFrame) -> DataFrame:
    """Each row of ``conversations`` as a JSON record in one of three layouts, and conversation -1 in a fourth."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    layouts = [
        F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))),
        F.to_json(F.struct(F.array(F.struct(role.alias("from"), text.alias("value"))).alias("conversations"))),
        F.to_json(F.struct(F.struct(F.array(F.struct(role.alias("speaker"), text.alias("utterance"))).alias("turns")).alias("dialog"))),
    ]
    pick = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    record = F.when(pick == 0, layouts[0]).when(pick == 1, layouts[1]).otherwise(layouts[2])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record"))
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_json(F.struct(F.lit(probe).alias("instruction"), F.lit(probe).alias("output"))).alias("record"))
    return rows.unionByName(extra)


#: Conversations of more bytes than this don't become one row; their digests are taken over a stream of rows.
CONVERSATION_BYTES = 64 << 20


def streamed_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, turns_sha256, loss_sha256`` of conversations of any size: rows in order, digests carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, lines, loss = None, False, hashlib.sha256(), hashlib.sha256()

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([lines.hexdigest()]), pa.array([loss.hexdigest()])], ["conv_id", "turns_sha256", "loss_sha256"])

        for batch in batches:
            for own, role, text, under in zip(*[batch.column(c) for c in ("conv_id", "role", "text", "loss")], strict=True):
                if not started or own.as_py() != conv:
                    if started:
                        yield result()
                    conv, started, lines, loss = own.as_py(), True, hashlib.sha256(), hashlib.sha256()
                lines.update(f"{role.as_py()}\n{text.as_py()}\n".encode())
                loss.update(under.as_py().encode())
        if started:
            yield result()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "i", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss").mapInArrow(run, "conv_id long, turns_sha256 string, loss_sha256 string")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as chats, read back from the formatted turns. Rows of a conversation by turn (null first), then role and text.

    A turn is formatted, and read back, in a row of its own. Only the digests need a conversation's text in order.
    """
    return chat_digests(table(spark, sf_dir, "conversations"))


def chat_digests(conversations: DataFrame, limit: int = CONVERSATION_BYTES) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted turns; null roles and texts are empty, repeated rows are turns of their own, an empty table gives the probe alone."""
    known = chat.canonical_turns(chat_records(conversations))
    # a record without turns would be a turn lost
    turns = F.when(F.col("turns").isNull(), F.raise_error(F.concat(F.lit("no layout for a record of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast(chat.TURNS)).otherwise(F.col("turns"))
    rows = known.select("conv_id", "turn", F.posexplode(turns).alias("i", "t"))
    done = chat.format_turns(rows.select("conv_id", "turn", "i", "t.role", "t.text")).select("conv_id", "turn", "i", "piece", "loss_start", "loss_end")
    back = done.select("conv_id", "turn", "i", F.length("piece").alias("n"), chat.read_turn(F.col("piece")).alias("t"), chat.loss_text(F.col("piece"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    back = back.select("conv_id", "turn", "i", "n", "t.role", "t.text", "loss")
    sums = [F.count("*").alias("n_turns"), F.coalesce(F.sum(F.length("loss")), F.lit(0)).cast("long").alias("loss_chars"), F.sum("n").cast("long").alias("formatted_chars")]

    def in_rows(rows: DataFrame) -> DataFrame:
        chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "i", "role", "text", "loss"))).alias("r"), *sums)
        lines = F.array_join(F.transform("r", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        under = F.array_join(F.transform("r", lambda t: t["loss"]), "")
        return chats.select("conv_id", "n_turns", F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), "loss_chars", F.sha2(under.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")

    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0)) + 64
    long = cut(conversations.groupBy(F.col("conv_id").cast("long").alias("long")).agg(F.sum(size.cast("long")).alias("bytes")).where(F.col("bytes") > limit).select("long"), "long-conversations")
    if long.isEmpty():
        return in_rows(back)
    same = F.col("conv_id").eqNullSafe(F.col("long"))
    few, rest = back.join(bounded(long), same, "left_semi"), back.join(bounded(long), same, "left_anti")
    totals = few.groupBy("conv_id").agg(*sums).withColumnRenamed("conv_id", "long")
    streamed = streamed_digests(few).join(totals, same).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return in_rows(rest).unionByName(streamed)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document under a model fitted on the labelled ones; null and empty texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def _counts(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [of(k) for k in kinds]


def _digests(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return [F.sha2(pii.span_digest(base).cast("binary"), 256).alias("base_sha256"), pii.span_digest(spans).alias("spans")]


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text; null texts have none, repeated rows are rows of their own."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_counts(F.col("pii"), pii.KINDS[:4]), *_digests(F.col("pii"), pii.KINDS[:4]))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture; targets are the square roots of the sources' sizes."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth, by integer inner product."""
    vectors = cut(knn.integer_vectors(table(spark, sf_dir, "embeddings")), "integers")
    return knn.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "v"), 5)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text; null texts have none, repeated rows are rows of their own."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *_counts(F.col("secrets"), secrets.KINDS[:3]), *_digests(F.col("secrets"), secrets.KINDS[:3]))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def periodic_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document, by a hash of its id, goes on with repetitions of some of its words; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, and digests of the runs and of the texts without their repetitions."""
    return run_digests(periodic.periodic_runs(periodic_texts(table(spark, sf_dir, "documents"))))


def run_digests(found: DataFrame) -> DataFrame:
    """The runs of ``found(doc_id, runs, collapsed)``: their number, the one with the greatest exponent, and digests; texts without runs have nulls and digests of what is empty."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("_best", F.aggregate("runs", none, better))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays; null texts count as empty."""
    return exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of all documents up to one root, and whether documents, of which a third are tampered with, still lead to it."""
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claimed = F.when(tampered, merkle.document_leaf(F.translate("text", upper, upper.lower()))).otherwise(merkle.document_leaf(F.col("text")))
    leaves = cut(docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), merkle.document_leaf(F.col("text")).alias("leaf"), claimed.alias("claimed")), "leaves")
    rows = merkle.verify(merkle.manifest(leaves), "claimed")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("witness")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_top_k": op8_top_k,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_periodic": op11_periodic,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_manifest": op13_manifest,
}

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT u AS id, v AS other FROM links
  UNION SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m.low, s.doc_id)) AS kept
FROM sets s LEFT JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) m ON m.id = s.doc_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

# Base32 of a SHA-1: four groups of ten hex digits, eight symbols of five bits each.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS r, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform([0, 1, 2, 3], lambda g: array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(1 + 10 * g AS BIGINT), 10) AS BIGINT) >> (5 * i)) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to FROM p
"""

# An escape adds one character to each control string, however many backslashes it holds.
_CONTROL = "(?:" + "|".join("\\" + c[0] + r"\\*" + "".join(x if x.isalnum() else "\\" + x for x in c[1:]) for c in chat.CONTROL) + ")"
OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, 0 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 0, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, {len(chat.TURN)} + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + {len(chat.END)} AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, i, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, i, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS c FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY c) AS kept, sha256(c) AS text_sha256
FROM t
"""


def _manifest_sql(lang_levels: int = 8, top_levels: int = 4) -> str:
    """The tree level by level, for up to 8**8 documents of a language and 8**4 languages; a level of one node stays as it is."""
    # CRC-32 of the digits of the id, bit by bit
    bits = "list_reduce(list_prepend(xor(acc, c), CAST(range(8) AS BIGINT[])), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda acc, c: {bits}), 4294967295)"
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    front = " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"leaves AS (SELECT doc_id, coalesce('v' || lang, '') AS tree, sha256({front} || {part.format('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({front} || {part.format(lower)}) END AS changed FROM documents)",
        "w0 AS (SELECT doc_id, tree, leaf, coalesce(changed, leaf) AS folded, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM leaves)",
        "n0 AS (SELECT tree, pos, total, leaf AS d FROM w0)",
    ]

    def level(w: str, n: str, k: int) -> None:
        before, after = "array_to_string(r.ds[:w.pos % 8], '')", "array_to_string(r.ds[w.pos % 8 + 2:], '')"
        out.append(f"r{n}{k} AS (SELECT tree, pos // 8 AS run, list(d ORDER BY pos) AS ds, any_value(total) AS total FROM {n}{k} GROUP BY tree, pos // 8)")
        out.append(f"{n}{k + 1} AS (SELECT tree, run AS pos, CAST(ceil(total / 8) AS BIGINT) AS total, CASE WHEN total > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{n}{k})")
        out.append(f"{w}{k + 1} AS (SELECT w.* EXCLUDE (pos, total, folded, proof), w.pos // 8 AS pos, CAST(ceil(w.total / 8) AS BIGINT) AS total, CASE WHEN w.total > 1 THEN sha256({before} || w.folded || {after}) ELSE w.folded END AS folded, CASE WHEN w.total > 1 THEN w.proof || {before} || {after} ELSE w.proof END AS proof FROM {w}{k} w JOIN r{n}{k} r ON w.tree = r.tree AND w.pos // 8 = r.run)")

    for k in range(lang_levels):
        level("w", "n", k)
    out.append(f"subs AS (SELECT tree AS name, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM n{lang_levels})")
    out.append(f"v0 AS (SELECT w.doc_id, w.leaf, w.folded, w.proof, s.subroot, 'all' AS tree, s.pos, s.total FROM w{lang_levels} w JOIN subs s ON w.tree = s.name)")
    out.append("m0 AS (SELECT 'all' AS tree, pos, total, subroot AS d FROM subs)")
    for k in range(top_levels):
        level("v", "m", k)
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, m.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m.d AS verified FROM v{top_levels}, m{top_levels} m"


ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_chat": OP4_SQL,
    "op2_near_duplicates": OP2_SQL,
    "op8_top_k": OP8_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_manifest": _manifest_sql(),
}
