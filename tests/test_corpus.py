import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import audit, facets, turns
from lectern.plans import corpus_queries
from lectern.sources import corpus, dims, versioned

CHUNK = "chunk_id string, document_id string, country_code string, v int"


def test_files_are_listed_without_lock_files(spark, tmp_path):
    for name in ("a.docx", "~$a.docx", "b.txt", "sub/c.docx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("same")
    rows = corpus.read_corpus_files(spark, str(tmp_path), "*.docx").collect()
    assert sorted(r.name for r in rows) == ["a.docx", "c.docx"]
    assert len({r.sha256 for r in rows}) == 1
    shared = audit.duplicate_files(corpus.read_corpus_files(spark, str(tmp_path), "*.docx")).collect()
    assert sorted((r.name, r.n) for r in shared) == [("a.docx", 2), ("c.docx", 2)]


def test_blocks_of_pages(spark):
    html = "<html><head><title>T</title><script>var x='<h1>no</h1>';</script></head><body><h1>Head &amp; more</h1><p>a <b>b</b></p><ul><li>c</li><li> </li></ul><table><tr><td>1</td></tr></table></body></html>"
    rows = corpus.read_html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.tag, r.heading_level, r.text) for r in rows] == [("title", None, "T"), ("h1", 1, "Head & more"), ("p", None, "a b"), ("li", None, "c"), ("td", None, "1")]


def test_tables_as_text(spark):
    cells = spark.createDataFrame([(1, 0, 1, 0, "b"), (1, 0, 0, 1, "y"), (1, 0, 0, 0, "x"), (1, 0, 2, 0, "--")], "doc_id long, table_idx int, row int, col int, text string")
    assert corpus.serialize_tables(cells).first().text == "x | y\nb"


def test_upsert_is_idempotent_and_counts_stale_rows(spark):
    old = spark.createDataFrame([("a", "d1", "ES", 1), ("b", "d1", "ES", 1), ("c", "d2", "FR", 1)], CHUNK)
    new = spark.createDataFrame([("a", "d1", "ES", 2), ("n", "d3", "IT", 2)], CHUNK)
    once = corpus.upsert_document(old, new)
    twice = corpus.upsert_document(once, new)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted(r.chunk_id for r in once.collect()) == ["a", "c", "n"]
    assert sorted((r.document_id, r.requested, r.indexed, r.stale) for r in corpus.upsert_stats(old, new).collect()) == [("d1", 1, 1, 1), ("d3", 1, 1, 0)]
    gone = spark.createDataFrame([("d1",), ("nope",)], "document_id string")
    assert [r.chunk_id for r in corpus.delete_documents(old, gone).collect()] == ["c"]
    assert [r.document_id for r in corpus.missing_documents(old, gone).collect()] == ["nope"]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    corpus.replace_partition(spark.createDataFrame([("a", "d1", "ES", 1), ("c", "d2", "FR", 1)], CHUNK), path)
    corpus.replace_partition(spark.createDataFrame([("x", "d9", "ES", 2)], CHUNK), path)
    assert sorted((r.chunk_id, r.country_code) for r in versioned.read_table(spark, path).collect()) == [("c", "FR"), ("x", "ES")]


def test_replacement_plans(spark):
    have = spark.createDataFrame([("ES", "d1", "f", "h"), ("FR", "d2", "f", "old"), ("IT", "d3", "f", "h"), ("IT", "d4", "g", "h")], "country_code string, document_id string, source_filename string, sha256 string")
    new = spark.createDataFrame([(c, "h", c == "IT") for c in ("ES", "FR", "IT", "PE")], "country_code string, sha256 string, ok boolean")
    got = {r.country_code: r.status for r in corpus.plan_replacement(have, new, F.col("ok")).collect()}
    assert got == {"ES": "already_current", "FR": "replacement_required", "IT": "replace", "PE": "fresh"}


def test_dimensions_are_sound(spark):
    assert dims.check_dimension(dims.entity_names(spark), "alias", "code").count() == 0
    topics = dims.topics(spark)
    subs = dims.subsections(spark).withColumn("code", F.col("subsection"))
    assert dims.check_dimension(subs, "label", "code", "parent", topics.select("topic"), None).count() == 0
    bad = spark.createDataFrame([("x", "AA"), ("X ", "BB"), ("", "CC"), ("y", "abc")], "alias string, code string")
    assert sorted({r.problem for r in dims.check_dimension(bad, "alias", "code").collect()}) == ["alias_collision", "bad_code", "blank_alias"]


def test_lookups(spark):
    df = spark.createDataFrame([(1, None, "Legal framework (selection)"), (2, "Pay Equity Laws", "a. Remedies:"), (3, "Pay Equity Laws", "Salary")], "id long, topic string, label string")
    got = {r.id: r.canonical_subsection for r in dims.join_subsection(df, "topic", F.col("label"), dims.subsections(spark)).collect()}
    assert got == {1: "Legal Framework", 2: "Remedies", 3: None}
    heads = spark.createDataFrame([(1, "Rules in the United Kingdom", ["GB", "ES"]), (2, "Spain and UK", ["GB", "ES"]), (3, "France", ["GB"])], "id long, h string, codes array<string>")
    assert {r.id: r.entity_code for r in dims.heading_entity(heads, F.col("h"), "codes", dims.entity_names(spark), "id").collect()} == {1: "GB", 2: None, 3: None}


def test_files_of_documents(spark):
    docs = spark.createDataFrame([(1, "ES", "old.docx"), (2, "FR", "x.docx"), (3, "IT", "both.docx"), (4, "I", "y"), (5, "PE", "pe.docx")], "document_id long, country_code string, source_filename string")
    files = spark.createDataFrame([("old.docx", "/a/old.docx"), ("FR.docx", "/a/FR.docx"), ("IT.docx", "/a/IT.docx"), ("both.docx", "/a/both.docx")], "name string, path string")
    assert {r.document_id: r.status for r in facets.match_files(docs, files).collect()} == {1: "resolved", 2: "resolved", 3: "conflict", 4: "invalid_metadata", 5: "missing"}


def test_facet_names_are_the_most_frequent(spark):
    rows = [("gb ", "UK"), ("GB", "UK"), ("GB", "Britain"), ("FR", None), (None, "x")]
    got = facets.facet_country(spark.createDataFrame(rows, "country_code string, country string")).collect()
    assert [(r.country_code, r.country, r.chunk_count) for r in got] == [("FR", "FR", 1), ("GB", "UK", 3)]


def test_histories(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", " "), (2, 1, "assistant", "x" * 11), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in turns.validate_history(df, chars=10).collect():
        got.setdefault(r.conv_id, set()).add(r.violation)
    assert got == {2: {"roles_repeat", "first_not_user", "blank_message", "message_too_long"}, 3: {"last_not_assistant"}}


def test_bounded_history_stops_at_the_first_pair_that_exceeds(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * (100 if i in (2, 3) else 10)) for i in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r.turn for r in turns.bounded_history(df, total=100).orderBy("turn").collect()] == [4, 6]
    assert [r.turn for r in turns.bounded_history(df, messages=2).collect()] == [6]


def test_a_cluster_has_to_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from lectern.sources import store

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_folder(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "hdfs://x/y/"), sparkContext=cluster.sparkContext)
    assert store.fresh_path(named, "t").startswith("hdfs://x/y/lectern-")
    assert store.free_names(spark.range(1).toDF("KEY").withColumn("_key", F.lit(1)), "key", "h") == ["__key", "h"]


def test_capitals_are_those_of_the_sql(spark):
    """classified_blocks takes its topics in capitals; every letter that either engine changes, and a sharp s within a word."""
    letters = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))) if c.upper() != c]
    texts = ["Straße", "ﬁnger", "élan", *letters]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus_queries._capital(F.col("t")).alias("u")).collect()
    wanted = duckdb.execute("select unnest($1) as t, upper(unnest($1)) as u", [texts]).fetchall()
    assert {r.t: r.u for r in rows} == dict(wanted)
    assert "upper(label) AS topic" in corpus_queries.ORACLE_SQL["classified_blocks"]


def test_headings_in_two_writings_are_one_topic(spark, tmp_path):
    """Labels that differ in capitals only are one alias, so blocks under them stay one row each, as in the SQL."""
    head = "<h1>{}</h1><p>a</p><h2>{}</h2><p>b</p><h3>Zeta</h3><p>c</p>"
    pages = [(3, head.format("Leave", "Notice period")), (6, head.format("LEAVE", "NOTICE period")), (7, head.format("leave", "notice Period")), (9, head.format("Straße", "Größe")), (12, head.format("STRAßE", "GRÖßE"))]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in corpus_queries.classified_blocks(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = con.execute(corpus_queries.ORACLE_SQL["classified_blocks"]).fetchall()
    assert len(got) == 6 * len(pages)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
