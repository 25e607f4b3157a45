import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import search, select
from lectern.operators.ranking import Shard

HIT = "query_id long, chunk_id long, rank int, legal_topic string, topics array<string>"


def ids(df):
    return [r.chunk_id for r in df.orderBy("query_id", "position").collect()]


def test_filters(spark):
    chunks = spark.createDataFrame([(1, "GB", "T1", "Contact", "en", 2024), (2, "GB", "T1", None, "en", 2024), (3, "FR", None, "S", "fr", None), (4, "FR", "T2", "S", "en", 2023)], "chunk_id long, country_code string, legal_topic string, subsection string, language string, reference_year int")
    schema = "query_id long, country_codes array<string>, legal_topics array<string>, subsections array<string>, language string, reference_year int"
    rows = [(1, ["gb", "GB", " fr "], [], [], None, None), (2, [], ["T1"], [], None, None), (3, [], [], ["Contact"], None, None), (4, None, None, None, "EN", 2023), (5, [" "], [], [], None, None)]
    q = spark.createDataFrame(rows, schema)
    got = {}
    for r in search.filter_chunks(q, chunks).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {2, 3, 4}, 2: {2}, 3: {1}, 4: {4}, 5: {2, 3, 4}}
    assert [r.g for r in q.select(search.filters_given(q).alias("g")).collect()] == [True, True, True, False, True]


def test_query_validation(spark):
    rows = [(1, "  a  ", 10, 0), (2, "ab", 0, 0), (3, "ab", 10, 1001), (4, "x" * 1001, 10, 0), (5, " fine  query ", 50, 1000), (6, None, 1, 0)]
    ok, bad = search.validate_queries(spark.createDataFrame(rows, "query_id long, query string, limit int, offset int"))
    assert [(r.query_id, r.query) for r in ok.collect()] == [(5, "fine query")]
    assert {r.query_id: r.reason for r in bad.collect()} == {1: "query_too_short", 2: "limit_range", 3: "offset_range", 4: "query_too_long", 6: "query_too_short"}


def test_repeated_terms_count_twice_and_fields_need_enough_terms(spark):
    chunks = spark.createDataFrame([(1, "a b c d", "a"), (2, "a", "x"), (3, "", "a b")], "chunk_id long, content string, subsection string")
    q = spark.createDataFrame([(1, "a b c", False), (2, "a a", True), (3, "a", True)], "query_id long, query string, filtered boolean")
    index = search.build_postings(chunks, ["content", "subsection"])
    hits = {(r.query_id, r.chunk_id): r.score for r in search.bm25_search(q, index, {"content": 5.0, "subsection": 3.0}).collect()}
    assert (1, 2) not in hits  # one of two required terms
    assert (1, 3) in hits  # two of them in the subsection
    assert hits[2, 1] == pytest.approx(2 * hits[3, 1], abs=1e-3)


def test_interleave_is_a_round_robin_prefix(spark):
    rng = random.Random(1)
    rows = [(q, rng.randrange(40), r, g) for q in range(3) for g in range(3) for r in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, group_idx int")
    for q in range(3):
        want = list(dict.fromkeys(c for _, _, c in sorted((r, g, c) for qq, c, r, g in rows if qq == q)))
        assert [r.chunk_id for r in select.interleave(df, 7).where(F.col("query_id") == q).orderBy("position").collect()] == want[:7]


def test_topics_take_turns_then_the_rest(spark):
    rows = [(1, c, r, t, ["B", "A", "none"]) for r, (c, t) in enumerate([(10, "A"), (11, "A"), (12, "C"), (13, "B"), (14, None), (15, "A")], 1)]
    df = spark.createDataFrame(rows, HIT)
    assert ids(select.topic_balanced(df, 10)) == [13, 10, 11, 15, 12, 14]
    assert ids(select.topic_balanced(df.withColumn("topics", F.array(F.lit("B"))), 2)) == [10, 11]
    assert ids(select.topic_balanced(df.withColumn("topics", F.array().cast("array<string>")), 3)) == [10, 11, 12]


def test_budgets_fall_by_allowance(spark):
    df = spark.range(1).select(select.source_budgets(F.lit(4), F.lit(10_000)).alias("a"), select.source_budgets(F.lit(3), F.lit(16_000)).alias("b"), select.source_budgets(F.lit(3), F.lit(2)).alias("c"))
    r = df.first()
    assert r.a == [4000, 2000, 2000, 2000]
    assert r.b == [4000, 4000, 4000]
    assert r.c == [2]


def test_permutations(spark):
    hits = spark.createDataFrame([(q, 10 * q + i, i) for q in (1, 2, 3) for i in (1, 2, 3)], "query_id long, chunk_id long, rank int")
    orders = spark.createDataFrame([(1, "[3, 1, 2]"), (2, "[1, 1, 2]"), (3, "nonsense")], "query_id long, ranking string")
    assert ids(select.apply_ranking(hits, orders)) == [13, 11, 12, 21, 22, 23, 31, 32, 33]


def test_retrieval_query(spark):
    df = spark.createDataFrame([("What are the notice rules in the United States?", ["the United States", "U.S."], ["notice period"]), ("Spain", ["Spain"], None)], "q string, n array<string>, c array<string>")
    got = [r.r for r in df.select(search.retrieval_query(F.col("q"), F.col("n"), F.col("c")).alias("r")).collect()]
    assert got == ["notice notice period", "Spain"]


def test_limits(spark):
    share, pool = search.candidate_limits(F.lit(10), F.lit(2), 5, True)
    r = spark.range(1).select(share.alias("s"), pool.alias("p"), search.check_source_budget(F.lit(1), F.lit(2)).alias("b")).first()
    assert (r.s, r.p, r.b) == (5, 20, True)


def test_document_inventory_lists_all_documents(spark, monkeypatch):
    from lectern.plans import search_queries

    ids = spark.range(1_000_001).selectExpr("id AS chunk_id", "id AS document_id", "'A' AS country")
    monkeypatch.setattr(search_queries.I, "chunks", lambda spark, d: ids)
    assert search_queries.document_inventory(spark, "").count() == 1_000_001


def corpus_and_queries(spark, seed, n_chunks=600, n_queries=25):
    """Words of very uneven frequency, chunks of very uneven length, ties by repeated chunks, empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(n_chunks):
        text = " ".join(rng.choices(vocabulary, weights, k=rng.choice((0, 3, 20, 60, 300))))
        rows.append((i, text, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(4)))))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)]
    queries = [(q, " ".join(rng.choices(vocabulary, [w**0.5 for w in weights], k=rng.choice((1, 2, 5, 20)))), rng.random() < 0.6) for q in range(n_queries)]
    return spark.createDataFrame(rows, "chunk_id long, content string, subsection string"), spark.createDataFrame([*queries, (99, "unknown", True), (98, "", True)], "query_id long, query string, filtered boolean")


@pytest.mark.parametrize(("shard", "block"), [(16_384, 4096), (100, 8)])
def test_a_page_of_the_best_equals_the_whole_ranking(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD_CHUNKS", shard)
    monkeypatch.setattr(search, "SHARD_QUERIES", block)
    chunks, queries = corpus_and_queries(spark, shard)
    boosts = {"content": 5.0, "subsection": 3.0}
    index = search.build_postings(chunks, list(boosts), search.query_terms(queries).select("term"))
    hits = search.bm25_search(queries, index, boosts).collect()
    for limit, offset in ((10, 0), (3, 5)):
        want = []
        for q in {r.query_id for r in hits}:
            own = sorted((-r.score, r.chunk_id) for r in hits if r.query_id == q)[offset : offset + limit]
            want += [(q, c, -s, offset + n) for n, (s, c) in enumerate(own, 1)]
        got = search.bm25_top(queries, index, boosts, limit, offset).select("query_id", "chunk_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_scores_follow_the_formula(spark):
    chunks, queries = corpus_and_queries(spark, 5, 80, 6)
    index = search.build_postings(chunks, ["content"])
    rows = {r.chunk_id: r.content.split() for r in chunks.collect() if r.content}
    n, average = len(rows), sum(map(len, rows.values())) / len(rows)
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25_search(queries.withColumn("filtered", F.lit(True)), index, {"content": 2.0}).collect()}
    want = {}
    for q in queries.collect():
        for c, words in rows.items():
            total = 0.0
            for t in q.query.split():
                df = sum(t in w for w in rows.values())
                tf = words.count(t)
                if tf:
                    total += 2.0 * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
            if total:
                want[q.query_id, c] = total
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_most_postings_are_not_looked_at():
    rng = random.Random(1)
    terms, chunk, dl, impact = [], [], [], []
    for c in range(8000):
        n = rng.choice((20, 60, 200))
        for t in {f"t{min(int(rng.expovariate(0.02)), 400)}" for _ in range(n)}:
            terms.append(t)
            chunk.append(c)
            dl.append(n)
            impact.append(1 / (1 + n / 60) * rng.uniform(0.6, 1.0))
    shard = Shard(pa.table({"field": ["content"] * len(terms), "term": terms, "chunk_id": chunk, "dl": dl, "impact": impact}))
    df = Counter(terms)
    for _ in range(20):
        asked = [("content", f"t{rng.randrange(60, 300)}", 1, 0.0) for _ in range(2)] + [("content", f"t{rng.randrange(40)}", 1, 0.0) for _ in range(4)]
        asked = [(f, t, m, math.log(1 + 8000 / df[t])) for f, t, m, _ in {a[1]: a for a in asked}.values() if df[t]]
        whole, scores = shard.best(asked, 1, None, 0.2, 1e-4)
        all_read, shard.read = shard.read, 0
        hits, some = shard.best(asked, 1, 10, 0.2, 1e-4)
        total = dict(zip(hits.tolist(), some.tolist(), strict=True))
        want = sorted(zip((-scores).tolist(), whole.tolist(), strict=True))[:10]
        assert all(abs(total[c] + s) < 1e-9 for s, c in want)
        read = shard.read / all_read
        shard.read = 0
        assert read < 1
    big = [("content", "t250", 1, 8.0), ("content", "t1", 1, 0.5), ("content", "t2", 1, 0.4)]
    shard.best(big, 1, None, 0.2, 1e-4)
    all_read, shard.read = shard.read, 0
    shard.best(big, 1, 10, 0.2, 1e-4)
    assert shard.read < all_read / 3


def test_rankings_by_kind_equal_the_ranking_of_all_hits(spark):
    """The pages of each query in each of its kinds, ties included, from shards that rank one kind."""
    import random

    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e", "f"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9]))), rng.choice(["x", "y", None])) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, kind string")
    queries = spark.createDataFrame([(1, "a b zz", True), (2, "c", True), (3, "e f a", False), (4, "zz", True)], "query_id long, query string, filtered boolean")
    asked = [(1, "x"), (1, "y"), (2, "y"), (3, "x"), (3, "none"), (4, "x")]
    index = search.build_postings(chunks, ["content"], search.query_terms(queries).select("term"), ("kind",))
    got = {tuple(r) for r in search.bm25_top_kinds(queries, index, {"content": 2.0}, spark.createDataFrame(asked, "query_id long, kind string"), 7).select("query_id", "kind", "rank", "chunk_id", "score").collect()}
    kind = {r[0]: r[2] for r in rows}
    want, per = set(), {}
    for r in sorted(search.bm25_search(queries, index, {"content": 2.0}).collect(), key=lambda r: (-r.score, r.chunk_id)):
        if (r.query_id, kind[r.chunk_id]) in asked:
            n = per[r.query_id, kind[r.chunk_id]] = per.get((r.query_id, kind[r.chunk_id]), 0) + 1
            if n <= 7:
                want.add((r.query_id, kind[r.chunk_id], n, r.chunk_id, r.score))
    assert got == want and len(want) == 28


def test_given_terms_are_counted_in_one_row_a_text(spark, monkeypatch):
    """An index of given terms equals the whole index cut to them, and holds the postings of a text in its row."""
    rows = [(1, "Le café, le CAFÉ - été 42!", "head"), (2, "", None), (3, None, "le le"), (4, " ?! ", "été"), (5, "none of them", "42 42x"), (6, "x " * 900 + "le", "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, section string")
    terms = spark.createDataFrame([("le",), ("café",), ("42",), ("x",), ("absent",), ("le",), (None,)], "term string")
    fields = ["content", "section"]
    index = search.build_postings(chunks, fields, terms)
    whole = search.build_postings(chunks, fields)

    def postings(i):
        return sorted(map(tuple, i.postings.where(F.col("term").isin("le", "café", "42", "x")).select("field", "term", "chunk_id", "dl", "tf").collect()))

    assert postings(index) == postings(whole)
    assert sorted(map(tuple, index.fields.select("field", "n", "avgdl").collect())) == sorted(map(tuple, whole.fields.select("field", "n", "avgdl").collect()))
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, whole.terms.where(F.col("term").isin("le", "café", "42", "x")).collect()))
    assert index.rows.count() == index.rows.select("field", "chunk_id").distinct().count() == 7
    # more terms than a worker is to hold take the way through joins
    monkeypatch.setattr(search, "NUMBERED_TERMS", 3)
    joined = search.build_postings(chunks, fields, terms)
    assert joined.rows is None and postings(joined) == postings(whole)


def test_filtered_pages_equal_the_filtered_ranking(spark, monkeypatch):
    """Filters are met inside the shards: the same pages as ranking all hits and filtering them, without these hits."""
    monkeypatch.setattr(search, "SHARD_CHUNKS", 100)
    monkeypatch.setattr(search, "SHARD_QUERIES", 32)
    rng = random.Random(5)
    some = lambda *v: rng.choice((None, *v))
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 3, 9)))), some("SRC0", "SRC1"), some("alpha", "beta"), some("Contact", "sub 1"), some("en", "fr"), some(2020, 2021)) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, country_code string, legal_topic string, subsection string, language string, reference_year int")
    lists = [None, [], ["src0 ", "SRC9"], [None, " "]], [None, [], ["alpha", "beta"]], [None, ["Contact"], ["sub 1"]]
    asked = [(i, " ".join(rng.sample("abcdefghz", 4)), *[rng.choice(x) for x in lists], rng.choice((None, " EN")), rng.choice((None, 2021)), i % 2 == 0) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id long, query string, country_codes array<string>, legal_topics array<string>, subsections array<string>, language string, reference_year int, filtered boolean")
    index = search.build_postings(chunks, ["content"], search.query_terms(queries).select("term"), search.ATTRIBUTES)
    want = search.top_k(search.filter_hits(search.bm25_search(queries, index, {"content": 5.0}), queries, chunks), 5)
    got = search.bm25_top_filtered(queries, index, {"content": 5.0}, 5)
    pages = [sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect())) for df in (got, want)]
    assert pages[0] == pages[1] and len({p[0] for p in pages[0]}) > 30
