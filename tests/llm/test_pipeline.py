"""The pipeline on a small corpus: each stage's effect, and its columns."""

import random

import brute as B
import pytest
from test_ops import prose

import corpus_pipeline as P
from lectern.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    d = tmp_path_factory.mktemp("sf")
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows = []
    for i in range(400):
        w = prose(rng, 80).split()
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(80)] = rng.choice(("awful", "nasty"))
        rows.append((i, " ".join(w), "en", "hot" if i % 3 else f"s{i % 4}"))
    rows += [(1000 + i, rows[i][1] + " tail", "en", None) for i in range(1, 30)]
    rows += [(2000 + i, prose(rng, 40) + " " + items[i % 5][1] + " " + prose(rng, 40), "en", "hot") for i in range(10)]
    rows += [(3000, "key password=hunter2222 " + prose(rng, 30), "en", "hot"), (3001, None, None, None), (3002, "", "en", "s1"), (3003, "", "en", "s1"), (None, prose(rng, 30), "en", "s1")]
    table = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages(spark, folder, tmp_path):
    d, rows, items = folder
    docs, got = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert docs.columns == COLUMNS
        got[name] = docs.collect()
    ids = {n: [r.doc_id for r in rs] for n, rs in got.items()}
    toxic = {i for i, t, *_ in rows if t and sum(t.split().count(w) for w in ("awful", "nasty")) >= 3}
    assert set(ids["toxicity"]) == {r[0] for r in rows} - toxic
    left = [(r.doc_id, r.text) for r in got["toxicity"]]
    want = {c for _, _, c in B.near_duplicates(left, 5, 80)}
    assert set(ids["near_dedup"]) == want
    leaks = {doc for doc, _ in B.leaks([(r.doc_id, r.text) for r in got["near_dedup"]], items, 3, 0.7)}
    assert len(leaks) == 10
    assert set(ids["decontamination"]) == want - leaks
    assert sorted(map(str, ids["secrets"])) == sorted(map(str, ids["decontamination"]))
    clean = {r.doc_id: r.text for r in got["secrets"]}
    assert clean[3000].startswith("key [SECRET] ")
    assert clean[3001] is None
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in got["secrets"] if r.text is not None)
    assert sorted(map(str, ids["mixing"])) == sorted(map(str, ids["secrets"]))
    assert len({(r.slot, r.place) for r in got["mixing"]}) == len(got["mixing"])
    again = P.run(spark, d).collect()
    assert sorted((str(r.doc_id), r.slot, r.place) for r in again) == sorted((str(r.doc_id), r.slot, r.place) for r in got["mixing"])


@pytest.mark.parametrize("table", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, folder, tmp_path, table):
    d, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{d}/{t}.parquet")
        (df.limit(0) if t == table else df).write.parquet(f"{tmp_path}/{t}.parquet")
    assert (P.run(spark, str(tmp_path)).count() == 0) == (table == "documents")


def test_queries_are_registered_once_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
