"""The versioned table: merge on read, switches, failures, merges, restores and retries."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import corpus, versioned

SCHEMA = "chunk_id string, document_id string, country_code string, v int"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def now(spark, table, version=None):
    return sorted((r.chunk_id, r.v) for r in versioned.read_table(spark, table, version).collect())


@pytest.fixture
def table(spark, tmp_path):
    t = str(tmp_path / "table")
    versioned.publish(t, rows_of(spark, [(f"c{i}", f"d{i % 4}", "ES" if i < 6 else None, 1) for i in range(8)]), "document_id")
    return t


def test_later_parts_replace_documents_and_countries(spark, table):
    versioned.publish(table, rows_of(spark, [("c0", "d0", "ES", 2), ("n", "d9", "FR", 2)]), "document_id")
    assert now(spark, table) == [("c0", 2), *[(f"c{i}", 1) for i in (1, 2, 3, 5, 6, 7)], ("n", 2)]
    corpus.replace_partition(rows_of(spark, [("e", "d1", "ES", 3)]), table)
    assert now(spark, table) == [("c6", 1), ("c7", 1), ("e", 3), ("n", 2)]
    corpus.replace_partition(rows_of(spark, [("z", "d8", None, 4)]), table)
    assert now(spark, table) == [("e", 3), ("n", 2), ("z", 4)]
    versioned.publish(table, rows_of(spark, []), "document_id", gone=spark.createDataFrame([("d9",), ("nope",)], "document_id string"))
    assert now(spark, table) == [("e", 3), ("z", 4)]
    assert now(spark, table, 1) == [(f"c{i}", 1) for i in range(8)]


def test_a_job_that_dies_half_way_leaves_the_old_table(spark, table, monkeypatch):
    before = now(spark, table)
    many = spark.range(0, 1000, numPartitions=8).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.col("id") % 4).alias("document_id"), F.lit("ES").alias("country_code"), F.lit(9).alias("v"))
    broken = many.withColumn("v", F.when(F.col("chunk_id") == "999", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        corpus.replace_partition(broken, table)
    assert now(spark, table) == before
    # all is written, the switch is not made
    with monkeypatch.context() as m:
        m.setattr(versioned, "_switch", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            corpus.replace_partition(many, table)
    assert now(spark, table) == before
    # what failed jobs have left goes, what is read stays
    assert any(n.startswith("data/") for n in versioned.clear_old(spark, table, age_seconds=-1))
    assert now(spark, table) == before


def test_a_version_comes_back(spark, table):
    before = now(spark, table)
    corpus.replace_partition(rows_of(spark, [("e", "d1", "ES", 3)]), table)
    versioned.restore(spark, table, 1)
    assert now(spark, table) == before
    versioned.publish(table, rows_of(spark, [("k", "d0", "ES", 5)]), "document_id")
    assert now(spark, table) == sorted([("k", 5), *[x for x in before if x[0] not in ("c0", "c4")]])
    with pytest.raises(ValueError, match="no version"):
        versioned.read_table(spark, table, 99)


def test_two_writers_cannot_publish_one_version(spark, table):
    state = versioned.manifest(spark, table)
    with pytest.raises(Exception, match="exist"):
        versioned._switch(spark, table, state)


def test_an_epoch_is_published_once(spark, table):
    new = rows_of(spark, [("c0", "d0", "ES", 2)])
    first = versioned.publish(table, new, "document_id", source="s", epoch=4)
    assert versioned.publish(table, new, "document_id", source="s", epoch=4) == first
    assert versioned.publish(table, new, "document_id", source="other", epoch=4) == first + 1


def test_a_batch_costs_the_same_on_a_large_table(spark, tmp_path):
    bytes_of = {}
    for size in (100, 100_000):
        t = str(tmp_path / f"t{size}")
        base = spark.range(size).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), "id").alias("document_id"), F.lit("ES").alias("country_code"), F.lit(1).alias("v"))
        versioned.publish(t, base, "document_id")
        versioned.publish(t, rows_of(spark, [(f"c{i}", f"d{i}", "ES", 2) for i in range(50)]).coalesce(1), "document_id")
        bytes_of[size] = versioned.manifest(spark, t)["parts"][-1]["bytes"]
        got = versioned.read_table(spark, t)
        assert (got.count(), got.where("v = 2").count()) == (size, 50)
    assert abs(bytes_of[100] - bytes_of[100_000]) < 0.2 * bytes_of[100]


def test_merges_keep_the_rows_and_the_number_of_parts_small(spark, tmp_path):
    t, want, most = str(tmp_path / "t"), {}, 0
    for batch in range(24):
        ids = [(batch * 3 + k) % 20 for k in range(6)]
        want |= {f"d{i}": batch for i in ids}
        versioned.publish(t, rows_of(spark, [(f"c{i}", f"d{i}", "ES", batch) for i in ids]).coalesce(1), "document_id")
        versioned.compact(spark, t)
        most = max(most, len(versioned.manifest(spark, t)["parts"]))
    assert {r.document_id: r.v for r in versioned.read_table(spark, t).collect()} == want
    assert most <= 8
    versioned.clear_old(spark, t, keep=1, age_seconds=-1)
    assert {r.document_id: r.v for r in versioned.read_table(spark, t).collect()} == want


def test_ranges_of_documents_split_as_the_table_grows(spark, tmp_path):
    files = []
    for size in (200, 20_000):
        t = str(tmp_path / f"t{size}")
        for part in range(2):
            versioned.publish(t, spark.range(part * size, (part + 1) * size).select(F.col("id").cast("string").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 256).alias("document_id"), F.lit("ES").alias("country_code"), F.lit(1).alias("v")), "document_id")
        versioned.compact(spark, t, fewest=2, file_bytes=100_000)
        files.append(len(versioned.read_table(spark, t).inputFiles()))
    assert files[0] == 1
    assert files[1] > 10


def test_a_snapshot_fails_rather_than_give_a_part(spark):
    chunks = spark.range(12).select(F.lit("ES").alias("country_code"), F.col("id").alias("chunk_id"))
    assert corpus.country_snapshot(chunks, "ES", 12).count() == 12
    with pytest.raises(ValueError, match="more than 11"):
        corpus.country_snapshot(chunks, "ES", 11)
