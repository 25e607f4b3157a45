import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import segment
from lectern.plans import inputs as I
from lectern.sources import dims

BLOCK = "doc_id long, pos int, text string, heading_level int, numbered boolean, bold boolean, unbolded boolean, names array<string>"


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, t, h, False, b, False, ["Australia"]) for i, (t, h, b) in enumerate(rows)], BLOCK)


def classified(spark, rows):
    out = segment.classify_blocks(blocks(spark, rows), dims.topics(spark), dims.subsections(spark), dims.overrides(spark))
    return [(r.role, r.topic, r.subsection) for r in out.orderBy("pos").collect()]


def test_topics_subsections_and_content(spark):
    got = classified(spark, [("01. Hiring practices in Australia", 1, False), ("Limitations on Background Checks", 2, False), ("text", None, False), ("Bold but unknown", None, True), ("Working Conditions", None, True), ("body", None, False), ("Overtime", None, True), ("rest", None, False)])
    h, w = "Hiring Practices", "Working Conditions"
    assert got == [("topic", h, None), ("subsection", h, "Limitations on Background Checks"), ("content", h, "Limitations on Background Checks"), ("content", h, "Limitations on Background Checks"), ("topic", w, None), ("content", w, None), ("subsection", w, "Overtime"), ("content", w, "Overtime")]


def test_override_lasts_for_one_heading(spark):
    got = classified(spark, [("Working Conditions", 1, False), ("Notice of Termination and Redundancy Pay", None, True), ("moved", None, False), ("Salary", None, True), ("back", None, False)])
    t, w = "Termination of Employment Contracts", "Working Conditions"
    assert [x[1] for x in got] == [w, t, t, w, w]
    assert got[1][0] == "override"
    assert got[4] == ("content", w, "Salary")


def test_overview_and_generic_sections(spark):
    got = classified(spark, [("Employment Law Overview in Australia", 1, False), ("Key Points", 2, False), ("x", None, False), ("Unknown main", 1, False), ("Any second level", 2, False), ("y", None, False)])
    assert [x[0] for x in got] == ["overview", "subsection", "content", "generic_main", "subsection", "content"]
    assert got[5][2] == "Any second level"


def test_sections_are_joined_by_blank_lines(spark):
    out = segment.classify_blocks(blocks(spark, [("Working Conditions", 1, False), ("a", None, False), ("b", None, False), ("Salary", None, True), ("--", None, False)]), dims.topics(spark), dims.subsections(spark), dims.overrides(spark))
    rows = segment.build_sections(out).collect()
    assert [(r.topic, r.subsection, r.content) for r in rows] == [("Working Conditions", None, "a\n\nb")]


def test_front_matter_keeps_the_crossing_line(spark):
    df = spark.createDataFrame([(1, i, "x" * 40) for i in range(5)], "doc_id long, pos int, text string")
    assert segment.front_matter(df, 100, 100).count() == 3
    assert segment.front_matter(df, 2, 100).count() == 2


def test_titles_and_entities(spark):
    rows = [(1, 0, "Employment Law Overview in Spain 2024"), (2, 0, "Labour and Employment Law in the United States"), (3, 0, "Employment law overview 2023"), (3, 1, "Türkiye"), (4, 0, "Employment law overview / Italy"), (5, 0, "Employment Law Overview in Spain"), (5, 1, "Employment Law Overview in Peru"), (6, 0, "No title"), (7, 0, "Employment Law Overview in Spain")]
    docs = spark.createDataFrame([(i, "PE" if i == 7 else None) for i in range(1, 8)], "doc_id long, explicit_code string")
    found = segment.title_candidates(spark.createDataFrame(rows, "doc_id long, pos int, text string"))
    got = {r.doc_id: (r.code, r.year, r.status) for r in segment.resolve_document_entity(docs, found, dims.entity_names(spark)).collect()}
    assert got == {1: ("ES", 2024, "resolved"), 2: ("US", None, "resolved"), 3: ("TR", 2023, "resolved"), 4: ("IT", None, "resolved"), 5: (None, None, "ambiguous"), 6: (None, None, "undeterminable"), 7: ("ES", None, "mismatch")}


def test_repeated_blocks(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("aabba")], "doc_id long, pos int, text string")
    assert [r.text for r in segment.drop_repeated_blocks(df).orderBy("pos").collect()] == ["a", "b", "a"]


def test_contacts_are_paired_in_order(spark):
    rows = [
        (1, 0, ["Firm A", "Main Street 1", "Tel: +32 2 643 26 33", "office@a.com", "Spain"], "Spain"),
        (1, 1, ["Contact:", "Ann Bee", "ann@a.com"], "Spain"),
        (1, 2, ["Contact:", "Cee Dee", "cee@a.com"], "Spain"),
        (1, 3, ["www.only-a-website.com"], "Spain"),
        (2, 0, ["Contact:", "Eve", "eve@b.com", "eve2@b.com"], None),
        (2, 1, ["Firm B", "info@b.com"], None),
        (2, 2, ["Firm B", "info@b.com"], None),
    ]
    found = segment.extract_contacts(spark.createDataFrame(rows, "doc_id long, block_idx int, lines array<string>, country string"))
    got = found.orderBy("doc_id", "pair").collect()
    assert [(r.doc_id, r.member_firm, r.contact_person, r.email) for r in got] == [(1, "Firm A", "Ann Bee", "ann@a.com"), (1, None, "Cee Dee", "cee@a.com"), (2, "Firm B", "Eve", "eve@b.com, eve2@b.com")]
    assert got[0].address == "Main Street 1"
    text = segment.contact_text(found).where("doc_id = 2").first().content
    assert text.startswith("Member firm: Firm B\nContact person: Eve\nEmail: eve@b.com, eve2@b.com")


def test_contact_text_without_repeated_phone(spark):
    df = spark.createDataFrame([("Phone: +1 234\nAddress: Street 1, +1 234",), ("Phone: +1 234\nAddress: Street 1",)], "c string")
    assert [r.r for r in df.select(segment.clean_contact_text(F.col("c")).alias("r")).collect()] == ["Phone: +1 234\nAddress: Street 1", "Phone: +1 234\nAddress: Street 1"]


def test_chunk_ids_do_not_depend_on_row_order(spark):
    pieces = [(1, i, 0, "S", t, None, f"text {i}") for i, t in enumerate(["Hiring Practices", "Hiring Practices", None, "Nonsense"])]
    meta = spark.createDataFrame([(1, "Spain", "ES", "EN", "f", "docx", 2024)], "doc_id long, country string, country_code string, language string, source_filename string, source_format string, reference_year int")
    schema = "doc_id long, island int, piece int, section string, topic string, subsection string, content string"
    a, bad = segment.enrich_chunks(spark.createDataFrame(pieces, schema), meta, dims.topics(spark), "fam")
    b, _ = segment.enrich_chunks(spark.createDataFrame(pieces[::-1], schema), meta, dims.topics(spark), "fam")
    ids = {r.content: r.chunk_id for r in a.collect()}
    assert ids == {r.content: r.chunk_id for r in b.collect()}
    assert len(set(ids.values())) == 3
    assert [r.topic for r in bad.collect()] == ["Nonsense"]


def plain_split(content, limit):
    """The splitter as nested loops over one text."""

    def full(parts):
        return [p.strip(" ") for p in parts if p.strip(" ")]

    def level(parts, glue, finer):
        done, run = [], None
        for p in parts:
            if len(p) <= limit and run is not None and len(run) + len(glue) + len(p) <= limit:
                run += glue + p
                continue
            done += [] if run is None else [run]
            run = p if len(p) <= limit else None
            done += [] if run is not None else finer(p)
        return done + ([] if run is None else [run])

    if len(content) <= limit:
        return [content]
    words = lambda s: level(full(re.split(r"\s+", s, flags=re.A)), " ", lambda w: [w[i : i + limit] for i in range(0, len(w), limit)])
    sentences = lambda p: level(full(re.split(r"(?<=[.!?])\s+(?=[A-Z0-9À-ÖØ-Þ\"'(])", p, flags=re.A)), " ", words)
    return level(full(re.split(r"\n\s*\n+", content, flags=re.A)), "\n\n", sentences)


@pytest.mark.parametrize("limit", [100, 1000])
def test_all_documents_are_split_as_by_a_plain_splitter(spark, limit):
    docs = I.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("content")).where("content is not null")
    docs = docs.unionByName(spark.createDataFrame([(-1, "x" * 950 + " Y. Z! \n \n\n" + "word. " * 90), (-2, ""), (-3, " " * 300)], "doc_id long, content string"))
    got = {}
    for r in segment.split_sections(docs, limit).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    want = {r.doc_id: plain_split(r.content, limit) for r in docs.collect()}
    assert got == {i: p for i, p in want.items() if p}
