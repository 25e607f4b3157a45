import pytest
from pyspark.sql import functions as F

from lectern.operators import answers as A
from lectern.sources import dims

ANS = "answer_id long, question string, answer string, codes array<string>"


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_citations(spark):
    assert value(spark, A.citations, "a [2] b [1, 2]. [3;4] [x]") == [2, 1]
    assert value(spark, A.citation_format_error, "a [1, 3; 2]") is True
    assert value(spark, A.citation_format_error, "a [1, 3] [12]") is False
    for text, bad in (("none", True), ("[0]", True), ("[3]", True), ("[1, 2]", False)):
        assert value(spark, lambda c: A.citation_range_error(c, F.lit(2)), text) is bad


@pytest.mark.parametrize(("text", "want"), [("a [1] [1] b", "a [1] b"), ("a [1]. [1], [1]", "a [1]."), ("a [1, 2] [1]", "a [1, 2] [1]"), ("a [1] [1] [2] [2]", "a [1] [2]")])
def test_repeated_citations(spark, text, want):
    assert value(spark, A.collapse_repeated, text) == want


SPAIN = "Spain\n- Thirty days apply. [1]\n  more on that\n- Another rule. [2]"


def report(spark, answer, codes, question="Notice?", countries=("ES", "FR"), content="after 30 days"):
    a = spark.createDataFrame([(1, question, answer, codes)], ANS)
    s = spark.createDataFrame([(1, i + 1, c, content) for i, c in enumerate(countries)], "answer_id long, citation int, country_code string, content string")
    r = A.quality_report(a, s, dims.entity_names(spark)).first()
    return r.hard, r.soft, r.verdict


def test_quality(spark):
    assert report(spark, SPAIN, ["ES"], countries=("ES", "ES")) == ([], [], "ok")
    assert report(spark, SPAIN, ["ES"]) == (["citation_entity_mismatch"], [], "repair")
    assert report(spark, SPAIN, ["ES", "PE"], countries=("ES", "ES"))[1:] == (["structure"], "repair")
    assert "citation_range" in report(spark, SPAIN.replace("[2]", "[9]"), ["ES"])[0]
    assert "uncited_claims" in report(spark, SPAIN.replace(" [2]", ""), ["ES"])[0]
    assert "internal_reference" in report(spark, SPAIN + "\n- The provided documents say. [1]", ["ES"])[0]
    assert "paid_leave_scope" in report(spark, SPAIN + "\n- Unpaid leave too. [1]", ["ES"], "Paid leave?")[0]
    assert report(spark, SPAIN + "\n- No information is available. [1]", ["ES"], countries=("ES", "ES")) == ([], ["false_absence_claim"], "accept_soft")
    assert report(spark, SPAIN + "\n- Another  rule [1]", ["ES"], countries=("ES", "ES"))[1] == ["repeated_bullets"]


def test_lines(spark):
    a = spark.createDataFrame([(1, "", "Intro\n**Spain:**\n- a\n  b\nloose\nComparison\n- c", ["ES"])], ANS)
    rows = A.parse_canonical(a, dims.entity_names(spark)).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["unresolved", "heading", "bullet", "continuation", "standalone", "heading", "bullet"]
    assert [r.code for r in rows][1:5] == ["ES"] * 4
    assert rows[6].comparison
    assert A.structure_errors(a, A.parse_canonical(a, dims.entity_names(spark))).first().error == "unresolved_content"


def test_renumbering(spark):
    a = spark.createDataFrame([(1, "x [7] y [3, 7]."), (2, "x [8]"), (3, "no")], "answer_id long, answer string")
    s = spark.createDataFrame([(1, 1, 3), (1, 2, 7), (2, 1, 3), (3, 1, 3), (3, 2, 3)], "answer_id long, source_order int, citation int")
    got = {r.answer_id: (r.answer, r.renumbered) for r in A.dense_renumber(a, s).collect()}
    assert got == {1: ("x [2] y [1, 2].", True), 2: ("x [8]", False), 3: ("no", False)}


def test_lines_are_dealt_once(spark, tmp_path):
    """Made-up answers are put together in their document's row, and the structure of an answer needs one exchange of its lines."""
    from lectern.plans import inputs

    spark.createDataFrame([(1, "a\r\n\r\n b [x]\nc\nd"), (2, " \n"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a = inputs.answers(spark, str(tmp_path))
    assert "hashpartitioning" not in a._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in a.collect()] == [(1, "SRC1\n- a [1]\n- b x\nComparison\n- d [5]")]
    rows = spark.createDataFrame([(1, SPAIN, ["ES"]), (2, "", ["ES"]), (3, "Spain\n- x", ["ES", "SE"]), (4, "Spain\nSweden\n- y", ["ES", "SE"])], "answer_id long, answer string, codes array<string>")
    found = A.structure_errors(rows, A.parse_canonical(rows, dims.entity_names(spark)))
    assert found._jdf.queryExecution().executedPlan().toString().count("posexplode(split(answer") <= 2  # in the initial and the final plan
    assert {r.answer_id: r.error for r in found.collect()} == {2: "missing_section", 3: "missing_section", 4: "empty_section"}
