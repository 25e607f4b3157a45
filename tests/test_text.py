import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import segment


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("function", "given_text", "want"),
    [
        (X.squash_ws, "  a \t b\n", "a b"),
        (X.ascii_words, "Türkiye: Straße & Co.", "turkiye stra e co"),
        (X.ascii_words, "ÉCOLE", "ecole"),
        (X.evidence_tokens, "résumé Straße—x", ["re", "sume", "strasse", "x"]),
        (X.topic_label, "| 05. Pay Equity Laws|", "Pay Equity Laws"),
        (X.topic_label, "IV) Working Conditions", "Working Conditions"),
        (X.subsection_label, "a. Restrictions on Application / Interview Questions:", "restrictions on application/interview questions"),
        (X.subsection_label, "Employees´ Representation", "employees' representation"),
        (X.entity_token, "United_Kingdom ", "united kingdom"),
        (X.chat_text, "Whats  U doing, that's it?", "what is you doing thats it"),
        (X.help_text, "What's this BOT?", "what is this bot"),
        (X.label_key, "Notice – Period : |", "notice - period"),
        (X.repair_joins, "officeBrussels,, ,Belgium", "office Brussels,Belgium"),
    ],
)
def test_normalisers(spark, function, given_text, want):
    assert one(spark, function(F.col("t")), t=given_text) == want


def test_entity_suffix(spark):
    assert one(spark, X.without_entity(F.col("t"), F.col("n")), t="Hiring practices in the United States", n=["United States", "the United States"]) == "Hiring practices"
    assert one(spark, X.without_entity(F.col("t"), F.col("n")), t="Hiring", n=[]) == "Hiring"


def test_dedupe_keeps_first(spark):
    assert one(spark, X.dedupe_list(F.col("a"), lambda v: F.upper(X.squash_ws(v))), a=["gb", "GB ", "", "fr"]) == ["GB", "FR"]


def test_truncate(spark):
    t = "a" * 60 + "\n\n" + "b" * 60
    assert one(spark, X.truncate_at_paragraph(F.col("t"), F.lit(100)), t=t) == "a" * 60
    assert one(spark, X.truncate_at_paragraph(F.col("t"), F.lit(130)), t=t) == t
    assert one(spark, X.truncate_at_paragraph(F.col("t"), F.lit(40)), t=t) == "a" * 40


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab. \n!Zé"), min_size=0, max_size=400), min_size=1, max_size=4))
def test_pieces_fit_and_lose_nothing(spark, texts):
    content = "\n\n".join(texts)
    pieces = one(spark, segment.split_pieces(F.col("t"), 100), t=content)
    assert all(len(p) <= 100 for p in pieces) or len(content) <= 100
    assert "".join("".join(pieces).split()) == "".join(content.split())


def test_pieces_by_paragraph_then_sentence_then_word(spark):
    p = "First one here. " * 3
    pieces = one(spark, segment.split_pieces(F.col("t"), 100), t=f"{p}\n\n{'Second sentence is long. ' * 6}\n\nshort")
    assert pieces[0] == p.strip()
    assert all(x.endswith(".") for x in pieces[1:-1])
    assert pieces[-1] == "short"
    assert one(spark, segment.split_pieces(F.col("t"), 100), t="x" * 250) == ["x" * 100, "x" * 100, "x" * 50]
    with pytest.raises(ValueError, match="100"):
        segment.split_pieces(F.col("t"), 99)
