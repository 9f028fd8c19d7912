import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators.lookups import lemmatize

def X():
    return F.col("x")


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("a<b>c</b>", "a c"),
        ("<p> x </p>", "x"),
        ("a &amp; b", "a & b"),
        ("<p>one\n two</p>", "one\n two"),
        ("<!-- <script>no</script> --><p>yes</p>", "yes"),
        ("<script>var t='</p>';</script>shown", "shown"),
        ("<STYLE>p{}</STYLE><Template><p>no</p></Template>x", "x"),
        ('<a title="1 > 0">link</a>', "link"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>open<br>never closed", "open never closed"),
        ("<!DOCTYPE html><?xml version='1'?>t", "t"),
        ("<p>&nbsp;</p>z", "z"),
        ("&amp;lt;b&amp;gt;", "&lt;b&gt;"),
        ("&#65;&#x42;&copy;&middot;&unknown;", "AB©·&unknown;"),
        ("&#128512; &#0; &#55296; &#147;q&#148;", "😀 � � “q”"),
        ("&amp", "&"),
        ("&am", "&am"),
    ],
)
def test_clean_html(value, page, expected):
    assert value(tx.clean_html(X()), row=(page,)) == expected


def test_unescape_agrees_with_the_standard_library(spark):
    names = ["amp", "lt;", "gt;", "eacute;", "hearts;", "NotEqualTilde;", "#8364;", "#xe9", "nbsp;"]
    texts = [f"a&{name} b&{other}" for name in names for other in names]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r["v"] for r in rows.select(tx.unescape_html(X()).alias("v")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_squeeze_space(value):
    assert value(tx.squeeze_space(X()), row=("a   b\x1c\t",)) == "a b"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n  ", max_size=12), min_size=1, max_size=8))
def test_squeeze_space_is_idempotent_and_matches_python(spark, texts):
    once = tx.squeeze_space(X())
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = rows.select("i", once.alias("one"), tx.squeeze_space(once).alias("two")).collect()
    for row in got:
        assert row["one"] == row["two"] == " ".join(texts[row["i"]].split())


def test_stop_words_keep_case(value):
    assert value(tx.drop_stopwords(X(), ["the", "of"]), row=("The end  of the line",)) == "The end line"
    assert value(tx.drop_stopwords(X(), []), row=(" a  b ",)) == "a b"


def test_lemmatize(spark):
    docs = spark.createDataFrame([(1, "cats and  dogs cats"), (2, "none"), (3, "")], "id int, t string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    got = {r["id"]: r["t"] for r in lemmatize(docs, "id", "t", lemmas).collect()}
    assert got == {1: "cat and dog cat", 2: "none", 3: ""}


def test_lemmatize_by_either_way(spark, monkeypatch):
    from askloom.operators import lookups

    docs = spark.createDataFrame([(1, "cats and  dogs cats"), (2, None), (3, ""), (None, "cats run"), (None, "dogs")], "id int, t string")
    twice = spark.createDataFrame([("cats", "cat"), ("cats", "kat"), ("dogs", "dog"), ("and", "and")], "token string, lemma string")
    small = lemmatize(docs, "id", "t", twice)
    assert "Exchange hashpartitioning(id" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lookups, "fits_broadcast", lambda df: False)
    large = lemmatize(docs, "id", "t", twice)
    for frame in (small, large):
        got = sorted(((r["id"], r["t"]) for r in frame.collect()), key=repr)
        assert got == sorted([(1, "cat and dog cat"), (2, None), (3, ""), (None, "cat run"), (None, "dog")], key=repr)


def test_simple_tokens(value):
    assert value(tx.simple_tokens(X()), row=("Été, C3PO-x!",)) == ["été", "c3po", "x"]
    assert value(tx.simple_tokens(X()), row=(None,)) == []


def test_normalised_document(value):
    schema, row = "t string, g string, q string, a string", ("  A   Title ", None, "<b>Q</b>\n x", None)
    got = value(tx.prepare_document(*map(F.col, "tgqa")), schema, row)
    assert got.asDict() == {"title": "a title", "tags": "", "question": "q x", "answer": ""}


def test_texts_of_a_document(value):
    schema, row = "t string, g string, q string, a string", ("T", None, "Q", "A")
    columns = [F.col(c) for c in "tgqa"]
    assert value(tx.document_text(*columns), schema, row) == (
        "Title: T\n\nTags: \n\nQuestion: Q\n\nBest Answer: A"
    )
    assert value(tx.document_text(*columns), schema, (None, "g", "Q", "A")) is None
    assert value(tx.embedding_text(*columns), schema, ("T", "", "Q", "A")) == (
        "Title: T\nQuestion: Q\nAnswer: A"
    )
    assert value(tx.chunk_source_text(*columns), schema, row) == "Title: T Tag:  Question: Q Answer: A"


def test_leading_digit(value):
    assert value(tx.strip_leading_digit(X()), row=("12 cups",)) == "2 cups"


@pytest.mark.parametrize(
    "left, right, same", [("anagram", "nagaram", True), ("rat", "car", False), ("aacc", "ccac", False)]
)
def test_is_anagram(value, left, right, same):
    assert value(tx.is_anagram(F.lit(left), F.lit(right))) is same


@pytest.mark.parametrize("piece", ["<!-- x ", "<script> x ", "<a <b ", "<p>x<a ", "<"])
def test_unclosed_markup_is_linear(spark, piece):
    import time

    page = "see " + piece * ((1 << 20) // len(piece))
    row = spark.createDataFrame([(page,)], "x string")
    tx.clean_html(F.col("x"))
    row.select(F.length(tx.clean_html(F.lit("<p>warm")))).collect()
    began = time.time()
    row.select(F.length(tx.clean_html(F.col("x")))).collect()
    assert time.time() - began < 5


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><script>var code = '<p>';", "a"),
        ("<p>a</p><!-- b <p>c</p>", "a"),
        ("<p>a</p> b <!-- c", "a b"),
        ("<p>a</p> b < c <d", "a b < c <d"),
        ("a <b and c", "a <b and c"),
    ],
)
def test_unclosed_markup(value, page, text):
    assert value(tx.clean_html(F.col("x")), row=(page,)) == text
