import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from askloom.functions import chunking as ck
from askloom.plans.corpus import prepare_chunk_rows


def windows(spark, n, size, share, **options):
    text = " ".join(str(i) for i in range(1, n + 1))
    df = spark.createDataFrame([(7, text)], "doc int, x string")
    rows = ck.chunk_overlap(df, "x", size, share, **options).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    return [[int(w) for w in r["chunk_text"].split()] for r in rows]


def test_windows_start_while_tokens_last(spark):
    assert windows(spark, 10, 4, 0.5) == [
        [1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7, 8], [7, 8, 9, 10], [9, 10],
    ]
    assert windows(spark, 10, 4, 0.5, drop_contained=True)[-1] == [7, 8, 9, 10]


def test_no_tokens_no_windows(spark):
    assert windows(spark, 0, 4, 0.5) == []


def test_overlap_must_leave_a_step():
    with pytest.raises(ValueError):
        ck.window_step(4, 1.0)


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.sampled_from([0.0, 0.2, 0.5]), st.booleans())
def test_windows_cover_all_tokens(spark, n, size, share, drop):
    got = windows(spark, n, size, share, drop_contained=drop)
    assert sorted({t for w in got for t in w}) == list(range(1, n + 1))


def test_chunk_id(value):
    assert value(ck.chunk_id(F.lit(7), F.lit(9), F.lit(0))) == "q7_a9_c0"


@pytest.mark.parametrize(
    "width, bucket",
    [(1, 256), (256, 256), (257, 384), (384, 384), (385, 512), (512, 512), (513, 1024), (4096, 4096)],
)
def test_dimension_bucket(value, width, bucket):
    assert value(ck.dimension_bucket(F.col("w")), "w int", (width,)) == bucket


def test_too_wide_a_vector_is_refused(value):
    with pytest.raises(PySparkException):
        value(ck.dimension_bucket(F.col("w")), "w int", (4097,))


def test_prepared_rows(spark):
    qa = spark.createDataFrame(
        [(7, 9, "How  To", "python", "<p>Why?</p>", "<b>So</b>")],
        "question_id long, answer_id long, title string, tags string, question_body string, "
        "answer_body string",
    )
    rows = prepare_chunk_rows(qa, size=6, overlap_share=0.5, dim=16).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == ["q7_a9_c0", "q7_a9_c1", "q7_a9_c2"]
    assert rows[0]["chunk_text"] == "Title: how to Tag: python Question:"
    for row in rows:
        assert sum(x * x for x in row["embedding"]) == pytest.approx(1.0, abs=1e-5)


def test_tokenizer_plug_in(spark):
    """A model's tokenizer as pandas UDFs, for tokens and for the texts of windows."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(list)

    @F.pandas_udf("array<string>")
    def spelt(windows: pd.Series) -> pd.Series:
        return windows.map(lambda row: ["".join(tokens).strip() for tokens in row])

    df = spark.createDataFrame([(1, "abcd  efg"), (2, "")], "id int, t string")
    got = ck.chunk_overlap(df, "t", 4, 0.5, tokens=letters, joiner=spelt)
    assert [tuple(r) for r in got.orderBy("id", "chunk_index").collect()] == [
        (1, 0, "abcd"), (1, 1, "cd"), (1, 2, "ef"), (1, 3, "efg"), (1, 4, "g"),
    ]


def test_best_answers_to_document_texts(spark):
    from askloom.plans.corpus import document_texts

    qa = spark.createDataFrame(
        [(1, 10, " The  Title", "<p>Q</p>", "<p>worse</p>", 5, 1, "x"), (1, 11, " The  Title", "<p>Q</p>", "<b>Best</b> one", 5, 3, "x")],
        "question_id long, answer_id long, title string, question_body string, answer_body string, question_score int, answer_score int, tags string",
    )
    got = document_texts(qa).collect()
    assert [(r.question_id, r.answer_id) for r in got] == [(1, 11)]
    assert "the title" in got[0].document_text and "best one" in got[0].document_text
