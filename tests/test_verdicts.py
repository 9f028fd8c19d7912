import pytest
from pyspark.sql import functions as F

from askloom.functions import verdicts as vd
from askloom.operators import judging

def X():
    return F.col("x")


@pytest.mark.parametrize(
    "text, score",
    [("0.7", 0.7), ("8/10", 1.0), ("-0.5", 0.5), (".5", 1.0), ("none", 0.0), (None, 0.0), ("a 0.25.", 0.25)],
)
def test_judge_score(value, text, score):
    assert value(vd.judge_score(X()), row=(text,)) == score


@pytest.mark.parametrize("text", ["not json", None, "", "[1]", '{"faithfulness": '])
def test_unusable_verdicts(value, text):
    got = value(vd.judge_json(X()), row=(text,))
    assert got.asDict() == {
        "faithfulness": 0.0, "answer_relevance": 0.0, "context_relevance": 0.0,
        "is_grounded": False, "reason": "invalid json",
    }


def test_judge_json(value):
    got = value(
        vd.judge_json(X()),
        row=('{"faithfulness": 1, "answer_relevance": 0.5, "is_grounded": true, "reason": "ok"}',),
    )
    assert (got.faithfulness, got.answer_relevance, got.context_relevance) == (1.0, 0.5, 0.0)
    assert got.is_grounded and got.reason == "ok"


@pytest.mark.parametrize(
    "text, action, reason, route",
    [
        ("oops", "search_documents", "fallback_to_search", "search_documents"),
        (None, "search_documents", "fallback_to_search", "search_documents"),
        ('{"action": "reject", "reason": "short"}', "reject", "short", "reject"),
        ('{"action": "dance"}', "dance", None, "search_documents"),
        ('{"action": "reject"} ok', "search_documents", "fallback_to_search", "search_documents"),
        ('{"action": "reject"}{"action": "reject"}', "search_documents", "fallback_to_search", "search_documents"),
        ('{"action": "reject"}, {}', "search_documents", "fallback_to_search", "search_documents"),
        ('{"action": "reject"}] x', "search_documents", "fallback_to_search", "search_documents"),
        ('{"action": "reject"}} x', "search_documents", "fallback_to_search", "search_documents"),
        (' {"action": "reject", "reason": "r"}\n', "reject", "r", "reject"),
        ("", "search_documents", "fallback_to_search", "search_documents"),
        ("[]", "search_documents", "fallback_to_search", "search_documents"),
        ('{"reason": "r"}', None, "r", "search_documents"),
    ],
)
def test_agent_decision(value, text, action, reason, route):
    got = value(vd.agent_decision(X()), row=(text,))
    assert (got.action, got.reason, got.route) == (action, reason, route)


def test_faithfulness(value):
    got = value(vd.faithfulness_verdict(X()), row=("Faithful: Yes\nComments: all\nthere",))
    assert got.faithful is True and got.comments == "all\nthere"
    assert value(vd.faithfulness_verdict(X()), row=("FAITHFUL: no",)).faithful is False
    assert value(vd.faithfulness_verdict(X()), row=("maybe",)).faithful is None


def test_pseudo_labels(spark):
    ranked = spark.createDataFrame([(1, "a", 0), (1, "b", 3), (2, "c", 0)], "query_id int, chunk_id string, chunk_index int")
    said = spark.createDataFrame([(1, "relevant: [3, 3, 9]")], "query_id int, model_output string")
    got = {r["chunk_id"]: r["relevant"] for r in judging.pseudo_labels(ranked, said).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_score_chunks(spark):
    df = spark.createDataFrame([("q", "0.4 good")], "text string, chunk_text string")
    assert judging.score_chunks(df, lambda q, c: c).first()["llm_score"] == 0.4
