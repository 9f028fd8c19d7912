import pytest
from pyspark.sql import functions as F

from askloom.operators import context, evaluate, fusion, gates, rerank


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")


def fused_order(df):
    return [(r["chunk_id"], r["rrf_score"]) for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    vector, lexical = ranked(spark, [(1, "a", 1), (1, "b", 2)]), ranked(spark, [(1, "b", 1), (1, "c", 2)])
    got = fused_order(fusion.rrf(fusion.union_lists(vector=vector, bm25=lexical)))
    assert got == [("b", 1 / 12 + 1 / 11), ("a", 1 / 11), ("c", 1 / 12)]


def test_rrf_ties_keep_the_first_list_first(spark):
    vector, lexical = ranked(spark, [(1, "z", 1)]), ranked(spark, [(1, "a", 1)])
    got = fused_order(fusion.rrf(fusion.union_lists(vector=vector, bm25=lexical)))
    assert got == [("z", 1 / 11), ("a", 1 / 11)]
    swapped = fused_order(fusion.rrf(fusion.union_lists(bm25=lexical, vector=vector)))
    assert sorted(swapped) == sorted(got) and swapped[0][0] == "a"


def test_merge_prefers_the_vector_row(spark):
    vector = spark.createDataFrame([(1, "a", "from vector", 0.1)], "query_id int, chunk_id string, chunk_text string, distance double")
    lexical = spark.createDataFrame(
        [(1, "a", "from bm25", 7.0), (1, "b", "only bm25", 3.0)],
        "query_id int, chunk_id string, chunk_text string, bm25_score double",
    )
    got = {r["chunk_id"]: r for r in fusion.merge_ranked(vector, lexical).collect()}
    assert (got["a"]["chunk_text"], got["a"]["bm25_score"]) == ("from vector", 7.0)
    assert got["a"]["in_vector"] and got["a"]["in_bm25"]
    assert (got["b"]["chunk_text"], got["b"]["in_vector"], got["b"]["in_bm25"]) == ("only bm25", False, True)


def test_dedupe_keeps_the_row_as_it_is(spark):
    rows = ranked(spark, [(1, "x", 2), (1, " x ", 1), (1, "y", 3)])
    got = fusion.dedupe_chunks(rows, F.col("rank")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [" x ", "y"]


@pytest.mark.parametrize(
    "text, reason",
    [("ab", "too short"), ("  a", None), ("DROP TABLE t", "unsafe"), ("how to", None), ("x System Prompt", "unsafe")],
)
def test_moderation(spark, text, reason):
    row = gates.moderation_gate(spark.createDataFrame([(1, text)], "query_id int, text string")).first()
    assert (row["reject_reason"], row["is_allowed"]) == (reason, reason is None)


@pytest.mark.parametrize("k, reason", [(60, "low_retrieval_confidence"), (10, None)])
def test_retrieval_gate(spark, k, reason):
    vector = ranked(spark, [(1, "a", 1)]).withColumn("distance", F.lit(0.1))
    lexical = ranked(spark, []).withColumn("score", F.lit(0.1))
    fused = fusion.fuse_lists(vector, lexical, k)
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r["query_id"]: r for r in gates.retrieval_gate(queries, fused).collect()}
    assert got[1]["fallback_reason"] == reason and got[1]["retrieval_ok"] == (reason is None)
    assert got[2]["fallback_reason"] == "no_chunks"


def test_top1_gate(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.0), (2, 1, 0.01)], "query_id int, rank int, rrf_score double")
    got = {r["query_id"]: r["retrieval_passed"] for r in gates.top1_gate(queries, rows).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_routes(spark):
    rows = spark.createDataFrame(
        [(1, False, "unsafe", True), (2, True, None, False), (3, True, None, True), (4, False, None, True)],
        "query_id int, is_allowed boolean, reject_reason string, retrieval_ok boolean",
    )
    got = {r["query_id"]: (r["route"], r["canned_answer"]) for r in gates.route_outcome(rows, rejection="no", fallback="nothing found").collect()}
    assert got == {
        1: ("reject", "unsafe"), 2: ("fallback", "nothing found"), 3: ("answer", None),
        4: ("reject", "no"),
    }


def test_rerank_is_stable(spark):
    pairs = spark.createDataFrame(
        [(1, "red cat", "a", 0, "a red dog", 1), (1, "red cat", "b", 1, "no", 2), (1, "red cat", "c", 2, "CAT", 3)],
        "query_id int, text string, chunk_id string, chunk_index int, chunk_text string, rrf_rank int",
    )
    got = rerank.rerank(pairs, 2).orderBy("rerank_rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in got] == [("a", 0.5), ("c", 0.5)]
    assert rerank.rerank(pairs.limit(0), 2).count() == 0


def test_search_tool(spark):
    reranked = spark.createDataFrame([(1, "a", 0.5)], "query_id int, chunk_id string, rerank_score double")
    fused = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, chunk_id string")
    got = {(r["query_id"], r["chunk_id"]) for r in rerank.search_tool(reranked, fused).collect()}
    assert got == {(1, "a"), (2, "y")}


def test_context_numbers_skip_blank_chunks(spark):
    rows = spark.createDataFrame([(1, 1, " a "), (1, 2, "  "), (1, 3, "c"), (2, 1, None)], "query_id int, rank int, chunk_text string")
    got = {r["query_id"]: r["context"] for r in context.build_context(rows).collect()}
    assert got == {1: "[Source 1]\nText: a\n\n[Source 3]\nText: c", 2: ""}


def test_agent_context(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.5, "t"), (1, 2, "b", None, None)], "query_id int, rank int, chunk_id string, rerank_score double, chunk_text string")
    assert context.agent_context(rows).first()["context"] == (
        "[Document 1]\nchunk_id: a\nrerank_score: 0.5\ntext: t\n\n"
        "[Document 2]\nchunk_id: b\nrerank_score: None\ntext: None"
    )


def test_prompt_keeps_braces(value):
    parts = {"system": "Be brief.", "human": ("Q: ", " C: ", " A:")}
    got = value(context.build_prompt(F.lit("{q}"), F.lit("{context}"), **parts))
    assert got == "Be brief.\nQ: {q} C: {context} A:"


def judged(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, gain double")


def test_ndcg_example(spark):
    rows = judged(spark, [(1, "a", 1, 1.0), (1, "c", 2, 1.0), (1, "b", 3, 0.0), (1, "d", 4, 0.0)])
    counts = evaluate.gain_counts(rows)
    assert evaluate.ndcg_at_k(rows, counts, 3).first()["ndcg"] == pytest.approx(1.0)


def test_ndcg_with_graded_gains(spark):
    import math

    rows = judged(spark, [(1, "a", 1, 1.0), (1, "b", 2, 3.0), (2, "x", 1, 0.0)])
    counts = spark.createDataFrame([(1, 3.0, 1), (1, 1.0, 5), (2, 0.0, 1)], "query_id int, gain double, n long")
    got = {r["query_id"]: r["ndcg"] for r in evaluate.ndcg_at_k(rows, counts, 3).collect()}
    dcg = 1 + 3 / math.log2(3)
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert got[1] == pytest.approx(dcg / ideal) and got[2] == 0.0


def test_recall_and_mrr(spark):
    rows = judged(spark, [(1, "a", 1, 0.0), (1, "b", 2, 1.0), (2, "x", 1, 0.0)])
    counts = spark.createDataFrame([(1, 1.0, 4), (2, 0.0, 3)], "query_id int, gain double, n long")
    recall = {r["query_id"]: r["recall"] for r in evaluate.recall_at_k(rows, counts, 2).collect()}
    assert recall == {1: 0.25, 2: None}
    mrr = {r["query_id"]: r["reciprocal_rank"] for r in evaluate.mrr(rows).collect()}
    assert mrr == {1: 0.5, 2: 0.0}
    mean = evaluate.mean_over_queries(evaluate.recall_at_k(rows, counts, 2), "recall").first()
    assert (mean["mean_recall"], mean["n_queries"]) == (0.25, 1)


def test_judge_ranked(spark):
    relevant = spark.createDataFrame([(1, "b", 2)], "query_id int, chunk_id string, gain int")
    got = {r["chunk_id"]: r["gain"] for r in evaluate.judge_ranked(ranked(spark, [(1, "a", 1), (1, "b", 2)]), relevant).collect()}
    assert got == {"a": 0.0, "b": 2.0}
