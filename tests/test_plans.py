"""What the physical plans may and may not hold."""

import pytest
from pyspark.sql import functions as F

from askloom.catalog import prepared, registry, tables
from askloom.functions import text as tx
from askloom.operators import assemble, fusion, lexical, vectors
from askloom.session import fits_broadcast, scratch_folder, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_limited_before_the_shuffle(spark, sf):
    t = prepared.search_tables(spark, sf)
    for df in (
        vectors.vector_topk(t.chunks, t.queries, 5),
        lexical.lexical_topk(t.index, t.queries, 5),
        assemble.best_answer_one(
            spark.createDataFrame([(1, 1, 1)], "question_id int, answer_id int, answer_score int")
        ),
        fusion.topk_per_query(spark.createDataFrame([(1, "a", 1)], "query_id int, chunk_id string, rank int"), 2, F.col("rank")),
    ):
        assert "WindowGroupLimit" in plan(df)


NATIVE = [
    "clean_html", "normalize_body", "squeeze_space", "drop_stopwords", "simple_tokens",
    "chunk_overlap", "postings", "qa_assemble", "best_answer_ties", "tags_string_agg",
    "judge_json", "agent_decision", "step_latency_histogram", "best_gain", "runs_with_sum",
]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(registry.load()[0][name](spark, sf))
    for node in ("Python", "ArrowEval", "MapIn", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_text_work_does_not_shuffle(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    text = plan(pages.select("page_id", tx.clean_html(F.col("html"))))
    assert "Exchange" not in text and "url" not in text.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, sf):
    text = plan(registry.load()[0]["conjunctive_filter"](spark, sf))
    assert "PushedFilters: [" in text and "EqualTo(o_orderstatus,F)" in text


def test_index_reads_only_the_folders_it_probes(spark, sf):
    index = lexical.write_index(tables.document_chunks(spark, sf), scratch_folder(spark, "i"), buckets=32)
    probes = spark.createDataFrame([(1, "the")], "query_id int, term string")
    text = plan(lexical._in_buckets(index, probes))
    assert "PartitionFilters: [isnotnull(bucket" in text


def test_size_check(spark):
    assert fits_broadcast(spark.range(10), max_rows=10)
    assert not fits_broadcast(spark.range(11), max_rows=10)
    assert not fits_broadcast(spark.range(10), max_rows=10, max_bytes=20)


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 100, 1, 8)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4


def test_scratch_folder_is_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_folder(spark, "x").startswith(root + "/x-")
