"""The registered queries against their SQL, and the pipeline against brute force."""

import os
import sys

import duckdb
import pytest

import corpus_pipeline
from askloom.llm import bpe, queries

sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
from check import TABLES, rows_of  # noqa: E402

from .test_text_operators import brute_components, shingles  # noqa: E402
from .test_tokens import expected  # noqa: E402


def test_names():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_pipeline_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in queries.op6_quality_classifier(spark, sf).where("predicted = 1").collect()}
    left = {d: t for d, t in rows.items() if d in good}
    last = {t: max(d for d in left if left[d] == t) for t in left.values()}
    left = {d: t for t, d in last.items()}
    near = brute_components(sorted(left.items()), 80)
    left = {d: t for d, t in left.items() if near[d][2]}
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, t in left.items() for q in items if 100 * len(shingles(t) & q) >= 80 * len(q)}
    want = {d: expected(t) for d, t in left.items() if d not in leaks}
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_pipeline_stages_take_awkward_rows(spark, sf, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert made.columns == docs.columns, name
            assert made.count() <= docs.count(), name
    assert bpe.round_trip(awkward).count() == awkward.count()


def test_pipeline_decides_row_by_row(spark, sf):
    """Null ids and repeated ids: a poor, copied or leaking row takes no other with it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    score = {r.doc_id: r.score for r in queries.op6_quality_classifier(spark, sf).collect()}
    good, bad = (texts[f(score, key=score.get)] for f in (max, min))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    words = [f"w{i}" for i in range(80)]
    near = [" ".join(words), " ".join(words[:-1] + ["other"])]
    clean = ["one clean text without an id", "a second clean text of its own"]

    def left(stage, some):
        made = spark.createDataFrame(some, "doc_id long, text string")
        return sorted((tuple(r) for r in stage(spark, made, sf).collect()), key=repr)

    def same(got, want):
        assert got == sorted(want, key=repr)

    for i in (None, 10**9):
        kept = left(corpus_pipeline.keep_good_quality, [*texts.items(), (i, good), (i, bad)])
        assert (i, good) in kept and (i, bad) not in kept
        same(left(corpus_pipeline.drop_exact_copies, [(i, clean[0]), (i, clean[0]), (i, clean[1]), (5, near[0])]),
             [(i, clean[0]), (i, clean[1]), (5, near[0])])
        same(left(corpus_pipeline.drop_near_copies, [(i, near[0]), (i, near[0]), (i, clean[0]), (i, clean[1])]),
             [(i, near[0]), (i, clean[0]), (i, clean[1])])
        same(left(corpus_pipeline.drop_benchmark_leaks, [(i, leak), (i, clean[0]), (i, clean[1])]),
             [(i, clean[0]), (i, clean[1])])
    same(left(corpus_pipeline.drop_exact_copies, [(None, near[0]), (3, near[0]), (4, near[0])]), [(4, near[0])])
    same(left(corpus_pipeline.drop_near_copies, [(None, near[0]), (4, near[0]), (3, near[1])]), [(3, near[1])])
