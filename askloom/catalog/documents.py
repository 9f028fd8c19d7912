"""Documents, chunks, postings and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.catalog import tables
from askloom.catalog.registry import query
from askloom.catalog.tables import (
    DIM,
    SQL_CHUNKS,
    SQL_PREPARED,
    SQL_QA,
    SQL_QUERIES,
    sql_clean,
    sql_tokens,
    sql_vectors,
    sql_words,
)
from askloom.functions import chunking as ck
from askloom.functions import text as tx
from askloom.operators import gates
from askloom.operators.lexical import postings
from askloom.operators.rerank import pair_text
from askloom.operators.vectors import embed_text
from askloom.plans.corpus import HASHED_MODEL, prepare_chunk_rows
from askloom.session import land

_FIELDS = ("title", "tags", "question_body", "answer_body")


def _scaled(vector: Column) -> Column:
    """A vector as text with four decimals, for comparison."""
    return F.array_join(
        F.transform(vector, lambda x: F.round(x.cast("double") * 10000).cast("int")), ","
    )


@query(
    "prepare_document",
    f"WITH {SQL_QA}, {SQL_PREPARED} SELECT * FROM prepared",
)
def prepare_document(spark, sf):
    doc = tx.prepare_document(*map(F.col, _FIELDS))
    return tables.qa_pairs(spark, sf).select("question_id", "answer_id", doc.alias("d")).select(
        "question_id", "answer_id", "d.*"
    )


@query(
    "document_text",
    f"""WITH {SQL_QA}
    SELECT question_id, answer_id,
           'Title: ' || title || chr(10) || chr(10) || 'Tags: ' || coalesce(tags, '')
           || chr(10) || chr(10) || 'Question: ' || {sql_clean('question_body')}
           || chr(10) || chr(10) || 'Best Answer: ' || {sql_clean('answer_body')} AS document_text
    FROM qa""",
)
def document_text(spark, sf):
    built = tx.document_text(
        F.col("title"), F.col("tags"), tx.clean_html(F.col("question_body")),
        tx.clean_html(F.col("answer_body")),
    )
    return tables.qa_pairs(spark, sf).select("question_id", "answer_id", built.alias("document_text"))


@query(
    "embedding_text",
    f"""WITH {SQL_QA}, {SQL_PREPARED}
    SELECT question_id, answer_id,
           trim(concat_ws(chr(10),
             CASE WHEN title <> '' THEN 'Title: ' || title END,
             CASE WHEN tags <> '' THEN 'Tag: ' || tags END,
             CASE WHEN question <> '' THEN 'Question: ' || question END,
             CASE WHEN answer <> '' THEN 'Answer: ' || answer END)) AS embedding_text
    FROM prepared""",
)
def embedding_text(spark, sf):
    prepared = prepare_document(spark, sf)
    built = tx.embedding_text(*map(F.col, ("title", "tags", "question", "answer")))
    return prepared.select("question_id", "answer_id", built.alias("embedding_text"))


_SQL_SOURCE = """
source AS (
  SELECT question_id, answer_id,
         'Title: ' || title || ' Tag: ' || tags || ' Question: ' || question
         || ' Answer: ' || answer AS source_text
  FROM prepared)"""


@query(
    "chunk_source_text",
    f"WITH {SQL_QA}, {SQL_PREPARED}, {_SQL_SOURCE} SELECT * FROM source",
)
def chunk_source_text(spark, sf):
    prepared = prepare_document(spark, sf)
    built = tx.chunk_source_text(*map(F.col, ("title", "tags", "question", "answer")))
    return prepared.select("question_id", "answer_id", built.alias("source_text"))


# Windows of 64 words that start every 52 words (a fifth overlaps, rounded down).
_QA_CHUNKS = f"""
qa_words AS (SELECT question_id, answer_id, {sql_words('source_text')} AS w FROM source),
qa_chunks AS (
  SELECT 'q' || question_id || '_a' || answer_id || '_c' || i AS chunk_id,
         CAST(i AS INTEGER) AS chunk_index,
         array_to_string(w[i * 52 + 1 : i * 52 + 64], ' ') AS chunk_text
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / 52.0) AS BIGINT))) AS i FROM qa_words))"""


def _vector_text(source: str, key: str, text: str) -> str:
    """SQL for the scaled text of the hashed vector of every row."""
    return f"""
    {sql_vectors(source, key, text, 'vec')},
    grid AS (SELECT {key}, unnest(range(0, {DIM})) AS bucket FROM {source}),
    vector_text AS (
      SELECT grid.{key},
             string_agg(CAST(CAST(round(coalesce(w, 0) * 10000) AS INTEGER) AS VARCHAR), ','
                        ORDER BY grid.bucket) AS vector
      FROM grid LEFT JOIN vec ON vec.{key} = grid.{key} AND vec.bucket = grid.bucket
      GROUP BY grid.{key})"""


@query(
    "prepare_chunk_rows",
    f"""WITH {SQL_QA}, {SQL_PREPARED}, {_SQL_SOURCE}, {_QA_CHUNKS},
    {_vector_text('qa_chunks', 'chunk_id', 'chunk_text')}
    SELECT chunk_id, chunk_index, chunk_text, '{HASHED_MODEL}' AS model_name, vector
    FROM qa_chunks JOIN vector_text USING (chunk_id)""",
)
def prepare_rows(spark, sf):
    rows = prepare_chunk_rows(tables.qa_pairs(spark, sf), size=64, overlap_share=0.2, dim=DIM)
    return rows.select(
        "chunk_id", "chunk_index", "chunk_text", "model_name",
        _scaled(F.col("embedding")).alias("vector"),
    )


@query(
    "chunk_id",
    f"""WITH {SQL_QA}
    SELECT 'q' || question_id || '_a' || answer_id || '_c' || (question_score % 7) AS chunk_id
    FROM qa""",
)
def chunk_ids(spark, sf):
    return tables.qa_pairs(spark, sf).select(
        ck.chunk_id(
            F.col("question_id"), F.col("answer_id"), F.col("question_score") % 7
        ).alias("chunk_id")
    )


@query(
    "dimension_bucket",
    """SELECT doc_id, CAST(CASE WHEN w <= 256 THEN 256 WHEN w <= 384 THEN 384
       WHEN w <= 512 THEN 512 WHEN w <= 1024 THEN 1024 WHEN w <= 2048 THEN 2048
       WHEN w <= 4096 THEN 4096 END AS INTEGER) AS bucket
    FROM (SELECT doc_id, n_chars AS w FROM documents)""",
)
def dimension_buckets(spark, sf):
    return tables.table(spark, sf, "documents").select(
        "doc_id", ck.dimension_bucket(F.col("n_chars"), refuse=False).alias("bucket")
    )


@query(
    "chunk_overlap",
    f"WITH {SQL_CHUNKS} SELECT chunk_id, chunk_index, chunk_text FROM chunks",
)
def chunk_overlap(spark, sf):
    return tables.document_chunks(spark, sf).select("chunk_id", "chunk_index", "chunk_text")


@query(
    "min_chars_filter",
    f"""WITH {SQL_CHUNKS}
    SELECT chunk_id, length(chunk_text) AS chars FROM chunks
    WHERE length(trim(chunk_text)) >= 200""",
)
def min_chars_filter(spark, sf):
    return gates.min_chars_filter(tables.document_chunks(spark, sf), 200).select(
        "chunk_id", F.length("chunk_text").cast("bigint").alias("chars")
    )


@query(
    "embed_text",
    f"""WITH {SQL_QUERIES}, {_vector_text('queries', 'query_id', 'text')}
    SELECT query_id, vector FROM vector_text""",
)
def embed_queries(spark, sf):
    return embed_text(tables.benchmark_queries(spark, sf), dim=DIM).select(
        "query_id", _scaled(F.col("embedding")).alias("vector")
    )


@query(
    "postings",
    f"""WITH {SQL_CHUNKS},
    t AS (SELECT chunk_id, {sql_tokens('chunk_text')} AS ts FROM chunks)
    SELECT term, chunk_id, CAST(count(*) AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl
    FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL""",
)
def chunk_postings(spark, sf):
    return postings(land(tables.document_chunks(spark, sf), "chunks"))


@query(
    "pair_text",
    f"""WITH {SQL_CHUNKS}
    SELECT chunk_id, chunk_index || ' ' || chunk_text AS pair_text FROM chunks""",
)
def pair_texts(spark, sf):
    return tables.document_chunks(spark, sf).select(
        "chunk_id", pair_text(F.col("chunk_index"), F.col("chunk_text")).alias("pair_text")
    )
