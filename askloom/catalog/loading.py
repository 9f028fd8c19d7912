"""Dumps, staging tables, sinks and document assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import tables
from askloom.catalog.registry import query
from askloom.catalog.tables import SQL_ANSWERS, SQL_QA, SQL_QUESTIONS, SQL_TAGS
from askloom.operators import assemble
from askloom.plans.corpus import prepare_chunk_rows
from askloom.session import scratch_folder
from askloom.sources import dumps, sinks
from askloom.streaming.arrivals import streaming_insert_if_absent


def _dumped(spark, rows, label: str, null_value: str = "NA") -> str:
    """Write rows as a CSV dump and give its path."""
    path = scratch_folder(spark, label)
    sinks.csv_sink(rows, path, null_value=null_value, encoding="ISO-8859-1")
    return path


@query("csv_staging_scan", f"WITH {SQL_QUESTIONS} SELECT CAST(\"Id\" AS VARCHAR) AS \"Id\", "
       '"OwnerUserId", "CreationDate", "ClosedDate", CAST("Score" AS VARCHAR) AS "Score", '
       '"Title", "Body" FROM questions')
def csv_staging_scan(spark, sf):
    return dumps.read_questions(spark, _dumped(spark, tables.questions(spark, sf), "questions"))


@query("csv_split_scan", f"WITH {SQL_QUESTIONS} SELECT CAST(\"Id\" AS VARCHAR) AS \"Id\", "
       '"OwnerUserId", "CreationDate", "ClosedDate", CAST("Score" AS VARCHAR) AS "Score", '
       '"Title", "Body" FROM questions')
def csv_split_scan(spark, sf):
    """The same rows, with every multi-line file read in splits."""
    path = _dumped(spark, tables.questions(spark, sf), "questions")
    return dumps.read_questions(spark, path, one_task_bytes=0)


@query(
    "stage_questions",
    f"""WITH {SQL_QUESTIONS}
    SELECT "Id", CAST(CAST("OwnerUserId" AS DOUBLE) AS BIGINT) AS "OwnerUserId", "CreationDate",
           "ClosedDate", "Score", "Title", "Body" FROM questions""",
)
def stage_questions(spark, sf):
    path = _dumped(spark, tables.questions(spark, sf), "questions")
    return dumps.stage_questions(dumps.read_questions(spark, path))


@query("stage_answers", f"WITH {SQL_ANSWERS} SELECT * FROM answers")
def stage_answers(spark, sf):
    path = _dumped(spark, tables.answers(spark, sf), "answers")
    return dumps.stage_answers(dumps.read_answers(spark, path))


@query("stage_tags", f"WITH {SQL_TAGS} SELECT * FROM tags")
def stage_tags(spark, sf):
    path = _dumped(spark, tables.tags(spark, sf), "tags", null_value="")
    return dumps.stage_tags(dumps.read_tags(spark, path))


@query(
    "nullable_int_cast",
    """SELECT event_id, CAST(CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL
         ELSE trunc(value) END AS BIGINT) AS n FROM events""",
)
def nullable_int_cast(spark, sf):
    raw = (
        F.when(F.col("event_type") == "error", F.lit("NaN"))
        .when(F.col("event_type") == "signup", F.lit("unknown"))
        .otherwise(F.col("value").cast("string"))
    )
    return tables.table(spark, sf, "events").select(
        "event_id", dumps.nullable_int_cast(raw).alias("n")
    )


@query(
    "rename_columns",
    "SELECT c_custkey AS customer, c_name AS name, c_nationkey FROM customer",
)
def rename_columns(spark, sf):
    named = {"c_custkey": "customer", "c_name": "name", "not_there": "x"}
    return dumps.rename_columns(
        tables.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), named
    )


@query("document_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def document_scan(spark, sf):
    return dumps.read_documents(spark, f"{sf}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    )


@query(
    "insert_if_absent",
    """WITH known AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id))
    SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents
    WHERE text NOT IN (SELECT text FROM known) GROUP BY text""",
)
def insert_if_absent(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    stored = docs.join(tables.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    new = sinks.insert_if_absent(docs, stored, ["text"], ["doc_id"])
    return new.select("doc_id", F.md5("text").alias("digest"))


@query(
    "batched_insert",
    "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text",
)
def batched_insert(spark, sf):
    """The same insert twice: the second adds nothing."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    target = scratch_folder(spark, "inserted")
    sinks.write_if_absent(docs, target, ["text"], ["doc_id"])
    return sinks.write_if_absent(docs, target, ["text"], ["doc_id"]).select(
        "doc_id", F.md5("text").alias("digest")
    )


@query(
    "streaming_insert_if_absent",
    "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text",
)
def streaming_insert(spark, sf):
    stream = tables.table_stream(spark, sf, "documents").select("doc_id", "text")
    target = scratch_folder(spark, "arrived")
    running = streaming_insert_if_absent(
        stream, target, ["text"], ["doc_id"], scratch_folder(spark, "arrivals-log")
    )
    running.awaitTermination()
    # An empty stream writes no target.
    stored = sinks.stored_table(spark, target, stream.schema)
    return stored.select("doc_id", F.md5("text").alias("digest"))


# Windows of 64 words that start every 52 words, over the prepared text.
_SQL_SUNK = f"""
sized AS (
  SELECT question_id, answer_id, len({tables.sql_words(
      "'Title: ' || title || ' Tag: ' || tags || ' Question: ' || question || ' Answer: ' || answer"
  )}) AS n
  FROM prepared)"""


@query(
    "embedding_sink",
    f"""WITH {SQL_QA}, {tables.SQL_PREPARED}, {_SQL_SUNK}
    SELECT 'q' || question_id || '_a' || answer_id || '_c' || i AS chunk_id,
           CAST(i AS INTEGER) AS chunk_index, 256 AS dim
    FROM (SELECT *, unnest(range(0, CAST(ceil(n / 52.0) AS BIGINT))) AS i FROM sized)""",
)
def embedding_sink(spark, sf):
    rows = prepare_chunk_rows(
        tables.qa_pairs(spark, sf), size=64, overlap_share=0.2, dim=tables.DIM
    )
    stored = sinks.embedding_sink(rows, scratch_folder(spark, "embeddings"))
    return stored.select("chunk_id", "chunk_index", "dim")


def _chunk_rows(spark, sf):
    """Documents as chunk rows, some of which break the contract."""
    toxic = tables.table(spark, sf, "labels").where(F.col("toxic") == 1).select(
        "doc_id", F.lit(True).alias("toxic")
    )
    return tables.table(spark, sf, "documents").join(toxic, "doc_id", "left").select(
        F.concat(F.lit("d"), "doc_id").alias("chunk_id"),
        F.col("doc_id").alias("question_id"),
        F.when(F.col("lang") == "es", F.lit("none"))
        .otherwise(F.col("doc_id").cast("string"))
        .alias("answer_id"),
        F.lit(0).alias("chunk_index"),
        F.col("source").alias("title"),
        F.col("lang").alias("tags"),
        F.lit(1).alias("question_score"),
        F.lit(1).alias("answer_score"),
        F.col("text").alias("chunk_text"),
        F.when(F.col("toxic").isNull(), F.array(F.col("n_chars").cast("float"))).alias("embedding"),
    )


@query(
    "chunk_sink_contract",
    """SELECT 'd' || doc_id AS chunk_id,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'embedding is missing'
            WHEN lang = 'es' THEN 'answer_id is not a whole number' ELSE 'valid' END AS verdict
    FROM documents""",
)
def chunk_sink_contract(spark, sf):
    chunks = _chunk_rows(spark, sf)
    valid, rejects = sinks.chunk_sink_contract(chunks)
    return valid.select("chunk_id", F.lit("valid").alias("verdict")).unionByName(
        rejects.select("chunk_id", F.col("reason").alias("verdict"))
    )


@query(
    "chunk_sink",
    """SELECT 'd' || doc_id AS chunk_id, doc_id AS question_id, lang AS tags FROM documents
    WHERE lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def chunk_sink(spark, sf):
    """Stored twice: the second time adds nothing."""
    target = scratch_folder(spark, "qa-chunks")
    sinks.chunk_sink(_chunk_rows(spark, sf), target)
    stored, _ = sinks.chunk_sink(_chunk_rows(spark, sf), target)
    return stored.select("chunk_id", "question_id", "tags")


@query(
    "csv_sink",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders",
)
def csv_sink(spark, sf):
    path = scratch_folder(spark, "csv")
    rows = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    sinks.csv_sink(rows, path, sep=";")
    return spark.read.schema("o_orderkey string, o_orderpriority string").csv(
        path, header=True, sep=";"
    )


# --------------------------------------------------------------------------
# assembly

_SQL_QA_DOCUMENTS = f"""
{SQL_QUESTIONS}, {SQL_ANSWERS}, {SQL_TAGS},
tag_lists AS (
  SELECT "Id" AS question_id, string_agg("Tag", ', ' ORDER BY "Tag") AS tags FROM tags GROUP BY 1),
qa_documents AS (
  SELECT q."Id" AS question_id, a."Id" AS answer_id, q."Title" AS title,
         q."Body" AS question_body, a."Body" AS answer_body, q."Score" AS question_score,
         a."Score" AS answer_score, t.tags
  FROM questions q JOIN answers a ON a."ParentId" = q."Id"
  LEFT JOIN tag_lists t ON t.question_id = q."Id")"""


def _qa_documents(spark, sf):
    return assemble.qa_assemble(
        tables.questions(spark, sf), tables.answers(spark, sf), tables.tags(spark, sf),
        tag_rows=tables.most_tags(spark, sf),
    )


@query("tags_string_agg", f"WITH {_SQL_QA_DOCUMENTS} SELECT question_id, tags FROM tag_lists")
def tags_string_agg(spark, sf):
    return assemble.tags_string_agg(tables.tags(spark, sf), rows=tables.most_tags(spark, sf))


@query("qa_assemble", f"WITH {_SQL_QA_DOCUMENTS} SELECT * FROM qa_documents")
def qa_assemble(spark, sf):
    return _qa_documents(spark, sf)


def _scored(spark, sf):
    """Scores of all answers; the smallest score counts as missing."""
    return tables.answers(spark, sf).select(
        F.col("ParentId").alias("question_id"),
        F.col("Id").alias("answer_id"),
        F.nullif(F.col("Score"), F.lit(1)).alias("answer_score"),
    )


_SQL_SCORED = f"""
{SQL_ANSWERS},
scored AS (
  SELECT "ParentId" AS question_id, "Id" AS answer_id, nullif("Score", 1) AS answer_score
  FROM answers)"""


@query(
    "best_answer_ties",
    f"""WITH {_SQL_SCORED}, best AS (
      SELECT question_id, max(answer_score) AS m FROM scored GROUP BY 1)
    SELECT s.* FROM scored s JOIN best b
      ON s.question_id = b.question_id AND s.answer_score = b.m""",
)
def best_answer_ties(spark, sf):
    return assemble.best_answer_ties(_scored(spark, sf))


@query(
    "best_answer_one",
    f"""WITH {_SQL_SCORED}
    SELECT question_id, answer_id, answer_score FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id
                                   ORDER BY answer_score DESC NULLS LAST, answer_id) AS place
      FROM scored) WHERE place = 1""",
)
def best_answer_one(spark, sf):
    return assemble.best_answer_one(_scored(spark, sf))
