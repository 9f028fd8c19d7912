"""The provided tables in the roles the operators expect, and the same mapping
as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.chunking import chunk_overlap
from askloom.operators.skew import ROWS_PER_TASK, deal_by_rows, spread_join
from askloom.session import spread
from askloom.sources.dumps import path_exists

CHUNK_SIZE = 128
CHUNK_OVERLAP = 0.25
CHUNK_STEP = 96
DIM = 256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files: one file, or a folder of them."""
    path = f"{sf}/{name}.parquet"
    files = spark.readStream.schema(table(spark, sf, name).schema)
    if path_exists(spark, f"{path}/*"):
        return files.parquet(path)
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A table whose texts are worked on row by row, over all cores."""
    return spread(table(spark, sf, name).select(*columns))


# --------------------------------------------------------------------------
# questions, answers and tags from the order tables


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Id"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("OwnerUserId"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("CreationDate"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias(
            "ClosedDate"
        ),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("Score"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(' "'), "o_orderpriority", F.lit('"')).alias(
            "Title"
        ),
        F.concat(F.lit("<p>Status "), "o_orderstatus", F.lit(",\nby "), "o_custkey", F.lit("</p>"))
        .alias("Body"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    every = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = texts(
        spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus",
    )
    return lines.select(
        F.conv(F.substring(F.md5(every), 1, 15), 16, 10).cast("bigint").alias("Id"),
        F.col("l_suppkey").alias("OwnerUserId"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("CreationDate"),
        F.col("l_orderkey").alias("ParentId"),
        F.col("l_quantity").cast("int").alias("Score"),
        F.concat(F.lit("<p>"), "l_returnflag", F.lit(" &amp; "), "l_linestatus", F.lit("</p>"))
        .alias("Body"),
    )


def tags(
    spark: SparkSession, sf: str, *, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The number of tasks follows the rows; a grouping by question and tag uses
    the same tasks again."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = texts(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    rows = most_tags(spark, sf)
    tagged = spread_join(
        lines, part, "l_partkey", rows_per_task=rows_per_task, rows=rows
    ).select(F.col("l_orderkey").alias("Id"), F.col("p_brand").alias("Tag"))
    return deal_by_rows(tagged, rows, "Id", "Tag", rows_per_task=rows_per_task).distinct()


def most_tags(spark: SparkSession, sf: str) -> int:
    """At most how many rows ``tags`` has, part keys being unique."""
    return table(spark, sf, "lineitem").count()


SQL_QUESTIONS = """
questions AS (
  SELECT o_orderkey AS "Id", o_custkey || '.0' AS "OwnerUserId",
         strftime(o_orderdate, '%Y-%m-%d') AS "CreationDate",
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS "ClosedDate",
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS "Score",
         'Order ' || o_orderkey || ' "' || o_orderpriority || '"' AS "Title",
         '<p>Status ' || o_orderstatus || ',' || chr(10) || 'by ' || o_custkey || '</p>' AS "Body"
  FROM orders)"""
SQL_ANSWERS = """
answers AS (
  SELECT CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                             1, 15) AS BIGINT) AS "Id",
         l_suppkey AS "OwnerUserId", strftime(l_shipdate, '%Y-%m-%d') AS "CreationDate",
         l_orderkey AS "ParentId", CAST(l_quantity AS INTEGER) AS "Score",
         '<p>' || l_returnflag || ' &amp; ' || l_linestatus || '</p>' AS "Body"
  FROM lineitem)"""
SQL_TAGS = """
tags AS (
  SELECT DISTINCT l_orderkey AS "Id", p_brand AS "Tag"
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


# --------------------------------------------------------------------------
# question-answer documents from conversations


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    turns = texts(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("asked")
    )
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("replied")
    )
    return asked.join(replies, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("question_id"),
        (F.col("turn") + 1).alias("answer_id"),
        F.concat(F.lit("  Conversation "), "conv_id", F.lit("   TURN "), "turn", F.lit(" ")).alias(
            "title"
        ),
        F.concat(F.lit("<div><p>"), "asked", F.lit("</p> <i>Asked</i></div>")).alias(
            "question_body"
        ),
        F.concat(F.lit("<p>"), "replied", F.lit(" &copy;</p>")).alias("answer_body"),
        F.length("asked").alias("question_score"),
        F.length("replied").alias("answer_score"),
        F.when(F.col("turn") > 0, F.concat(F.lit("turn"), "turn")).alias("tags"),
    )


SQL_QA = """
qa AS (
  SELECT u.conv_id AS question_id, u.turn + 1 AS answer_id,
         '  Conversation ' || u.conv_id || '   TURN ' || u.turn || ' ' AS title,
         '<div><p>' || u.text || '</p> <i>Asked</i></div>' AS question_body,
         '<p>' || a.text || ' &copy;</p>' AS answer_body,
         length(u.text) AS question_score, length(a.text) AS answer_score,
         CASE WHEN u.turn > 0 THEN 'turn' || u.turn END AS tags
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return (
        rf"list_filter(string_split_regex({x}, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"
    )


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def sql_clean(x: str) -> str:
    markup = (
        r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
        r"|<[!?][^>]*>|</?[a-z][^>]*>"
    )
    text = f"regexp_replace(coalesce({x}, ''), '{markup}', chr(1), 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    nodes = (
        f"list_transform(string_split({text}, chr(1)), "
        r"lambda n: regexp_replace(n, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
    )
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ')"


SQL_PREPARED = f"""
prepared AS (
  SELECT question_id, answer_id, lower({sql_squeeze('title')}) AS title,
         coalesce(tags, '') AS tags,
         lower({sql_clean('question_body')}) AS question,
         lower({sql_clean('answer_body')}) AS answer
  FROM qa)"""


# --------------------------------------------------------------------------
# chunks and queries for search


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunk_overlap(
        texts(spark, sf, "documents", "doc_id", "text"), "text", CHUNK_SIZE, CHUNK_OVERLAP
    )
    return cut.select(
        F.concat(F.lit("d"), "doc_id", F.lit("_c"), "chunk_index").alias("chunk_id"),
        "doc_id",
        "chunk_index",
        "chunk_text",
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


SQL_CHUNKS = f"""
doc_words AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
chunks AS (
  SELECT 'd' || doc_id || '_c' || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_index,
         array_to_string(w[i * {CHUNK_STEP} + 1 : i * {CHUNK_STEP} + {CHUNK_SIZE}], ' ')
           AS chunk_text
  FROM (SELECT doc_id, w,
               unnest(range(0, CAST(ceil(len(w) / {CHUNK_STEP}.0) AS BIGINT))) AS i
        FROM doc_words))"""
SQL_QUERIES = """
queries AS (SELECT item_id AS query_id, text FROM benchmark)"""


def sql_vectors(source: str, key: str, text: str, out: str) -> str:
    """Hashed unit vectors in long form, ``{out}(key, bucket, w)``, and their
    norms, ``{out}_norm(key, norm)``."""
    return f"""
{out}_tokens AS (SELECT {key}, unnest({sql_tokens(text)}) AS t FROM {source}),
{out}_counts AS (
  SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIM} AS bucket,
         CAST(count(*) AS DOUBLE) AS c
  FROM {out}_tokens GROUP BY ALL),
{out} AS (
  SELECT {key}, bucket,
         CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w
  FROM {out}_counts),
{out}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {out} GROUP BY ALL)"""
