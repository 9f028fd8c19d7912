"""Retrieval quality over the embeddings table: vectors whose id is divisible by 50
are queries against all, and
vectors of the same label are relevant to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import tables
from askloom.catalog.registry import query
from askloom.catalog.search import SQL_NEIGHBOURS, _neighbours
from askloom.operators import evaluate
from askloom.operators.fusion import list_rank
from askloom.operators.vectors import vector_topk
from askloom.session import broadcast_if_small

K = 10


def _judged(spark, sf):
    """The K nearest other vectors of every vector with label gains, and how
    many relevant vectors there are: one less than the label holds."""
    rows = tables.table(spark, sf, "embeddings").select("vec_id", "label")
    found = vector_topk(*_neighbours(spark, sf), K + 1)
    others = list_rank(
        found.where(F.col("query_id") != F.col("chunk_id")).drop("rank"),
        F.col("distance").asc_nulls_last(),
    ).where(F.col("rank") <= K)
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    held = rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("c_label"))
    judged = others.join(asked, "query_id").join(held, "chunk_id").withColumn(
        "gain", (F.col("q_label") == F.col("c_label")).cast("double")
    )
    sizes = rows.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    counts = rows.where(F.col("vec_id") % 50 == 0).join(broadcast_if_small(sizes), "label").select(
        F.col("vec_id").alias("query_id"), F.lit(1.0).alias("gain"), "n"
    )
    return judged.select("query_id", "chunk_id", "rank", "gain"), counts


_SQL_JUDGED = f"""{SQL_NEIGHBOURS},
judged AS (
  SELECT * FROM (
    SELECT query_id, CASE WHEN q_label = c_label THEN 1.0 ELSE 0.0 END AS gain,
           row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, chunk_id) AS rank
    FROM cosines WHERE query_id <> chunk_id)
  WHERE rank <= {K}),
counts AS (
  SELECT query_id, n FROM (
    SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings)
  WHERE query_id % 50 = 0)"""


@query(
    "recall_at_k",
    f"""WITH {_SQL_JUDGED}
    SELECT j.query_id, round(CAST(sum(gain) AS DOUBLE) / nullif(min(n), 0), 6) AS recall
    FROM judged j JOIN counts c ON c.query_id = j.query_id GROUP BY j.query_id""",
)
def recall_at_k(spark, sf):
    return evaluate.recall_at_k(*_judged(spark, sf), K).withColumn("recall", F.round("recall", 6))


@query(
    "mrr",
    f"""WITH {_SQL_JUDGED}
    SELECT query_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN gain > 0 THEN rank END), 0), 6)
      AS reciprocal_rank
    FROM judged GROUP BY query_id""",
)
def mrr(spark, sf):
    return evaluate.mrr(_judged(spark, sf)[0]).withColumn(
        "reciprocal_rank", F.round("reciprocal_rank", 6)
    )


@query(
    "ndcg_at_k",
    f"""WITH {_SQL_JUDGED},
    places AS (SELECT unnest(range(1, {K + 1})) AS place_no),
    ideal AS (
      SELECT query_id, sum(1.0::DOUBLE / log2(place_no + 1)) AS best FROM counts JOIN places ON place_no <= n
      GROUP BY query_id),
    gained AS (
      SELECT query_id, sum(gain / log2(rank + 1)) AS dcg FROM judged GROUP BY query_id)
    SELECT c.query_id, round(coalesce(coalesce(dcg, 0) / nullif(best, 0), 0), 6) AS ndcg
    FROM counts c LEFT JOIN ideal i ON i.query_id = c.query_id
    LEFT JOIN gained g ON g.query_id = c.query_id""",
)
def ndcg_at_k(spark, sf):
    return evaluate.ndcg_at_k(*_judged(spark, sf), K).withColumn("ndcg", F.round("ndcg", 6))
