"""Retrieval quality per query and on average.

``ranked`` holds ``(query_id, chunk_id, rank, gain)``: the judged results.
``gain_counts`` holds ``(query_id, gain, n)``: how many chunks of each gain
exist for the query. Counts stand for the full list of relevant chunks, which
may be very long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judge_ranked(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Put the gains of ``relevant(query_id, chunk_id, gain)`` onto results;
    a chunk that is not listed has gain 0."""
    return ranked.join(
        relevant.select("query_id", "chunk_id", "gain"), ["query_id", "chunk_id"], "left"
    ).withColumn("gain", F.coalesce(F.col("gain").cast("double"), F.lit(0.0)))


def gain_counts(relevant: DataFrame) -> DataFrame:
    return relevant.groupBy("query_id", F.col("gain").cast("double").alias("gain")).agg(
        F.count(F.lit(1)).alias("n")
    )


def recall_at_k(ranked: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall)``: relevant chunks among the first k over all
    relevant ones. A query with nothing relevant has null, which a mean skips."""
    totals = counts.groupBy("query_id").agg(
        F.sum(F.when(F.col("gain") > 0, F.col("n")).otherwise(F.lit(0))).alias("_total")
    )
    hits = ranked.groupBy("query_id").agg(
        F.count_if((F.col("rank") <= k) & (F.col("gain") > 0)).alias("_hits")
    )
    recall = F.try_divide(F.coalesce(F.col("_hits"), F.lit(0)).cast("double"), F.col("_total"))
    return totals.join(hits, "query_id", "left").select("query_id", recall.alias("recall"))


def mrr(ranked: DataFrame) -> DataFrame:
    """``(query_id, reciprocal_rank)``: of the first relevant result, 0 without
    one."""
    first = F.min(F.when(F.col("gain") > 0, F.col("rank")))
    return ranked.groupBy("query_id").agg(
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank")
    )


def _discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + F.lit(1.0))


def ndcg_at_k(ranked: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``(query_id, ndcg)`` with linear gains and ``1/log2(rank+1)`` discounts
    (Järvelin and Kekäläinen 2002). An ideal of 0 gives 0."""
    gained = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum(F.col("gain") * _discount(F.col("rank"))).alias("_dcg")
    )
    # The ideal list by runs of equal gain; a run reaches rank k at the latest.
    better = (
        Window.partitionBy("query_id")
        .orderBy(F.col("gain").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = counts.where(F.col("gain") > 0).withColumn(
        "_before", F.coalesce(F.sum("n").over(better), F.lit(0))
    )
    places = F.sequence(
        F.col("_before") + 1, F.least(F.col("_before") + F.col("n"), F.lit(k).cast("bigint"))
    )
    ideal = (
        runs.where(F.col("_before") < k)
        .select("query_id", "gain", F.explode(places).alias("_at"))
        .groupBy("query_id")
        .agg(F.sum(F.col("gain") * _discount(F.col("_at"))).alias("_ideal"))
    )
    known = counts.select("query_id").distinct()
    score = F.coalesce(F.try_divide(F.coalesce("_dcg", F.lit(0.0)), F.col("_ideal")), F.lit(0.0))
    return (
        known.join(ideal, "query_id", "left")
        .join(gained, "query_id", "left")
        .select("query_id", score.alias("ndcg"))
    )


def mean_over_queries(scores: DataFrame, column: str) -> DataFrame:
    return scores.agg(F.avg(column).alias(f"mean_{column}"), F.count(column).alias("n_queries"))
