"""Second-stage scoring of (query, chunk) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions.text import simple_tokens

#: Scores a pair: (query text, pair text) -> double. A model comes as a pandas UDF.
PairScorer = Callable[[Column, Column], Column]


def pair_text(chunk_index: Column, chunk_text: Column) -> Column:
    """The text a pair scorer sees: chunk number, blank, chunk text."""
    return F.concat_ws(" ", chunk_index.cast("string"), chunk_text)


def term_coverage(query: Column, text: Column) -> Column:
    """Default scorer: share of the query's distinct terms that the text holds."""
    asked = F.array_distinct(simple_tokens(query))
    found = F.array_intersect(asked, simple_tokens(text))
    return F.coalesce(F.try_divide(F.size(found).cast("double"), F.size(asked)), F.lit(0.0))


def rerank_topk(scored: DataFrame, k: int) -> DataFrame:
    """k best per query by ``rerank_score``; equal scores keep the fused order
    (``rrf_rank``). Adds ``rerank_rank``."""
    best = Window.partitionBy("query_id").orderBy(
        F.col("rerank_score").desc(), F.col("rrf_rank")
    )
    return scored.withColumn("rerank_rank", F.row_number().over(best)).where(
        F.col("rerank_rank") <= k
    )


def rerank(
    pairs: DataFrame, k: int, *, scorer: PairScorer = term_coverage, query: str = "text"
) -> DataFrame:
    """Score the fused chunks of every query and keep the k best.

    ``pairs`` holds ``query_id``, the query text, ``chunk_index``,
    ``chunk_text`` and ``rrf_rank``.
    """
    text = pair_text(F.col("chunk_index"), F.col("chunk_text"))
    return rerank_topk(pairs.withColumn("rerank_score", scorer(F.col(query), text)), k)


def search_tool(reranked: DataFrame, fused: DataFrame) -> DataFrame:
    """Reranked chunks of every query, or its fused chunks when it has none.
    Both inputs share their columns apart from the rerank ones."""
    answered = reranked.select("query_id").distinct()
    rest = fused.join(answered, "query_id", "left_anti")
    return reranked.unionByName(rest, allowMissingColumns=True)
