"""Prompt contexts: the top chunks of a query as one text.

Inputs hold a fixed number of ranked chunks per query, so the per-query lists
stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import or_empty, strip


def _in_rank_order(part: Column, rank: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("at"), part.alias("part"))))
    return F.array_join(F.transform(parts, lambda p: p.getField("part")), "\n\n")


def build_context(ranked: DataFrame, rank: str = "rank", text: str = "chunk_text") -> DataFrame:
    """``(query_id, context)``: numbered sources in rank order. A blank chunk is
    left out but keeps its number; a query with blank chunks only has an empty
    context."""
    body = strip(or_empty(F.col(text)))
    part = F.when(
        body != "",
        F.concat(F.lit("[Source "), F.col(rank).cast("string"), F.lit("]\nText: "), body),
    )
    filled = ranked.select("query_id", rank, part.alias("_part"))
    parts = F.array_sort(
        F.collect_list(F.when(F.col("_part").isNotNull(), F.struct(rank, "_part")))
    )
    joined = F.array_join(F.transform(parts, lambda p: p.getField("_part")), "\n\n")
    return filled.groupBy("query_id").agg(joined.alias("context"))


def agent_context(
    ranked: DataFrame, rank: str = "rank", score: str = "rerank_score"
) -> DataFrame:
    """``(query_id, context)`` with chunk id and score in every block; nothing
    is left out and a missing value prints as ``None``."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    part = F.concat(
        F.lit("[Document "), F.col(rank).cast("string"), F.lit("]\nchunk_id: "), shown("chunk_id"),
        F.lit("\nrerank_score: "), shown(score),
        F.lit("\ntext: "), shown("chunk_text"),
    )
    return ranked.groupBy("query_id").agg(_in_rank_order(part, rank).alias("context"))


def build_prompt(
    query: Column,
    context: Column,
    *,
    system: str,
    human: tuple[str, str, str],
) -> Column:
    """The full prompt: the instruction, then query and context between the three
    parts of ``human``. Parts are concatenated, so braces in a query or a
    context have no meaning."""
    before, between, after = human
    return F.concat(
        F.lit(system + "\n" + before), or_empty(query), F.lit(between), or_empty(context),
        F.lit(after),
    )
