"""Guard rails and quality gates: each adds a decision to a table of queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.operators.fusion import hybrid_hits

#: Phrases that make a query unsafe (fixed values).
BANNED_PHRASES = (
    "ignore previous instructions",
    "system prompt",
    "delete database",
    "drop table",
)
#: Shortest query that is let through, in characters.
MIN_QUERY_LENGTH = 3
#: Best fused score below which a result counts as weak.
MIN_RRF = 0.02


def moderation_gate(
    queries: DataFrame, text: str = "text", banned: Iterable[str] = BANNED_PHRASES
) -> DataFrame:
    """Add ``is_allowed`` and ``reject_reason``. Length is tested first and on
    the untrimmed text."""
    lowered = F.lower(F.col(text))
    unsafe = F.lit(False)
    for phrase in banned:
        unsafe = unsafe | F.contains(lowered, F.lit(phrase))
    reason = (
        F.when(F.length(lowered) < MIN_QUERY_LENGTH, F.lit("too short"))
        .when(unsafe, F.lit("unsafe"))
    )
    return queries.withColumn("reject_reason", reason).withColumn(
        "is_allowed", F.col("reject_reason").isNull()
    )


def retrieval_gate(queries: DataFrame, fused: DataFrame, min_rrf: float = MIN_RRF) -> DataFrame:
    """Add ``retrieval_ok`` and ``fallback_reason`` (null when passed): no
    chunks at all, or a weak best score with no chunk found by both searches."""
    judged = queries.join(hybrid_hits(fused), "query_id", "left")
    weak = (F.col("best_rrf") < min_rrf) & (F.col("hybrid_hits") == 0)
    reason = F.when(F.col("n_chunks").isNull(), F.lit("no_chunks")).when(
        weak, F.lit("low_retrieval_confidence")
    )
    return (
        judged.withColumn("fallback_reason", reason)
        .withColumn("retrieval_ok", F.col("fallback_reason").isNull())
        .drop("n_chunks", "best_rrf", "hybrid_hits")
    )


def top1_gate(
    queries: DataFrame, ranked: DataFrame, score: str = "rrf_score", min_score: float = MIN_RRF
) -> DataFrame:
    """The simpler gate: only the first chunk's score counts. A first chunk
    without a score counts as 0."""
    top = ranked.groupBy("query_id").agg(
        F.min_by(F.coalesce(F.col(score), F.lit(0.0)), "rank").alias("_top")
    )
    reason = F.when(F.col("_top").isNull(), F.lit("no relevant documents")).when(
        F.col("_top") < min_score, F.lit("weakly related documents")
    )
    return (
        queries.join(top, "query_id", "left")
        .withColumn("reject_reason", reason)
        .withColumn("retrieval_passed", F.col("reject_reason").isNull())
        .drop("_top")
    )


def route_outcome(gated: DataFrame, *, rejection: str, fallback: str) -> DataFrame:
    """Add ``route`` (``reject``, ``fallback``, ``answer``) and, for the first
    two, the ``canned_answer``: the reason of a rejection, or ``rejection`` where
    there is none, and ``fallback``.

    Expects ``is_allowed`` and ``reject_reason`` from the moderation gate and
    ``retrieval_ok`` from the retrieval gate.
    """
    route = (
        F.when(~F.col("is_allowed"), F.lit("reject"))
        .when(~F.col("retrieval_ok"), F.lit("fallback"))
        .otherwise(F.lit("answer"))
    )
    canned = F.when(
        F.col("route") == "reject", F.coalesce(F.col("reject_reason"), F.lit(rejection))
    ).when(F.col("route") == "fallback", F.lit(fallback))
    return gated.withColumn("route", route).withColumn("canned_answer", canned)


def min_chars_filter(chunks: DataFrame, minimum: int, text: str = "chunk_text") -> DataFrame:
    """Drop chunks whose trimmed text is shorter than the minimum."""
    return chunks.where(F.length(F.trim(F.col(text))) >= minimum)
