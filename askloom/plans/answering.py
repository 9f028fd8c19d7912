"""Whole tables of queries through search, gates, reranking and prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.operators import context, fusion, gates
from askloom.operators.lexical import LexicalIndex, lexical_topk
from askloom.operators.rerank import PairScorer, rerank, term_coverage
from askloom.operators.vectors import CellIndex, Encoder, ann_topk, embed_text, vector_topk
from askloom.session import broadcast_if_small, land


@dataclass(frozen=True)
class Prompt:
    """The wording of a service: instruction, the parts around query and context,
    and what is answered without a search result."""

    system: str
    human: tuple[str, str, str]
    rejection: str
    fallback: str


def hybrid_search(
    chunks: DataFrame,
    index: LexicalIndex,
    queries: DataFrame,
    k: int,
    *,
    rrf_k: int = fusion.RRF_K,
    min_share: float = 1.0,
    cells: CellIndex | None = None,
    nprobe: int = 0,
) -> DataFrame:
    """k nearest chunks and k best term matches of every query, fused.

    ``chunks(chunk_id, embedding, ...)``, ``queries(query_id, text, embedding)``. With
    ``cells``, chunks also have ``cell``, and the ``nprobe`` nearest are searched.
    """
    if cells is None:
        nearest = vector_topk(chunks, queries, k)
    else:
        nearest = ann_topk(chunks, queries, k, cells, nprobe)
    return fusion.fuse_lists(
        nearest,
        lexical_topk(index, queries, k, min_share=min_share),
        rrf_k,
    )


def attach_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk number and text of the found chunks. The found side, a few rows per
    query, is shipped to the chunk scan if it is measured to be small, so that
    the texts of the whole corpus need not move."""
    texts = chunks.select("chunk_id", "chunk_index", "chunk_text")
    return texts.join(broadcast_if_small(found), "chunk_id")


def rag_context(
    fused: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    *,
    top: int,
    prompt: Prompt,
    min_rrf: float = gates.MIN_RRF,
    scorer: PairScorer = term_coverage,
) -> DataFrame:
    """``(query_id, route, context, prompt, canned_answer)`` for every query.

    Queries that fail a gate keep their row, with a route and a canned answer
    in place of a prompt. The fused lists feed the gate and the reranking, so
    they are written to the scratch folder once.
    """
    fused = land(fused, "fused")
    gated = gates.route_outcome(
        gates.retrieval_gate(gates.moderation_gate(queries), fused, min_rrf),
        rejection=prompt.rejection, fallback=prompt.fallback,
    )
    open_queries = gated.where(F.col("route") == "answer").select("query_id", "text")
    pairs = attach_chunks(fused, chunks).join(open_queries, "query_id")
    best = rerank(pairs, top, scorer=scorer)
    contexts = context.build_context(best, rank="rerank_rank")
    answered = gated.join(contexts, "query_id", "left")
    finished = context.build_prompt(
        F.col("text"), F.col("context"), system=prompt.system, human=prompt.human
    )
    return answered.select(
        "query_id",
        "route",
        "context",
        F.when(F.col("route") == "answer", finished).alias("prompt"),
        "canned_answer",
    )


def answer_queries(
    queries: DataFrame,
    chunks: DataFrame,
    index: LexicalIndex,
    k: int,
    *,
    top: int,
    prompt: Prompt,
    dim: int,
    encoder: Encoder | None = None,
    min_rrf: float = gates.MIN_RRF,
    scorer: PairScorer = term_coverage,
    **search: object,
) -> DataFrame:
    """From query texts (``query_id, text``) to prompts, as ``rag_context`` returns
    them. Moderation comes first: only queries that it lets through are embedded,
    once, and searched. ``search`` goes to ``hybrid_search``.
    """
    allowed = gates.moderation_gate(queries.select("query_id", "text")).where("is_allowed")
    asked = land(
        embed_text(allowed.select("query_id", "text"), "text", encoder=encoder, dim=dim), "asked"
    )
    fused = hybrid_search(chunks, index, asked, k, **search)
    return rag_context(
        fused, chunks, queries, top=top, prompt=prompt, min_rrf=min_rrf, scorer=scorer
    )
