"""Merging and fusing ranked lists.

A ranked list is ``(query_id, chunk_id, rank, ...)`` with ranks from 1. Lists
hold k rows per query, so a window over one query is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions.text import strip

#: Added to ranks before they are inverted.
RRF_K = 10


def list_rank(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """Number the rows of every query from 1 in the given order; the chunk id
    settles ties."""
    place = Window.partitionBy("query_id").orderBy(*order, F.col("chunk_id"))
    return df.withColumn(rank, F.row_number().over(place))


def topk_per_query(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows of every query. Spark limits groups before the shuffle, so
    each task ships k rows per query at most."""
    place = Window.partitionBy("query_id").orderBy(*order, F.col("chunk_id"))
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop(
        "_place"
    )


def union_lists(**lists: DataFrame) -> DataFrame:
    """All lists under each other with their name as ``source`` and their
    position as ``list_no``."""
    parts = [
        df.select(
            "query_id",
            "chunk_id",
            F.col("rank").cast("int").alias("rank"),
            F.lit(name).alias("source"),
            F.lit(number).alias("list_no"),
        )
        for number, (name, df) in enumerate(lists.items(), start=1)
    ]
    return reduce(DataFrame.unionByName, parts)


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the rows of ``union_lists``:
    ``(query_id, chunk_id, rrf_score, rank)``.

    Parts are added in list order and equal scores keep the order in which
    chunks are first met: first list first, then by rank.
    """
    return _fuse(lists, k)


def _fuse(lists: DataFrame, k: int, *others: Column, rank: str = "rank") -> DataFrame:
    """The fused rows of a union of lists, with further aggregates."""
    places = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    met = lists.groupBy("query_id", "chunk_id").agg(places.alias("_places"), *others)
    score = F.aggregate(
        "_places", F.lit(0.0), lambda total, place: total + 1.0 / (k + place.getField("rank"))
    )
    scored = met.withColumn("rrf_score", score)
    return list_rank(scored, F.col("rrf_score").desc(), F.col("_places")[0], rank=rank).drop(
        "_places"
    )


def fuse_lists(vector: DataFrame, lexical: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Merge, fuse and score a vector list (``distance``) and a lexical list
    (``score``) in one grouping: ``(query_id, chunk_id, distance, bm25_score,
    in_vector, in_bm25, rrf_score, rrf_rank)``.

    The same rows as ``attach_scores(merge_ranked(...), rrf(...))`` without the
    two joins.
    """
    none = F.lit(None).cast("double")
    both = vector.select(
        "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.lit(1).alias("list_no"),
        "distance", none.alias("score"),
    ).unionByName(
        lexical.select(
            "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"),
            F.lit(2).alias("list_no"), none.alias("distance"), "score",
        )
    )
    return _fuse(
        both,
        rrf_k,
        F.max("distance").alias("distance"),
        F.max("score").alias("bm25_score"),
        F.bool_or(F.col("list_no") == 1).alias("in_vector"),
        F.bool_or(F.col("list_no") == 2).alias("in_bm25"),
        rank="rrf_rank",
    )


def merge_ranked(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Union by chunk with membership flags. Where both lists hold a chunk the
    vector row's fields win and only ``bm25_score`` comes from the other.

    Shared columns other than the two keys are taken from the vector row if the
    chunk is in the vector list, and from the lexical row otherwise.
    """
    keys = ["query_id", "chunk_id"]
    v = vector.withColumn("_v", F.lit(True)).alias("v")
    l = lexical.withColumn("_l", F.lit(True)).alias("l")
    joined = v.join(l, keys, "full_outer")
    in_vector = F.coalesce(F.col("_v"), F.lit(False))
    in_bm25 = F.coalesce(F.col("_l"), F.lit(False))
    fields = []
    for name in dict.fromkeys([*vector.columns, *lexical.columns]):
        if name in keys:
            continue
        if name in vector.columns and name in lexical.columns and name != "bm25_score":
            value = F.when(in_vector, F.col(f"v.{name}")).otherwise(F.col(f"l.{name}"))
        elif name in lexical.columns:
            value = F.col(f"l.{name}")
        else:
            value = F.col(f"v.{name}")
        fields.append(value.alias(name))
    return joined.select(
        *keys, *fields, in_vector.alias("in_vector"), in_bm25.alias("in_bm25")
    )


def attach_scores(chunks: DataFrame, fused: DataFrame) -> DataFrame:
    """Fused score and rank put onto the merged chunk rows."""
    scores = fused.select("query_id", "chunk_id", "rrf_score", F.col("rank").alias("rrf_rank"))
    return chunks.join(scores, ["query_id", "chunk_id"])


def dedupe_chunks(df: DataFrame, *order: Column) -> DataFrame:
    """First row per query and trimmed chunk id; the kept row is unchanged."""
    first = Window.partitionBy("query_id", strip(F.col("chunk_id"))).orderBy(*order, F.col("chunk_id"))
    return df.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1).drop(
        "_first"
    )


def hybrid_hits(fused: DataFrame) -> DataFrame:
    """Per query: number of chunks, best fused score, chunks in both lists."""
    return fused.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("rrf_score").alias("best_rrf"),
        F.count_if(F.col("in_vector") & F.col("in_bm25")).alias("hybrid_hits"),
    )
