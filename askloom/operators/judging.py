"""Model scores and verdicts as table columns. The model call is a plug-in:
either a pandas UDF or a column that already holds the model's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.verdicts import judge_json, judge_score, listed_indexes

#: (query text, chunk text) -> model output text
TextModel = Callable[[Column, Column], Column]


def score_chunks(
    df: DataFrame, model: TextModel, *, query: str = "text", chunk: str = "chunk_text"
) -> DataFrame:
    """Add ``llm_score``: the model's relevance number for every pair."""
    return df.withColumn("llm_score", judge_score(model(F.col(query), F.col(chunk))))


def judge_answers(df: DataFrame, output: str = "model_output") -> DataFrame:
    """Unpack a verdict column into one column per verdict field."""
    return df.withColumn("_verdict", judge_json(F.col(output))).select(
        *[name for name in df.columns if name != output], "_verdict.*"
    )


def pseudo_labels(ranked: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, relevant)``: ranked chunks whose ``chunk_index``
    the model listed in ``outputs(query_id, model_output)``."""
    listed = outputs.select(
        "query_id", F.explode(listed_indexes(F.col("model_output"))).alias("chunk_index")
    ).distinct()
    marked = ranked.join(
        listed.withColumn("_listed", F.lit(True)), ["query_id", "chunk_index"], "left"
    )
    return marked.select(
        "query_id", "chunk_id", F.coalesce("_listed", F.lit(False)).alias("relevant")
    )
