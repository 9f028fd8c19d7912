"""From staging tables to question-answer documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.operators.skew import ROWS_PER_TASK, deal_by_rows, spread_join


def tags_string_agg(
    tags: DataFrame, *, rows_per_task: int = ROWS_PER_TASK, rows: int | None = None
) -> DataFrame:
    """``(question_id, tags)``: the tags of a question, sorted and joined by
    ``", "``. Null tags are skipped; a question with null tags only has null.

    Repeats are counted before they are grouped, so what one task gathers for a
    question is its distinct tags. The number of tasks follows ``rows``, at most
    how many ``tags`` has; without it they are counted.
    """
    rows = tags.count() if rows is None else rows
    counted = tags.groupBy(F.col("Id").alias("question_id"), F.col("Tag").alias("tag")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    listed = F.array_sort(
        F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", "n")))
    )
    repeated = F.flatten(
        F.transform(listed, lambda t: F.array_repeat(t.getField("tag"), t.getField("n")))
    )
    dealt = deal_by_rows(counted, rows, "question_id", rows_per_task=rows_per_task)
    return dealt.groupBy("question_id").agg(
        F.when(F.count("tag") > 0, F.array_join(repeated, ", ")).alias("tags")
    )


def qa_assemble(
    questions: DataFrame,
    answers: DataFrame,
    tags: DataFrame,
    *,
    rows_per_task: int = ROWS_PER_TASK,
    tag_rows: int | None = None,
) -> DataFrame:
    """``qa_documents``: one row per answer of a known question, with the
    question's tags. Unanswered questions and orphan answers are absent.

    Tags are put onto questions, where both sides are unique per question, so
    that only one join meets a question with very many answers. ``tag_rows`` is
    at most how many rows ``tags`` has; without it they are counted.
    """
    listed = tags_string_agg(tags, rows_per_task=rows_per_task, rows=tag_rows)
    asked = questions.select(
        F.col("Id").alias("question_id"),
        F.col("Title").alias("title"),
        F.col("Body").alias("question_body"),
        F.col("Score").alias("question_score"),
    ).join(listed, "question_id", "left")
    given = answers.select(
        F.col("ParentId").alias("question_id"),
        F.col("Id").alias("answer_id"),
        F.col("Body").alias("answer_body"),
        F.col("Score").alias("answer_score"),
    )
    return spread_join(
        given, asked, "question_id", rows_per_task=rows_per_task, rows=answers.count()
    ).select(
        "question_id",
        "answer_id",
        "title",
        "question_body",
        "answer_body",
        "question_score",
        "answer_score",
        "tags",
    )


def best_answer_ties(qa: DataFrame, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows whose score is the best of their question. Ties give several rows;
    a question without any score gives none."""
    best = (
        qa.where(F.col("answer_score").isNotNull())
        .groupBy("question_id")
        .agg(F.max("answer_score").alias("_best"))
    )
    return (
        spread_join(qa, best, "question_id", rows_per_task=rows_per_task)
        .where(F.col("answer_score") == F.col("_best"))
        .drop("_best")
    )


def best_answer_one(qa: DataFrame, *order: str) -> DataFrame:
    """Exactly one row per question: best score, missing scores last, ties by
    the ``order`` columns (default: answer id). Tasks keep one row per question
    before the shuffle."""
    ties = order or ("answer_id",)
    best = Window.partitionBy("question_id").orderBy(
        F.col("answer_score").desc_nulls_last(), *ties
    )
    return qa.withColumn("_place", F.row_number().over(best)).where(F.col("_place") == 1).drop(
        "_place"
    )
