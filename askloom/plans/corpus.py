"""From CSV dumps to a searchable chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.chunking import chunk_id, chunk_overlap
from askloom.functions.text import chunk_source_text, document_text, prepare_document, words
from askloom.operators.assemble import best_answer_ties, qa_assemble
from askloom.operators.vectors import Encoder, embed_text
from askloom.sources import dumps
from askloom.sources.sinks import embedding_sink, write_if_absent

#: Name stored with vectors of the built-in encoder.
HASHED_MODEL = "hashed-terms"


def load_corpus(spark: SparkSession, paths: dict[str, str], root: str) -> DataFrame:
    """Dumps to staging tables to ``qa_documents``, all stored under ``root``.

    Staging keeps the first row per id (tags: per id and tag), so loading twice
    adds nothing; ``qa_documents`` is replaced.
    """
    dumps.required_inputs(spark, paths)
    questions = write_if_absent(
        dumps.stage_questions(dumps.read_questions(spark, paths["questions"])),
        f"{root}/stg_questions", ["Id"], ["CreationDate", "Title", "Body"],
    )
    answers = write_if_absent(
        dumps.stage_answers(dumps.read_answers(spark, paths["answers"])),
        f"{root}/stg_answers", ["Id"], ["CreationDate", "ParentId", "Body"],
    )
    tags = write_if_absent(
        dumps.stage_tags(dumps.read_tags(spark, paths["tags"])),
        f"{root}/stg_tags", ["Id", "Tag"], ["Tag"],
    )
    qa_assemble(questions, answers, tags).write.mode("overwrite").parquet(f"{root}/qa_documents")
    return spark.read.parquet(f"{root}/qa_documents")


def prepare_chunk_rows(
    qa: DataFrame,
    *,
    size: int = 384,
    overlap_share: float = 0.2,
    encoder: Encoder | None = None,
    model_name: str = HASHED_MODEL,
    dim: int = 384,
    tokens: Callable[[Column], Column] = words,
) -> DataFrame:
    """Documents to ``(chunk_id, chunk_index, chunk_text, model_name,
    embedding)``. Everything happens inside the row: there is no shuffle."""
    doc = prepare_document(
        F.col("title"), F.col("tags"), F.col("question_body"), F.col("answer_body")
    )
    source = qa.select("question_id", "answer_id", doc.alias("doc")).select(
        "question_id",
        "answer_id",
        chunk_source_text(
            F.col("doc.title"), F.col("doc.tags"), F.col("doc.question"), F.col("doc.answer")
        ).alias("source_text"),
    )
    cut = chunk_overlap(source, "source_text", size, overlap_share, tokens=tokens)
    rows = cut.select(
        chunk_id(F.col("question_id"), F.col("answer_id"), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        "chunk_text",
        F.lit(model_name).alias("model_name"),
    )
    return embed_text(rows, "chunk_text", encoder=encoder, dim=dim)


def document_texts(qa: DataFrame) -> DataFrame:
    """``(question_id, answer_id, document_text)``: best answers, cleaned, as the
    labelled text of each document."""
    doc = prepare_document(
        F.col("title"), F.col("tags"), F.col("question_body"), F.col("answer_body")
    )
    cleaned = best_answer_ties(qa).select("question_id", "answer_id", doc.alias("doc"))
    return cleaned.select(
        "question_id",
        "answer_id",
        document_text(
            F.col("doc.title"), F.col("doc.tags"), F.col("doc.question"), F.col("doc.answer")
        ).alias("document_text"),
    )


def prepare_corpus(qa: DataFrame, root: str, **options: object) -> DataFrame:
    """Best answers of all questions, chunked, embedded and stored."""
    return embedding_sink(prepare_chunk_rows(best_answer_ties(qa), **options), root)
