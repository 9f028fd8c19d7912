"""Fixed schemas of the staging and result tables."""

from __future__ import annotations

#: Column names of the dumps, in their order (fixed values). Dumps are read as text
#: and cast afterwards, so that a bad value is reported by the cast and not by the
#: parser.
QUESTION_COLUMNS = (
    "Id", "OwnerUserId", "CreationDate", "ClosedDate", "Score", "Title", "Body",
)
ANSWER_COLUMNS = ("Id", "OwnerUserId", "CreationDate", "ParentId", "Score", "Body")
TAG_COLUMNS = ("Id", "Tag")

#: Column names of the result tables (fixed values).
CHUNK_COLUMNS = (
    "chunk_id", "question_id", "answer_id", "chunk_index", "title", "tags",
    "question_score", "answer_score", "chunk_text", "embedding",
)
EMBEDDING_COLUMNS = ("chunk_id", "chunk_index", "chunk_text", "model_name", "embedding")


def text_schema(columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{name}` string" for name in columns)
