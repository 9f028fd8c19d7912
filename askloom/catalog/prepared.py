"""Search tables that several catalog queries share.

Indexes are written once per session and input folder under the scratch folder, and
every query reads the files; what is searched with them is searched each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.catalog import tables
from askloom.operators.blockmax import BlockIndex, write_blocks
from askloom.operators.fusion import fuse_lists
from askloom.operators.lexical import LexicalIndex, lexical_topk, write_index
from askloom.operators.quantized import CodeBooks, encode_vectors, fit_code_books
from askloom.operators.vectors import (
    CellIndex,
    assign_cells,
    embed_text,
    mean_cells,
    vector_topk,
)
from askloom.session import land, scratch_folder

TOP = 10
ANY_SHARE = 0.6


_built: dict[tuple[str, ...], object] = {}


def _once(spark: SparkSession, sf: str, label: str, build):
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def _has(spark: SparkSession, sf: str, label: str) -> bool:
    return (spark.sparkContext.applicationId, sf, label) in _built


@dataclass(frozen=True)
class SearchTables:
    """Each table is written when it is first asked for."""

    spark: SparkSession
    sf: str

    @property
    def chunks(self) -> DataFrame:
        """Chunks with their vectors."""
        return _once(self.spark, self.sf, "chunks", lambda: land(
            embed_text(tables.document_chunks(self.spark, self.sf), "chunk_text", dim=tables.DIM), "chunks"
        ))

    @property
    def texts(self) -> DataFrame:
        """Chunks without vectors; those with vectors, if they are written already."""
        if _has(self.spark, self.sf, "chunks"):
            return self.chunks.drop("embedding")
        return _once(self.spark, self.sf, "texts", lambda: land(tables.document_chunks(self.spark, self.sf), "texts"))

    @property
    def queries(self) -> DataFrame:
        return _once(self.spark, self.sf, "queries", lambda: land(
            embed_text(tables.benchmark_queries(self.spark, self.sf), "text", dim=tables.DIM), "queries"
        ))

    @property
    def index(self) -> LexicalIndex:
        return _once(self.spark, self.sf, "lexical", lambda: write_index(
            self.texts, scratch_folder(self.spark, "lexical"), buckets=8
        ))


def search_tables(spark: SparkSession, sf: str) -> SearchTables:
    return SearchTables(spark, sf)


def positional_index(spark: SparkSession, sf: str) -> LexicalIndex:
    """Term index of the chunks with the places of the terms."""

    def build() -> LexicalIndex:
        chunks = search_tables(spark, sf).texts
        return write_index(chunks, scratch_folder(spark, "positions"), buckets=8, positions=True)

    return _once(spark, sf, "positions", build)


def block_index(spark: SparkSession, sf: str) -> BlockIndex:
    """Term index of the chunks in blocks."""

    def build() -> BlockIndex:
        return write_blocks(search_tables(spark, sf).texts, scratch_folder(spark, "blocks"), buckets=8)

    return _once(spark, sf, "blocks", build)


def cell_index(spark: SparkSession, sf: str) -> tuple[DataFrame, CellIndex]:
    """The embeddings table stored by cell, and its centroids."""

    def build() -> tuple[DataFrame, CellIndex]:
        rows = tables.table(spark, sf, "embeddings")
        chunks = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
        index = mean_cells(rows, "label")
        # Files hold ranges of cells, so the filter on the probed ones skips files.
        celled = assign_cells(chunks, index).repartitionByRange("cell", "chunk_id")
        return land(celled.sortWithinPartitions("cell"), "cells"), index

    return _once(spark, sf, "cells", build)


def code_index(spark: SparkSession, sf: str) -> tuple[DataFrame, CodeBooks]:
    """The embeddings table as codes, and the code books."""

    def build() -> tuple[DataFrame, CodeBooks]:
        rows = tables.table(spark, sf, "embeddings")
        chunks = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
        books = fit_code_books(chunks)
        return land(encode_vectors(chunks, books), "codes"), books

    return _once(spark, sf, "codes", build)


def ranked_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The vector list and the lexical list of every benchmark query."""
    t = search_tables(spark, sf)
    return (
        land(vector_topk(t.chunks, t.queries, TOP), "nearest"),
        land(lexical_topk(t.index, t.queries, TOP), "lexical-best"),
    )


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return land(fuse_lists(*ranked_lists(spark, sf)), "fused")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Fused chunks with their text and the text of the query."""
    t = search_tables(spark, sf)
    return (
        fused(spark, sf)
        .join(t.texts.select("chunk_id", "chunk_index", "chunk_text"), "chunk_id")
        .join(t.queries.select("query_id", F.col("text")), "query_id")
    )
