"""Approximate nearest neighbours by product quantisation with exact re-ranking.

A vector at length one is cut into parts, and each part is stored as the number of
its nearest code: one byte per part instead of eight or more. A search reads the
codes only: it looks the parts' products with the query up in a table and keeps a
short list per query. The full vectors of the short list alone are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators.vectors import (
    DISTANCE_DIGITS,
    MAX_SHIPPED_QUERIES,
    _Best,
    _answer,
    _arrow_types,
    _matrix,
    _out_schema,
    _rank_nearest,
    _unit,
    _unit_rows,
)
from askloom.session import broadcast_if_small, land

#: Rows and bytes of the sample that the codes are fitted on, at most. Every vector is
#: encoded; the sample only decides how well.
SAMPLE_ROWS = 65_536
SAMPLE_BYTES = 64 << 20
#: Products looked up at once.
_AT_ONCE = 1 << 22


@dataclass(frozen=True)
class CodeBooks:
    """``codes[p, c]``: the ``c``-th code of part ``p``; all parts have one width, the
    last one is filled up with zeros."""

    codes: np.ndarray
    dim: int

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Rows of vectors as (row, part, place)."""
        parts, _, width = self.codes.shape
        padded = np.zeros((len(units), parts * width))
        padded[:, : self.dim] = units
        return padded.reshape(len(units), parts, width)

    def encode(self, units: np.ndarray) -> np.ndarray:
        cut = self.cut(units)
        return np.stack([_nearest(cut[:, p], self.codes[p]) for p in range(len(self.codes))], 1).astype(np.uint8)

    def tables(self, units: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all codes: (query, part, code)."""
        return np.einsum("qpw,pcw->qpc", self.cut(units), self.codes)


def _nearest(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((codes * codes).sum(1) - 2.0 * (rows @ codes.T)).argmin(1)


def _fit_part(rows: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Codes by k-means; a code that no row is nearest to becomes the row that is
    farthest from its own."""
    codes = rows[rng.choice(len(rows), n, replace=len(rows) < n)].copy()
    for _ in range(rounds):
        own = _nearest(rows, codes)
        count = np.bincount(own, minlength=n)
        total = np.stack([np.bincount(own, w, n) for w in rows.T], 1)
        codes = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], codes)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = ((rows - codes[own]) ** 2).sum(1).argsort()[::-1][: len(empty)]
            codes[empty[: len(far)]] = rows[far]
    return codes


def fit_code_books(
    chunks: DataFrame, *, parts: int = 32, codes: int = 256, rounds: int = 12, seed: int = 7,
    sample_rows: int = SAMPLE_ROWS,
) -> CodeBooks:
    """Fit the codes on a sample of vectors, chosen by a hash of their ids. Runs two jobs."""
    if not 1 <= codes <= 256:
        raise ValueError("codes must lie in 1 to 256")
    known = chunks.select("chunk_id", _unit("embedding").alias("unit")).where("unit IS NOT NULL")
    one = known.select(F.size("unit").alias("n")).first()
    if one is None:
        raise ValueError("no vectors to fit codes on")
    dim = one["n"]
    if not 1 <= parts <= dim:
        raise ValueError(f"parts must lie in 1 to {dim}")
    most = max(codes, min(sample_rows, SAMPLE_BYTES // (8 * dim)))
    sample = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select("unit").toArrow()
    width = -(-dim // parts)
    books = CodeBooks(np.zeros((-(-dim // width), codes, width)), dim)
    cut, rng = books.cut(_matrix(sample.column("unit"), dim)), np.random.default_rng(seed)
    return CodeBooks(np.stack([_fit_part(cut[:, p], codes, rounds, rng) for p in range(cut.shape[1])]), dim)


def encode_vectors(chunks: DataFrame, books: CodeBooks) -> DataFrame:
    """``chunk_id, codes``: a byte per part; null for a vector without direction."""
    sent = chunks.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([chunks.schema["chunk_id"], T.StructField("codes", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit_rows(_matrix(batch.column("embedding"), sent.value.dim))
            known = ~np.isnan(units[:, 0]) if len(units) else np.empty(0, bool)
            made = sent.value.encode(np.nan_to_num(units))
            codes = [row.tobytes() if ok else None for row, ok in zip(made, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array(codes, pa.binary())], names=["chunk_id", "codes"]
            )

    return chunks.select("chunk_id", "embedding").mapInArrow(encode, schema)


def short_lists(
    coded: DataFrame, queries: DataFrame, books: CodeBooks, length: int, *, max_shipped: int = MAX_SHIPPED_QUERIES
) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: the ``length`` nearest by codes. Queries
    are shipped in rounds of ``max_shipped``, a scan of the codes each."""
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    rounds = max(1, -(-asked.count() // max_shipped))
    part = F.pmod(F.xxhash64("query_id"), F.lit(2 * rounds)) if rounds > 1 else F.lit(0)
    found = None
    for i in range(2 * rounds if rounds > 1 else 1):
        made = _one_round(coded, asked.where(part == i), books, length)
        found = made if found is None else found.unionByName(made)
    return _rank_nearest(found, length)


def _one_round(coded: DataFrame, asked: DataFrame, books: CodeBooks, length: int) -> DataFrame:
    schema = _out_schema(coded, asked)
    types = _arrow_types(schema)
    shipped = asked.toArrow()
    ids = np.array(shipped.column("query_id").to_pylist(), dtype=object)
    units = np.nan_to_num(_unit_rows(_matrix(shipped.column("embedding"), books.dim)))
    sent = coded.sparkSession.sparkContext.broadcast((ids, books.tables(units)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = sent.value
        best = _Best(len(ids), length)
        if not len(ids):
            return
        parts = tables.shape[1]
        step = max(1, _AT_ONCE // 8192)
        for whole in batches:
            whole = whole.filter(whole.column("codes").is_valid())
            for a in range(0, whole.num_rows, 8192):
                batch = whole.slice(a, 8192)
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
                chunk_ids = np.array(batch.column("chunk_id").to_pylist(), dtype=object)
                for q in range(0, len(ids), step):
                    product = np.zeros((len(tables[q : q + step]), len(codes)))
                    for p in range(parts):
                        product += tables[q : q + step, p][:, codes[:, p]]
                    near = np.round(1.0 - product, DISTANCE_DIGITS)
                    best.offer_block(near, np.arange(q, q + len(near)), chunk_ids)
        yield _answer(best, ids, types)

    return coded.select("chunk_id", "codes").mapInArrow(scan, schema)


def quantized_topk(
    chunks: DataFrame, coded: DataFrame, queries: DataFrame, k: int, books: CodeBooks, *, shortlist: int = 100
) -> DataFrame:
    """Approximate k nearest, ``query_id, chunk_id, distance, rank``, from codes and,
    for ``shortlist`` chunks per query, exact cosine distances. Vectors without
    direction are never found. Short lists are stored; the vectors are read once more,
    by id."""
    lists = land(short_lists(coded, queries, books, max(k, shortlist)).select("query_id", "chunk_id"), "short-lists")
    wanted = broadcast_if_small(lists)
    asked = queries.select("query_id", _unit("embedding").alias("_asked"))
    pairs = (
        chunks.select("chunk_id", "embedding").join(wanted, "chunk_id")
        .select("query_id", "chunk_id", _unit("embedding").alias("_unit")).join(asked, "query_id")
    )
    exact = pairs.select("query_id", "chunk_id", F.round(1.0 - _dot("_asked", "_unit"), DISTANCE_DIGITS).alias("distance"))
    return _rank_nearest(exact, k)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
