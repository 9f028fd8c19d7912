"""What several operators share: reading texts, hashing words, packing sorted
integers, and the exchange of digests between document blocks and hash slices."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import land

#: UTF-8 bytes of text that one block of documents holds on average, at least.
BLOCK_BYTES = 16 << 20
#: Text bytes whose digests one slice of the hash range answers for, at least.
SLICE_BYTES = 6 << 20
#: Null ids take this place in the order of documents: after all others.
NO_ID = (1 << 63) - 1
#: Column that tells stored rows apart, whatever their ids.
ROW = "_row_key"


def worker_store() -> dict:
    """Values that live as long as the Python worker, across its tasks."""
    return sys.__dict__.setdefault("_askloom_llm", {})


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id`` as long and ``text``, null read as empty; columns but ``others`` go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *others,
    )


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` stored with a number of its own for every row, in ``ROW``."""
    return land(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def by_row(keyed: DataFrame) -> DataFrame:
    """``doc_id, text`` of numbered rows, where the number stands in for the id."""
    return keyed.select(F.col(ROW).alias("doc_id"), "text")


def without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered rows but those whose number ``gone`` lists, without the number."""
    return keyed.join(gone.select(ROW), ROW, "left_anti").drop(ROW)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from a batch to columns (or None)."""
    types = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                made = work(piece)
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made[f.name], f.type) for f in types], schema=types
                    )

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes, so that the Python objects made of a
    batch stay few. A single longer row is a piece of its own."""
    n = batch.num_rows
    if batch.nbytes <= most or n <= 1:
        if n:
            yield batch
        return
    lengths = np.zeros(n)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            lengths += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    turn = np.floor(np.cumsum(lengths) / most)
    starts = np.flatnonzero(np.diff(turn, prepend=-1))
    for a, b in zip(starts, [*starts[1:], n]):
        yield batch.slice(a, b - a)


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# --------------------------------------------------------------------------
# words and shingles


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)
    for k in range(width):
        total += words[k : k + n] * factors[k]
    return mix(total + np.uint64(width))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def block_words(docs: pa.Table, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, documents end to end, and the number of
    words of each document."""
    counts: list[int] = []

    def words() -> Iterator[list[bytes]]:
        for text in docs.column("text").to_pylist():
            raw = text.encode()
            found = (raw.lower() if lower else raw).split()
            counts.append(len(found))
            yield found

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words())), np.uint64)
    return hashes, np.array(counts, np.int64)


def doc_ids(docs: pa.Table) -> np.ndarray:
    """Ids for comparison: null is after all others."""
    return docs.column("doc_id").fill_null(NO_ID).to_numpy()


# --------------------------------------------------------------------------
# packed arrays


def pack(values: np.ndarray) -> bytes:
    """A non-decreasing array of unsigned 64-bit integers as compressed
    differences, byte plane by byte plane."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return pack_any(steps)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_any(data), dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(
        np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    )
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_any(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def join_parts(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return head + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    lengths = np.frombuffer(data, "<u4", n, 4)
    ends = np.cumsum(lengths) + 4 * (n + 1)
    return [data[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist())]


# --------------------------------------------------------------------------
# blocks of documents and slices of the hash range
#
# Operators that ask of every window of a text where else it occurs don't shuffle
# a row per window. Each block of documents sends each slice of the hash range one
# packed array of the distinct digests that fall there, and gets an answer for
# them. What is sent grows with the distinct digests of a block; a digest of a
# third of all documents still comes once from each block.


@dataclass(frozen=True)
class Layout:
    """Numbers of blocks and slices for so many bytes of text.

    Every block sends to every slice, so both grow with the root of the input once
    their least sizes would make the packed arrays short: at 100 TB of text a block
    is half a gigabyte, and a task needs about ten times its block in memory."""

    blocks: int
    slices: int

    @classmethod
    def of(cls, size: int, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> Layout:
        least = math.isqrt(1500 * size)
        return cls(
            max(1, -(-size // max(block_bytes, least))), max(1, -(-size // max(slice_bytes, least)))
        )


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts (one job)."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def blocked(docs: DataFrame, layout: Layout) -> DataFrame:
    """``block, doc_id, text``: documents dealt by hash. Id and text both count, so
    neither null ids nor copies meet in one block. However often one plan groups
    by ``block``, Spark moves the texts once."""
    return texts(docs).select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.blocks)).cast("int").alias("block"),
        "doc_id",
        "text",
    )


_MESSAGE = "block int, slice int, payload binary"
Sent = Iterable[tuple[int, bytes]]


def _messages(block: int, sent: Sent) -> pa.Table:
    rows = list(sent)
    return pa.table(
        {
            "block": pa.array([block] * len(rows), pa.int32()),
            "slice": pa.array([r[0] for r in rows], pa.int32()),
            "payload": pa.array([r[1] for r in rows], pa.binary()),
        }
    )


def ask(blocks: DataFrame, send: Callable[[pa.Table], Sent]) -> DataFrame:
    """``block, slice, payload``: what each block sends to each slice."""

    def run(key, docs):
        return _messages(key[0].as_py(), send(docs))

    return blocks.groupBy("block").applyInArrow(run, _MESSAGE)


def ask_again(blocks: DataFrame, replies: DataFrame, send: Callable[[pa.Table, dict[int, bytes]], Sent]) -> DataFrame:
    """As ``ask``, once the replies to an earlier question (by slice) are there."""

    def run(key, docs, answers):
        if not docs.num_rows:
            return _messages(0, [])
        return _messages(key[0].as_py(), send(docs, by_number(answers)))

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _MESSAGE)


def by_number(replies: pa.Table) -> dict[int, bytes]:
    return dict(zip(replies.column("slice").to_pylist(), replies.column("payload").to_pylist()))


def answer(asked: DataFrame, merge: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``block, slice, payload``: each slice sees what all blocks sent it, in the
    order of the blocks, and replies to every one of them."""

    def run(key, table):
        table = table.sort_by("block")
        replies = merge(table.column("payload").to_pylist())
        return pa.table(
            {
                "block": table.column("block").cast(pa.int32()),
                "slice": table.column("slice").cast(pa.int32()),
                "payload": pa.array(replies, pa.binary()),
            }
        )

    return asked.groupBy("slice").applyInArrow(run, _MESSAGE)


def finish(
    blocks: DataFrame, replies: DataFrame, work: Callable[[pa.Table, pa.Table], dict], schema: str
) -> DataFrame:
    """Rows that ``work`` makes of each block's documents and its replies."""
    types = arrow_schema(blocks, schema)

    def run(key, docs, answers):
        made = work(docs, answers) if docs.num_rows else {f.name: [] for f in types}
        return pa.table([pa.array(made[f.name], f.type) for f in types], schema=types)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def by_slice(sorted_keys: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """``(slice, start, end)`` of each slice of the 64-bit range that holds keys."""
    width = -(-(1 << 64) // slices)
    edges = [i * width for i in range(1, slices)]
    at = np.searchsorted(sorted_keys, np.array(edges, np.uint64)) if edges else []
    bounds = [0, *map(int, at), len(sorted_keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of several sorted arrays, the place of every input among
    them (all inputs end to end) and the inputs' bounds."""
    every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    distinct = np.unique(every)
    place = np.searchsorted(distinct, every)
    bounds = np.cumsum([0, *map(len, keys)]).tolist()
    return distinct, place, bounds


# --------------------------------------------------------------------------
# the same in DuckDB's SQL

#: Texts in lower case A-Z, and the pattern of a word.
SQL_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
SQL_WORD = r"'[^\x20\x09-\x0D]+'"
