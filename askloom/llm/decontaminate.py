"""Benchmark decontamination by containment search.

Test items are parted by size. Each item keeps its smallest shingle hashes (its
bottom MinHash), so many for its size class that a document which holds the asked
share of the item's shingles must hold one of them: with ``q`` shingles and a
containment of ``t``, at most ``floor((1 - t) q)`` may be missing, and one more
than that is kept. Documents, however long, are probed shingle by shingle in one
pass; every candidate is verified on the words of both texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import (
    SQL_LOWER,
    SQL_WORD,
    arrow_schema,
    pieces,
    texts,
    window_hashes,
    word_hashes,
)
from askloom.session import land

SHINGLE_WORDS = 5
CONTAINMENT = 80
#: UTF-8 bytes of item texts that are sent to the tasks at once.
ITEM_BYTES = 16 << 20


def size_class(n: int) -> int:
    """Upper bound of the size class of an item with ``n`` shingles: the next of
    four steps per power of two."""
    if n <= 4:
        return n
    step = 1 << max(0, (n - 1).bit_length() - 3)
    return -(-n // step) * step


def minima_kept(n: int, percent: int) -> int:
    """Minima of an item with ``n`` shingles: what its class needs, all at most."""
    bound = size_class(n)
    return min(n, bound * (100 - percent) // 100 + 1)


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class Items:
    """The minima of a set of items, by shingle width, sorted for lookup."""

    def __init__(self, rows: list[tuple[int, str]], percent: int):
        self.percent, self.rows = percent, []
        by_width: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item, text in rows:
            words = text.encode().lower().split()
            if not words:
                continue
            width = min(SHINGLE_WORDS, len(words))
            hashes = np.unique(window_hashes(word_hashes(words), width))
            keep = hashes[: minima_kept(len(hashes), percent)]
            by_width[width][0].append(keep)
            by_width[width][1].append(np.full(len(keep), len(self.rows)))
            self.rows.append((item, width, shingles(words, width)))
        self.minima = {}
        for width, (hashes, owners) in by_width.items():
            h, o = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            self.minima[width] = h[order], o[order]

    def found_in(self, text: str):
        """``key, n_item, n_shared`` of the items that a text contains."""
        words = text.encode().lower().split()
        hashed = word_hashes(words)
        maybe: set[int] = set()
        for width, (hashes, owners) in self.minima.items():
            probe = np.unique(window_hashes(hashed, width))
            lo, hi = np.searchsorted(probe, hashes), np.searchsorted(probe, hashes, "right")
            maybe.update(owners[hi > lo].tolist())
        own: dict[int, set] = {}
        for i in sorted(maybe):
            item, width, want = self.rows[i]
            if width not in own:
                own[width] = shingles(words, width)
            shared = len(want & own[width])
            if 100 * shared >= self.percent * len(want):
                yield item, len(want), shared


def contained_items(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared``: documents that contain ``percent`` / 100
    or more of the distinct five-word shingles of an item (``item_id, text``).

    Texts are compared in lower case A-Z, words between ASCII white space; of fewer
    words the whole item is one shingle. Items without words are contained in
    nothing, null texts are empty. One row per row of ``docs`` and of ``items``;
    null ids stay null. Other columns are ignored.

    The items are a stated query set: their distinct texts are sent to all tasks in
    blocks of about ``ITEM_BYTES``, however often an item repeats; each further block
    is one more pass over the documents. Reads the items when called.
    """
    source, asked = texts(docs), _asked(items)
    distinct = _distinct(asked)
    found = None
    for rows in _item_blocks(distinct):
        made = _probe(source, rows, percent)
        found = made if found is None else found.unionByName(made)
    named = asked.join(distinct, "text").select("key", "item_id")
    return found.join(named, "key").select("doc_id", "item_id", "n_item", "n_shared")


def _asked(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def _distinct(asked: DataFrame) -> DataFrame:
    """``key, text`` of the different texts, stored."""
    return land(asked.select("text").distinct().withColumn("key", F.monotonically_increasing_id()), "items")


def _item_blocks(distinct: DataFrame) -> Iterator[list[tuple[int, str]]]:
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for k in range(blocks):
        yield [tuple(r) for r in distinct.where(part == k).select("key", "text").toLocalIterator()]


_SCHEMA = "doc_id long, key long, n_item long, n_shared long"


def _probe(source: DataFrame, rows: list[tuple[int, str]], percent: int) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(rows)
    schema = arrow_schema(source, _SCHEMA)

    def run(batches):
        items = Items(shared.value, percent)
        for batch in batches:
            for piece in pieces(batch):
                out = [
                    (doc, *hit)
                    for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist())
                    for hit in items.found_in(text)
                ]
                columns = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return source.mapInArrow(run, _SCHEMA)


def clean_rows(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that contain an item, all columns kept. Every row is
    judged by its own text, whatever its id. Items are read as by ``contained_items``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for rows in _item_blocks(_distinct(_asked(items))):
        docs = docs.where(~_contains(docs.sparkSession.sparkContext.broadcast(rows), percent)(text))
    return docs


def _contains(shared: Broadcast, percent: int):
    @F.arrow_udf("boolean")
    def contains(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shared.value, percent)
        for batch in texts:
            yield pa.array([next(items.found_in(t.as_py()), None) is not None for t in batch], pa.bool_())

    return contains


SQL = f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({SQL_LOWER}, {SQL_WORD}) AS w FROM benchmark
), items AS (
  SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT *, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0))
), sets AS (
  SELECT DISTINCT item_id, k, s FROM items
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM sets GROUP BY item_id
), words AS (
  SELECT doc_id, regexp_extract_all({SQL_LOWER}, {SQL_WORD}) AS w FROM documents
), held AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i
        FROM words CROSS JOIN (SELECT DISTINCT k FROM sets))
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM held JOIN sets USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN sizes USING (item_id)
WHERE 100 * n_shared >= 80 * n_item
"""
