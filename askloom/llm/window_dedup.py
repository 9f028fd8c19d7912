"""Repeated passages by word windows, with a count-min prefilter.

First every block of documents sends its part of a count-min sketch: which cells
its windows fall into, and which of them more than once. The slices add the parts
up and tell each block the cells that hold two or more. A window whose cells are
all such may be repeated; no repeated window is missed. Then those windows alone
are grouped exactly, by a 128-bit hash, to find the first document of each. The
places of its windows a block sends to itself, so the last pass hashes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askloom.llm.common import (
    NO_ID,
    SQL_WORD,
    Layout,
    answer,
    ask,
    ask_again,
    block_words,
    blocked,
    by_slice,
    doc_ids,
    finish,
    join_parts,
    mix,
    pack,
    pack_any,
    split_parts,
    text_bytes,
    unpack,
    unpack_any,
    window_hashes,
)

WINDOW_WORDS = 13
#: Rows of the sketch, and its cells per byte of text in each row.
ROWS = 2
CELLS_PER_BYTE = 0.75


def cell_bits(size: int) -> int:
    """Binary digits of a cell number, for so many bytes of text."""
    return max(8, int(size * CELLS_PER_BYTE).bit_length())


@dataclass
class Cells:
    """The distinct windows of a block in one row of the sketch: the distinct cells
    in order, how many windows each holds, and which cell each window is in."""

    cell: np.ndarray
    total: np.ndarray
    of: np.ndarray

    @classmethod
    def of_row(cls, windows: np.ndarray, n: np.ndarray, row: int, bits: int) -> Cells:
        """``windows`` are distinct and in order, so those of row 0 need no sorting."""
        spread = windows if row == 0 else mix(windows + np.uint64(0x9E3779B97F4A7C15 * row & (1 << 64) - 1))
        spread = spread >> np.uint64(64 - bits)
        order = np.argsort(spread, kind="stable") if row else slice(None)
        spread, n = spread[order], n[order]
        starts = _starts(spread)
        of = np.empty(len(spread), np.int64)
        of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(spread))))
        total = np.add.reduceat(n, starts) if len(starts) else n
        return cls(spread[starts], total, of)


def _starts(*ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in arrays that are in order together."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_windows(counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Places where a window starts and ends in one document."""
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    return np.flatnonzero(np.arange(n) + width <= ends)


def repeated_passages(docs: DataFrame, width: int = WINDOW_WORDS, layout: Layout | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document.

    A window is ``width`` consecutive words (between ASCII white space, unchanged)
    of one document. A word goes if a window over it also starts in a document of
    smaller ``doc_id``; windows are judged on the input. The hash is that of the
    remaining words, joined by one blank.

    Null texts have no words. A null ``doc_id`` is larger than any other, and rows
    without one don't remove from each other; nor do rows that repeat an id. One
    row per row; other columns are ignored. Words are compared by 64-bit hashes.
    Runs a job to measure the texts.
    """
    size = text_bytes(docs)
    layout, bits = layout or Layout.of(size), cell_bits(size)
    blocks = blocked(docs, layout)

    def windows(table: pa.Table):
        """Documents in a fixed order, the document of each word, word hashes, the
        places where windows start, and the windows' hashes."""
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        words, counts = block_words(table)
        at = whole_windows(counts, width, max(0, len(words) - width + 1))
        return table, np.repeat(np.arange(len(counts)), counts), words, at, window_hashes(words, width)[at]

    def sketch_rows(distinct: np.ndarray, n: np.ndarray):
        rows = [Cells.of_row(distinct, n, row, bits) for row in range(ROWS)]
        keys = [r.cell << np.uint64(63 - bits) | np.uint64(k << 63) for k, r in enumerate(rows)]
        return rows, np.concatenate(keys)

    def sketch(table: pa.Table):
        found = np.sort(windows(table)[4])
        starts = _starts(found)
        rows, keys = sketch_rows(found[starts], np.diff(np.append(starts, len(found))))
        often = np.concatenate([r.total for r in rows]) > 1
        for s, a, b in by_slice(keys, layout.slices):
            yield s, join_parts(pack(keys[a:b] >> np.uint64(63 - bits)), np.packbits(often[a:b]).tobytes())

    def add_up(payloads: list[bytes]) -> list[bytes]:
        """A slice is a dense range of cells: one count, up to two, for each."""
        parts = [split_parts(p) for p in payloads]
        keys = [unpack(p[0]) for p in parts]
        base = min(k[0] for k in keys)
        total = np.zeros(int(max(k[-1] for k in keys) - base) + 1, np.uint8)
        for k, (_, often) in zip(keys, parts):
            k -= base
            more = np.unpackbits(np.frombuffer(often, np.uint8), count=len(k))
            total[k] = np.minimum(total[k] + more + np.uint8(1), 2)
        return [np.packbits(total[k] > 1).tobytes() for k in keys]

    def candidates(table: pa.Table, replies: dict[int, bytes]):
        block = table.column("block")[0].as_py()
        table, doc, words, at, found = windows(table)
        order = np.argsort(found)
        found, at = found[order], at[order]
        starts = _starts(found)
        n = np.diff(np.append(starts, len(found)))
        rows, keys = sketch_rows(found[starts], n)
        flags = np.zeros(len(keys), bool)
        for s, a, b in by_slice(keys, layout.slices):
            flags[a:b] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=b - a)
        maybe, first = np.ones(len(starts), bool), 0
        for r in rows:
            maybe &= flags[first : first + len(r.cell)][r.of]
            first += len(r.cell)
        maybe = np.repeat(maybe, n)
        at, first = at[maybe], found[maybe]
        second = window_hashes(words, width, seed=2)[at] if len(at) else np.empty(0, np.uint64)
        first, second, (at,) = in_order(first, second, at)
        ids = doc_ids(table)[doc[at]]
        starts = _starts(first, second)
        low = np.minimum.reduceat(ids, starts) if len(starts) else ids
        high = np.maximum.reduceat(ids, starts) if len(starts) else ids
        lengths = np.diff(np.append(starts, len(at)))
        first, second = first[starts], second[starts]
        for s, a, b in by_slice(first, layout.slices):
            yield s, join_parts(
                pack(first[a:b]), second[a:b].tobytes(), pack_any(low[a:b]), pack_any(high[a:b] - low[a:b])
            )
        yield layout.slices + block, join_parts(*(x.astype("<u4").tobytes() for x in (at, lengths)))

    def first_documents(payloads: list[bytes]) -> list[bytes]:
        parts = [split_parts(p) for p in payloads]
        if len(parts[0]) == 2:  # what a block keeps for itself
            return payloads
        first = [unpack(p[0]) for p in parts]
        bounds = np.cumsum([0, *map(len, first)])
        low = [unpack_any(p[2]).astype(np.int64) for p in parts]
        high = np.concatenate([unpack_any(p[3]).astype(np.int64) + x for p, x in zip(parts, low)])
        second = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
        every, other, (order,) = in_order(np.concatenate(first), second)
        starts = _starts(every, other)
        lengths = np.diff(np.append(starts, len(every)))
        least = np.empty(len(every), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(np.concatenate(low)[order], starts), lengths)
        gone = least < high
        return [
            join_parts(np.packbits(gone[a:b]).tobytes(), pack_any(least[a:b][gone[a:b]]), np.int64(b - a).tobytes())
            for a, b in zip(bounds, bounds[1:])
        ]

    def remove(table: pa.Table, replies: pa.Table) -> dict:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = table.column("text").to_pylist()
        counts = np.fromiter((len(t.encode().split()) for t in texts), np.int64, len(texts))
        *parts, mine = (split_parts(p) for p in replies.sort_by("slice").column("payload").to_pylist())
        at, lengths = (np.frombuffer(x, "<u4").astype(np.int64) for x in mine)
        least = np.full(len(lengths), NO_ID)
        first = 0
        for bit, ids, n in parts:
            n = int(np.frombuffer(n, np.int64)[0])
            gone = np.unpackbits(np.frombuffer(bit, np.uint8), count=n).astype(bool)
            least[first : first + n][gone] = unpack_any(ids).astype(np.int64)
            first += n
        own = doc_ids(table)[np.repeat(np.arange(len(counts)), counts)[at]]
        at = at[np.repeat(least, lengths) < own]
        total = int(counts.sum())
        cover = np.bincount(at, minlength=total + 1) - np.bincount(at + width, minlength=total + 1)
        covered = np.cumsum(cover[:total]) > 0
        ends = np.cumsum(counts)
        removed = np.add.reduceat(np.append(covered, False), ends - counts) * (counts > 0) if total else counts
        hashes = []
        for text, n, a, b in zip(texts, removed.tolist(), (ends - counts).tolist(), ends.tolist()):
            kept = text.encode().split()
            if n:
                kept = list(compress(kept, (~covered[a:b]).tolist()))
            hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"doc_id": table.column("doc_id").combine_chunks(), "n_words": counts, "n_removed": removed, "kept_sha256": hashes}

    repeated = answer(ask(blocks, sketch), add_up)
    firsts = answer(ask_again(blocks, repeated, candidates), first_documents)
    return finish(
        blocks, firsts, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def in_order(first: np.ndarray, second: np.ndarray, *others: np.ndarray):
    """128-bit keys in order, and other arrays with them (without any: the order
    itself). Sorting the second halves too is for keys that share a first half."""
    order = np.argsort(first, kind="stable")
    same = np.diff(first[order]) == 0
    if (same & (np.diff(second[order]) != 0)).any():
        order = np.lexsort((second, first))
    return first[order], second[order], [x[order] for x in others] or [order]


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SQL_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (
  SELECT k, min(doc_id) AS least FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (k) WHERE least < doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
