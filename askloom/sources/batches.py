"""Arrow batches of a given number of rows, for one plug-in at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

Plugin = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_batches(work: Plugin, rows: int) -> Plugin:
    """``work`` for ``mapInArrow``, fed with batches of ``rows`` rows (a task's last one
    may be smaller), whatever size the session sends. Other plug-ins of the session
    keep theirs. At most ``rows`` rows and one batch of the session are held."""
    if rows <= 0:
        raise ValueError("rows must be positive")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while size + batch.num_rows >= rows:
                first = batch.slice(0, rows - size)
                batch = batch.slice(rows - size)
                yield _joined([*held, first])
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield _joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(cut(batches))

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0]
