"""Chunk windows, chunk ids and the width classes of embedding tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import words

#: Widths an embedding table may have (fixed values).
DIMENSION_BUCKETS = (256, 384, 512, 1024, 2048, 4096)


def window_step(size: int, overlap_share: float) -> int:
    """Tokens between window starts; the overlap is rounded down."""
    step = size - math.floor(size * overlap_share)
    if step <= 0:
        raise ValueError(f"overlap {overlap_share} leaves no step for windows of {size} tokens")
    return step


def _join_words(windows: Column) -> Column:
    return F.transform(windows, lambda tokens: F.array_join(tokens, " "))


def chunk_windows(
    tokens: Column,
    size: int,
    overlap_share: float,
    *,
    joiner: Callable[[Column], Column] = _join_words,
    drop_contained: bool = False,
) -> Column:
    """Array of window texts over an array of tokens.

    Windows start at 0, step, 2*step ... while the start lies inside the
    tokens, so a last window may lie wholly inside the one before it;
    ``drop_contained`` leaves such windows out. Windows with empty text are
    dropped before anything is numbered.
    """
    step = window_step(size, overlap_share)
    count = F.size(tokens)
    last_start = F.greatest(count - size + step - 1, F.lit(0)) if drop_contained else count - 1
    starts = F.when(count > 0, F.sequence(F.lit(0), last_start, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )
    windows = F.transform(starts, lambda start: F.slice(tokens, start + 1, F.lit(size)))
    texts = joiner(windows)
    return F.filter(texts, lambda text: text != "")


def chunk_overlap(
    df: DataFrame,
    text: str,
    size: int,
    overlap_share: float,
    *,
    tokens: Callable[[Column], Column] = words,
    joiner: Callable[[Column], Column] = _join_words,
    drop_contained: bool = False,
) -> DataFrame:
    """One row per window: the input columns without ``text``, then
    ``chunk_index`` and ``chunk_text``. No shuffle: windows are cut in the row.

    ``tokens`` maps the text to an array of tokens, ``joiner`` an array of token
    windows to an array of texts; both may be pandas UDFs of a model's tokenizer.
    """
    kept = [name for name in df.columns if name != text]
    # The token array is projected first, so it is split once for all windows.
    with_tokens = df.select(*kept, tokens(F.col(text)).alias("_tokens"))
    windows = chunk_windows(
        F.col("_tokens"), size, overlap_share, joiner=joiner, drop_contained=drop_contained
    )
    return with_tokens.select(*kept, F.posexplode(windows).alias("chunk_index", "chunk_text"))


def chunk_id(question_id: Column, answer_id: Column, chunk_index: Column) -> Column:
    return F.concat(
        F.lit("q"), question_id.cast("string"),
        F.lit("_a"), answer_id.cast("string"),
        F.lit("_c"), chunk_index.cast("string"),
    )


def dimension_bucket(width: Column, *, refuse: bool = True) -> Column:
    """Smallest table width that holds the vector. Wider than the widest fails, or
    is null with ``refuse=False``."""
    chosen = F.when(width <= DIMENSION_BUCKETS[0], F.lit(DIMENSION_BUCKETS[0]))
    for bound in DIMENSION_BUCKETS[1:]:
        chosen = chosen.when(width <= bound, F.lit(bound))
    if not refuse:
        return chosen
    refusal = F.raise_error(
        F.concat(F.lit("no embedding table holds vectors of width "), width.cast("string"))
    )
    return chosen.when(width > DIMENSION_BUCKETS[-1], refusal.cast("int"))
