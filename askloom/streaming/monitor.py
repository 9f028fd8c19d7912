"""Metrics of a request log per tumbling window.

The same functions take a stored log and a stream. A stream needs ``watermark``:
windows close once the watermark passes them and later rows are dropped.
All counts combine before the shuffle, so one busy step is no hot spot.

Log columns: ``ts`` (timestamp), ``step``, ``seconds``, ``failed``,
``fallback_reason``, ``judge`` scores and gauge columns, as each metric needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bucket bounds in seconds (fixed values).
STEP_BOUNDS = (0.01, 0.05, 0.1, 0.3, 0.5, 1, 2, 3, 5, 10, 30)
TOTAL_BOUNDS = (0.1, 0.3, 0.5, 1, 2, 3, 5, 10, 30)
#: Columns that are reported as last values.
GAUGES = ("retrieved_chunks", "reranked_chunks", "best_rrf", "best_rerank")


def _per_window(
    log: DataFrame, window: str, watermark: str | None, *keys: str
) -> GroupedData:
    if log.isStreaming:
        if not watermark:
            raise ValueError("a streaming log needs a watermark")
        log = log.withWatermark("ts", watermark)
    return log.groupBy(F.window("ts", window).alias("window"), *keys)


def _flat(df: DataFrame) -> DataFrame:
    others = [name for name in df.columns if name != "window"]
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *others,
    )


def request_counters(log: DataFrame, window: str, watermark: str | None = None) -> DataFrame:
    """Requests and failed requests."""
    return _flat(
        _per_window(log, window, watermark).agg(
            F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors")
        )
    )


def _bucket_name(bound: float) -> str:
    return "le_" + f"{bound:g}".replace(".", "_")


def _histogram(bounds: Sequence[float]) -> list[Column]:
    """Cumulative counts: a value counts in every bucket whose bound it does
    not exceed."""
    return [
        *[
            F.count_if(F.col("seconds") <= F.lit(float(bound))).alias(_bucket_name(bound))
            for bound in bounds
        ],
        F.count("seconds").alias("le_inf"),
        F.sum("seconds").alias("seconds_sum"),
        F.count("seconds").alias("seconds_count"),
    ]


def step_latency_histogram(
    log: DataFrame,
    window: str,
    watermark: str | None = None,
    bounds: Sequence[float] = STEP_BOUNDS,
) -> DataFrame:
    """Latency histogram per step; failed steps count as well."""
    return _flat(_per_window(log, window, watermark, "step").agg(*_histogram(bounds)))


def total_latency_histogram(
    log: DataFrame,
    window: str,
    watermark: str | None = None,
    bounds: Sequence[float] = TOTAL_BOUNDS,
) -> DataFrame:
    return _flat(_per_window(log, window, watermark).agg(*_histogram(bounds)))


def quality_gauges(
    log: DataFrame,
    window: str,
    watermark: str | None = None,
    gauges: Sequence[str] = GAUGES,
) -> DataFrame:
    """Last value of every gauge in the window. Rows of the same time are
    settled by ``event_id``."""
    at = F.struct("ts", "event_id")
    last = [
        F.max_by(F.col(name), F.when(F.col(name).isNotNull(), at)).alias(name) for name in gauges
    ]
    return _flat(_per_window(log, window, watermark).agg(*last))


def carried_gauges(
    log: DataFrame, window: str, watermark: str | None = None, gauges: Sequence[str] = GAUGES
) -> DataFrame:
    """``gauge, window_start, window_end, value``: like ``quality_gauges`` by rows, but
    a gauge keeps its value, so windows without one show the last before them. A
    gauge begins with its first value.

    A stored log is filled up to the last window in which any gauge has a value. A
    stream (append mode) shows windows once the watermark has closed them; a timer
    does so where nothing arrives for a gauge. Its state is one value per gauge.
    """
    values = F.array(*[F.struct(F.lit(g).alias("gauge"), F.col(g).cast("double").alias("value")) for g in gauges])
    bounds = F.window("ts", window)
    long = log.select("ts", "event_id", F.inline(values)).where("value IS NOT NULL")
    long = long.withColumn("_w", bounds).select(
        "gauge", F.unix_millis("_w.start").alias("start"), F.unix_millis("_w.end").alias("end"),
        "ts", "event_id", "value",
    )
    if log.isStreaming:
        if not watermark:
            raise ValueError("a streaming log needs a watermark")
        # Readings combine in their tasks first, so a busy gauge is no hot spot.
        filled = (
            long.mapInPandas(_last_readings, long.schema).withWatermark("ts", watermark).groupBy("gauge")
            .applyInPandasWithState(
                _carry, "gauge string, start long, end long, value double",
                "until long, step long, value double, open array<struct<start:bigint,at:bigint,id:bigint,value:double>>",
                "append", GroupStateTimeout.EventTimeTimeout,
            )
        )
    else:
        seen = long.groupBy("gauge", "start", "end").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
        each = Window.partitionBy("gauge").orderBy("start")
        newest = seen.select(F.max("start")).scalar()
        step = F.col("end") - F.col("start")
        filled = (
            seen.select("gauge", "start", step.alias("_step"), "value", F.lead("start").over(each).alias("_next"))
            .withColumn("_until", F.coalesce(F.col("_next") - F.col("_step"), newest))
            .select("gauge", F.explode(F.sequence("start", "_until", "_step")).alias("start"), "_step", "value")
            .withColumn("end", F.col("start") + F.col("_step"))
        )
    return filled.select(
        "gauge", F.timestamp_millis("start").alias("window_start"), F.timestamp_millis("end").alias("window_end"), "value"
    )


def _last_readings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.sort_values(["ts", "event_id"]).drop_duplicates(["gauge", "start"], keep="last")


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Windows of one gauge that the watermark has closed, with those between them
    that have no value. The state is the last value shown, and the last readings of
    windows that are still open."""
    until, step, value, left = state.get if state.exists else (None, None, None, [])
    open_ = {r[0]: tuple(r) for r in left}
    for frame in frames:
        columns = (frame[n].tolist() for n in ("start", "end", "ts", "event_id", "value"))
        for start, end, ts, event, reading in zip(*columns):
            row = (start, int(ts.value), event, reading)
            step = end - start
            if start not in open_ or open_[start] < row:
                open_[start] = row
    now, made = state.getCurrentWatermarkMs(), []
    for start, _, _, reading in sorted(open_.values()):
        if start + step > now:
            break
        while until is not None and until < start:
            made.append((key[0], until, until + step, value))
            until += step
        made.append((key[0], start, start + step, reading))
        until, value = start + step, reading
        del open_[start]
    while until is not None and until + step <= min([now, *open_]):
        made.append((key[0], until, until + step, value))
        until += step
    if step is not None:
        state.update((until, step, value, sorted(open_.values())))
        state.setTimeoutTimestamp(min([s + step for s in open_] + ([until + step] if until is not None else [])))
    yield pd.DataFrame(made, columns=["gauge", "start", "end", "value"])


def request_steps(
    requests: DataFrame, steps: DataFrame, within: str, watermark: str | None = None
) -> DataFrame:
    """Step rows with the request that they belong to: the same ``request_id``, at
    most ``within`` after it. ``requests(request_id, ts)``; the steps' columns and
    ``requested_at, seconds`` come out. Of two streams, each side is kept only as long
    as the watermark and the interval ask for."""
    asked = requests.select("request_id", F.col("ts").alias("requested_at"))
    if steps.isStreaming or asked.isStreaming:
        if not watermark:
            raise ValueError("a streaming log needs a watermark")
        asked, steps = asked.withWatermark("requested_at", watermark), steps.withWatermark("ts", watermark)
    near = (F.col("s.request_id") == F.col("r.request_id")) & F.col("ts").between(
        F.col("requested_at"), F.col("requested_at") + F.expr(f"INTERVAL {within}")
    )
    took = (F.unix_micros("ts") - F.unix_micros("requested_at")) / 1e6
    return steps.alias("s").join(asked.alias("r"), near).select("s.*", "requested_at", took.alias("seconds"))


def late_rows(query: StreamingQuery) -> int:
    """Rows (for aggregates: partial groups) that came after the watermark and were
    dropped, over the progress that the query still remembers."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for operator in progress["stateOperators"]
    )


def fallbacks_by_reason(log: DataFrame, window: str, watermark: str | None = None) -> DataFrame:
    """Fallback answers per reason; rows without a reason are not fallbacks."""
    fallen = log.where(F.col("fallback_reason").isNotNull())
    return _flat(
        _per_window(fallen, window, watermark, "fallback_reason").agg(
            F.count(F.lit(1)).alias("fallbacks")
        )
    )


def judge_means(log: DataFrame, window: str, watermark: str | None = None) -> DataFrame:
    """Mean judge scores per window."""
    scores = ("faithfulness", "answer_relevance", "context_relevance")
    return _flat(
        _per_window(log, window, watermark).agg(
            *[F.avg(name).alias(f"mean_{name}") for name in scores]
        )
    )
