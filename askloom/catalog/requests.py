"""Request-log metrics and model-output parsing over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog.registry import query
from askloom.catalog.tables import document_chunks, SQL_CHUNKS, table
from askloom.functions import verdicts
from askloom.operators import judging
from askloom.streaming import monitor

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_SHARE = f"'0.' || lpad(CAST({_K} AS VARCHAR), 2, '0')"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def _share():
    return F.concat(F.lit("0."), F.lpad(F.col("k").cast("string"), 2, "0"))


def request_log(spark, sf):
    """Events as a request log: the type is the step, errors are failures."""

    def only(kind: str, value):
        return F.when(F.col("event_type") == kind, value)

    return _events(spark, sf).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("step"),
        (F.col("value") / 100).alias("seconds"),
        (F.col("event_type") == "error").alias("failed"),
        only("error", F.when(F.col("k") < 50, F.lit("no_chunks"))
             .otherwise(F.lit("low_retrieval_confidence"))).alias("fallback_reason"),
        only("view", F.col("k")).alias("retrieved_chunks"),
        only("click", F.col("k")).alias("reranked_chunks"),
        only("purchase", F.col("value")).alias("best_rrf"),
        only("signup", F.col("value")).alias("best_rerank"),
        (F.col("k") / 100).alias("faithfulness"),
        (F.col("value") / 1000).alias("answer_relevance"),
        only("click", F.col("k") / 200).alias("context_relevance"),
    )


def _plain_times(df):
    """Window bounds without a zone, and sums rounded, for comparison."""
    for name in ("window_start", "window_end"):
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


_HOUR = """date_trunc('hour', ts) AS window_start,
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end"""


@query(
    "request_counters",
    f"""SELECT {_HOUR}, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors
    FROM events GROUP BY 1, 2""",
)
def request_counters(spark, sf):
    return _plain_times(monitor.request_counters(request_log(spark, sf), "1 hour"))


def _sql_histogram(bounds, keys: str) -> str:
    buckets = ", ".join(
        f"count(*) FILTER (value / 100 <= {float(b)}) AS {monitor._bucket_name(b)}" for b in bounds
    )
    extra = f"event_type AS {keys}, " if keys else ""
    return f"""SELECT {_HOUR}, {extra}{buckets}, count(value) AS le_inf,
      round(sum(value / 100), 4) AS seconds_sum, count(value) AS seconds_count
    FROM events GROUP BY ALL"""


def _rounded_sum(df):
    return _plain_times(df).withColumn("seconds_sum", F.round("seconds_sum", 4))


@query("step_latency_histogram", _sql_histogram(monitor.STEP_BOUNDS, "step"))
def step_latency_histogram(spark, sf):
    return _rounded_sum(monitor.step_latency_histogram(request_log(spark, sf), "1 hour"))


@query("total_latency_histogram", _sql_histogram(monitor.TOTAL_BOUNDS, ""))
def total_latency_histogram(spark, sf):
    return _rounded_sum(monitor.total_latency_histogram(request_log(spark, sf), "1 hour"))


def _sql_last(value: str, kind: str, name: str) -> str:
    return (
        f"arg_max(CASE WHEN event_type = '{kind}' THEN {value} END, "
        f"CASE WHEN event_type = '{kind}' THEN event_id END) AS {name}"
    )


@query(
    "quality_gauges",
    f"""SELECT {_HOUR}, {_sql_last(_K, 'view', 'retrieved_chunks')},
      {_sql_last(_K, 'click', 'reranked_chunks')}, {_sql_last('value', 'purchase', 'best_rrf')},
      {_sql_last('value', 'signup', 'best_rerank')}
    FROM events GROUP BY 1, 2""",
)
def quality_gauges(spark, sf):
    return _plain_times(monitor.quality_gauges(request_log(spark, sf), "1 hour"))


_GAUGE_VALUES = " UNION ALL ".join(
    f"SELECT '{gauge}' AS gauge, ts, event_id, {value}::DOUBLE AS value FROM events WHERE event_type = '{kind}'"
    for gauge, kind, value in (
        ("retrieved_chunks", "view", _K), ("reranked_chunks", "click", _K),
        ("best_rrf", "purchase", "value"), ("best_rerank", "signup", "value"),
    )
)


@query(
    "carried_gauges",
    f"""WITH readings AS ({_GAUGE_VALUES}),
    known AS (
      SELECT gauge, time_bucket(INTERVAL 10 minutes, ts) AS w, arg_max(value, (ts, event_id)) AS value
      FROM readings WHERE value IS NOT NULL GROUP BY ALL),
    spans AS (SELECT min(w) AS a, max(w) AS b FROM known),
    steps AS (SELECT unnest(generate_series(a, b, INTERVAL 10 minutes)) AS w FROM spans),
    gauges AS (SELECT gauge, min(w) AS first FROM known GROUP BY gauge)
    SELECT gauge, s.w AS window_start, s.w + INTERVAL 10 minutes AS window_end, value
    FROM (SELECT gauge, w FROM steps JOIN gauges ON w >= first) s ASOF JOIN known k USING (gauge, w)""",
)
def carried_gauges(spark, sf):
    return _plain_times(monitor.carried_gauges(request_log(spark, sf), "10 minutes"))


@query(
    "request_steps",
    """SELECT s.event_id, s.user_id AS request_id, epoch(s.ts - r.ts)::DOUBLE AS seconds
    FROM events s JOIN events r ON s.user_id = r.user_id AND s.event_type = 'click'
     AND r.event_type = 'view' AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 6 hours""",
)
def request_steps(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    views, clicks = (events.where(F.col("event_type") == kind) for kind in ("view", "click"))
    found = monitor.request_steps(views, clicks, "6 hours")
    return found.select("event_id", "request_id", "seconds")


@query(
    "fallbacks_by_reason",
    f"""SELECT {_HOUR}, CASE WHEN {_K} < 50 THEN 'no_chunks' ELSE 'low_retrieval_confidence' END
        AS fallback_reason, count(*) AS fallbacks
    FROM events WHERE event_type = 'error' GROUP BY ALL""",
)
def fallbacks_by_reason(spark, sf):
    return _plain_times(monitor.fallbacks_by_reason(request_log(spark, sf), "1 hour"))


@query(
    "judge_means",
    f"""SELECT {_HOUR}, round(avg({_K} / 100.0), 12) AS mean_faithfulness,
      round(avg(value / 1000), 12) AS mean_answer_relevance,
      round(avg(CASE WHEN event_type = 'click' THEN {_K} / 200.0 END), 12)
        AS mean_context_relevance
    FROM events GROUP BY 1, 2""",
)
def judge_means(spark, sf):
    means = _plain_times(monitor.judge_means(request_log(spark, sf), "1 hour"))
    for name in ("faithfulness", "answer_relevance", "context_relevance"):
        means = means.withColumn(f"mean_{name}", F.round(f"mean_{name}", 12))
    return means


# --------------------------------------------------------------------------
# model output


def _outputs(spark, sf):
    """Model output of every event: full and partial JSON, prose and nothing."""
    share = _share()
    output = (
        F.when(
            F.col("event_type") == "click",
            F.concat(
                F.lit('{"faithfulness": '), share, F.lit(', "answer_relevance": 0.5, '),
                F.lit('"context_relevance": '), share, F.lit(', "is_grounded": true, "reason": "k'),
                F.col("k"), F.lit('"}'),
            ),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit('{"faithfulness": '), share, F.lit("}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Score: "), "k", F.lit("/10")))
        .when(F.col("event_type") == "error", F.concat(F.lit("about -"), share, F.lit(" of 1")))
    )
    # Some valid verdicts hold a number as text, others go on after the object.
    output = (
        F.when(
            (F.col("event_type") == "view") & (F.col("k") % 3 == 1),
            F.concat(F.lit('{"faithfulness": "'), share, F.lit('", "is_grounded": "unsure"}')),
        )
        .when((F.col("event_type") == "click") & (F.col("k") % 5 == 2), F.concat(output, F.lit(" ok")))
        .otherwise(output)
    )
    return _events(spark, sf).select("event_id", output.alias("model_output"))


_SQL_OUTPUTS = f"""
shares AS (SELECT event_id, event_type, {_K} AS k, {_SHARE} AS share FROM events),
outputs AS (
  SELECT event_id, event_type, k, share, CASE event_type
    WHEN 'purchase' THEN 'Score: ' || k || '/10'
    WHEN 'error' THEN 'about -' || share || ' of 1'
    WHEN 'click' THEN 'json' WHEN 'view' THEN 'json' END AS model_output,
    CASE WHEN event_type = 'click' AND k % 5 = 2 THEN 'bad' ELSE event_type END AS shape
  FROM shares)"""
_SQL_VERDICT = f"""
verdicts AS (
  SELECT event_id,
    CASE WHEN shape IN ('click', 'view') THEN CAST(share AS DOUBLE) ELSE 0.0 END
      AS faithfulness,
    CASE WHEN shape = 'click' THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END AS answer_relevance,
    CASE WHEN shape = 'click' THEN CAST(share AS DOUBLE) ELSE 0.0 END AS context_relevance,
    shape = 'click' AS is_grounded,
    CASE shape WHEN 'click' THEN 'k' || k WHEN 'view' THEN '' ELSE 'invalid json' END AS reason
  FROM outputs)"""


@query(
    "judge_score",
    f"""WITH {_SQL_OUTPUTS}
    SELECT event_id, CASE event_type WHEN 'signup' THEN 0.0
        WHEN 'purchase' THEN least(1.0, CAST(k AS DOUBLE)) ELSE CAST(share AS DOUBLE) END AS score
    FROM outputs""",
)
def judge_score(spark, sf):
    return _outputs(spark, sf).select(
        "event_id", verdicts.judge_score(F.col("model_output")).alias("score")
    )


@query("judge_json", f"WITH {_SQL_OUTPUTS}, {_SQL_VERDICT} SELECT * FROM verdicts")
def judge_json(spark, sf):
    return _outputs(spark, sf).select(
        "event_id", verdicts.judge_json(F.col("model_output")).alias("v")
    ).select("event_id", "v.*")


@query(
    "judge_answers",
    f"""WITH {_SQL_OUTPUTS}, {_SQL_VERDICT}
    SELECT v.*, e.user_id FROM verdicts v JOIN events e USING (event_id)""",
)
def judge_answers(spark, sf):
    users = table(spark, sf, "events").select("event_id", "user_id")
    return judging.judge_answers(_outputs(spark, sf).join(users, "event_id"))


@query(
    "agent_decision",
    f"""SELECT event_id, CASE shape WHEN 'click' THEN 'reject'
        WHEN 'view' THEN 'answer_without_search' WHEN 'purchase' THEN 'browse'
        ELSE 'search_documents' END AS action,
      CASE WHEN shape IN ('click', 'view', 'purchase') THEN 'k' || {_K}
        ELSE 'fallback_to_search' END AS reason,
      CASE shape WHEN 'click' THEN 'reject' WHEN 'view' THEN 'answer_without_search'
        ELSE 'search_documents' END AS route
    FROM (SELECT *, CASE WHEN {_K} % 4 = 1 THEN 'bad' ELSE event_type END AS shape FROM events)""",
)
def agent_decision(spark, sf):
    def decision(action: str):
        return F.concat(F.lit(f'{{"action": "{action}", "reason": "k'), F.col("k"), F.lit('"}'))

    output = (
        F.when(F.col("event_type") == "click", decision("reject"))
        .when(F.col("event_type") == "view", decision("answer_without_search"))
        .when(F.col("event_type") == "purchase", decision("browse"))
        .when(F.col("event_type") == "error", F.lit("let me search"))
    )
    # Words after the object make the decision unusable.
    output = F.when(F.col("k") % 4 == 1, F.concat(output, F.lit(" ok"))).otherwise(output)
    return _events(spark, sf).select(
        "event_id", verdicts.agent_decision(output).alias("d")
    ).select("event_id", "d.*")


@query(
    "faithfulness_verdict",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS faithful,
      CASE WHEN toxic = 1 THEN '' ELSE 'label of ' || doc_id END AS comments
    FROM labels""",
)
def faithfulness_verdict(spark, sf):
    said = F.when(F.col("quality") == 1, F.lit("Faithful: Yes")).otherwise(F.lit("faithful:  no"))
    output = F.when(F.col("toxic") == 1, F.lit("I cannot tell.")).otherwise(
        F.concat(said, F.lit("\nComments: label of "), "doc_id")
    )
    return table(spark, sf, "labels").select(
        "doc_id", verdicts.faithfulness_verdict(output).alias("v")
    ).select("doc_id", "v.*")


@query(
    "pseudo_labels",
    f"""WITH {SQL_CHUNKS}
    SELECT doc_id AS query_id, chunk_id,
           coalesce(chunk_index IN (quality, toxic + 2), false) AS relevant
    FROM chunks LEFT JOIN labels USING (doc_id)""",
)
def pseudo_labels(spark, sf):
    ranked = document_chunks(spark, sf).select(
        F.col("doc_id").alias("query_id"), "chunk_id", "chunk_index"
    )
    outputs = table(spark, sf, "labels").select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit("relevant: ["), "quality", F.lit(", "), F.col("toxic") + 2, F.lit("]"))
        .alias("model_output"),
    )
    return judging.pseudo_labels(ranked, outputs)


@query(
    "score_chunks",
    f"""WITH {SQL_CHUNKS}
    SELECT chunk_id, CAST(length(chunk_text) % 100 AS DOUBLE) / 100 AS llm_score FROM chunks""",
)
def score_chunks(spark, sf):
    def model(query, chunk):
        digits = F.lpad((F.length(chunk) % 100).cast("string"), 2, "0")
        return F.concat(F.lit("Relevance is 0."), digits, F.lit(" of 1"))

    chunks = document_chunks(spark, sf).withColumn("text", F.col("doc_id").cast("string"))
    return judging.score_chunks(chunks, model).select("chunk_id", "llm_score")
