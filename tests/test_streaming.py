import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from askloom.catalog.loading import streaming_insert
from askloom.catalog.requests import request_log
from askloom.streaming import monitor
from askloom.streaming.arrivals import streaming_insert_if_absent

METRICS = [
    monitor.request_counters, monitor.step_latency_histogram, monitor.total_latency_histogram,
    monitor.quality_gauges, monitor.fallbacks_by_reason, monitor.judge_means,
]


@pytest.fixture(scope="module")
def log_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events")
    request_log(spark, "/root/testdata/sf0.001").repartition(3).write.parquet(path)
    return path


def rounded(df):
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return sorted(map(repr, df.withColumns({n: F.round(n, 9) for n in doubles}).collect()))


@pytest.mark.parametrize("metric", METRICS, ids=lambda m: m.__name__)
def test_stream_equals_batch(spark, log_folder, metric):
    batch = metric(spark.read.parquet(log_folder), "6 hours")
    stream = (
        spark.readStream.schema(spark.read.parquet(log_folder).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(log_folder)
    )
    name = f"live_{metric.__name__}"
    running = (
        metric(stream, "6 hours", "40 days").writeStream.outputMode("complete")
        .format("memory").queryName(name).start()
    )
    running.processAllAvailable()
    running.stop()
    assert rounded(spark.table(name)) == rounded(batch)


def test_a_stream_needs_a_watermark(spark, log_folder):
    stream = spark.readStream.schema(spark.read.parquet(log_folder).schema).parquet(log_folder)
    with pytest.raises(ValueError):
        monitor.request_counters(stream, "1 hour")


def test_replayed_documents_add_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        streaming_insert_if_absent(
            stream, target, ["text"], ["doc_id"], str(tmp_path / checkpoint)
        ).awaitTermination()
        return spark.read.parquet(target).count()

    distinct = docs.select("text").distinct().count()
    assert run("log1") == distinct
    assert run("log2") == distinct  # everything arrives again


GAUGE_LOG = [  # minutes, event id, and the values of two gauges
    (1, 1, 5, None), (1, 2, 6, None), (31, 3, None, 0.5), (32, 4, 7, None), (95, 5, 8, 0.25), (95, 6, None, None),
]


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def gauge_rows(spark, rows):
    made = [(at(m), i, a, b) for m, i, a, b in rows]
    return spark.createDataFrame(made, "ts timestamp, event_id long, retrieved_chunks int, best_rrf double")


def test_gauges_keep_their_value(spark):
    got = monitor.carried_gauges(
        gauge_rows(spark, GAUGE_LOG), "10 minutes", gauges=("retrieved_chunks", "best_rrf")
    ).collect()
    value = {(r.gauge, r.window_start): r.value for r in got}
    want = {("retrieved_chunks", at(m)): 6.0 if m < 30 else 7.0 for m in range(0, 90, 10)}
    want |= {("best_rrf", at(m)): 0.5 for m in range(30, 90, 10)}
    want |= {("retrieved_chunks", at(90)): 8.0, ("best_rrf", at(90)): 0.25}
    assert value == want and len(got) == len(want)
    assert all(r.window_end - r.window_start == datetime.timedelta(minutes=10) for r in got)


def arrive(frame, folder):
    """One more file, newer than those before it also where times are whole seconds."""
    before = set(glob.glob(f"{folder}/*.parquet"))
    frame.coalesce(1).write.mode("append").parquet(folder)
    for path in set(glob.glob(f"{folder}/*.parquet")) - before:
        os.utime(path, (1e9 + 100 * len(before), 1e9 + 100 * len(before)))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def test_gauge_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Closed windows, also those that nothing arrives for, before and after a restart."""
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    later = [(150, 7, None, 0.125), (155, 8, 9, None), (300, 9, 1, 1.0)]
    schema = gauge_rows(spark, GAUGE_LOG).schema

    def run():
        stream = stream_of(spark, source, schema)
        monitor.carried_gauges(stream, "10 minutes", "5 minutes", ("retrieved_chunks", "best_rrf")).writeStream.format(
            "parquet"
        ).outputMode("append").option("path", target).option("checkpointLocation", log).trigger(
            availableNow=True
        ).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(
            "gauge string, window_start timestamp, window_end timestamp, value double"
        ).parquet(target).collect()))

    def batch(rows, until):
        made = monitor.carried_gauges(gauge_rows(spark, rows), "10 minutes", gauges=("retrieved_chunks", "best_rrf"))
        return sorted(tuple(r) for r in made.collect() if r.window_end <= until)

    arrive(gauge_rows(spark, GAUGE_LOG[:4]), source)
    arrive(gauge_rows(spark, GAUGE_LOG[4:]), source)
    first = run()
    assert first and first == batch(GAUGE_LOG, at(90))
    arrive(gauge_rows(spark, later), source)
    second = run()
    # The watermark stands five minutes before the newest row.
    assert second == batch(GAUGE_LOG + later, at(295)) and len(second) > len(first)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Append mode: a window is shown once, when it closes; a row after that is late."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, step string, seconds double"
    parts = [[(1, "a", 0.2), (12, "b", 4.0)], [(40, "a", 0.02), (11, "b", 2.0)], [(45, "a", 3.0)],
             [(3, "a", 9.0), (60, "a", 1.0)], [(90, "a", 1.0)]]
    for rows in parts:
        made = spark.createDataFrame([(at(m), s, x) for m, s, x in rows], schema)
        arrive(made, source)
    running = (
        monitor.step_latency_histogram(stream_of(spark, source, schema), "10 minutes", "15 minutes")
        .writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert monitor.late_rows(running) == 1
    on_time = [r for rows in parts for r in rows if r[0] != 3]
    log = spark.createDataFrame([(at(m), s, x) for m, s, x in on_time], schema)
    want = monitor.step_latency_histogram(log, "10 minutes").where(F.col("window_end") <= F.lit(at(75)))
    assert rounded(spark.read.parquet(target)) == rounded(want) and want.count() == 4


def test_steps_find_their_request(spark, tmp_path):
    requests = [("r1", 0), ("r2", 5), ("r3", 8), (None, 1)]
    steps = [("r1", 2, "a"), ("r1", 11, "b"), ("r1", 30, "late"), ("r2", 4, "before"), ("r3", 8, "a"), ("r9", 3, "x"), (None, 2, "x")]
    asked = spark.createDataFrame([(i, at(m)) for i, m in requests], "request_id string, ts timestamp")
    done = spark.createDataFrame([(i, at(m), s) for i, m, s in steps], "request_id string, ts timestamp, step string")
    batch = monitor.request_steps(asked, done, "20 minutes")
    assert sorted((r.request_id, r.step, r.seconds) for r in batch.collect()) == [
        ("r1", "a", 120.0), ("r1", "b", 660.0), ("r3", "a", 0.0)
    ]
    folders = [str(tmp_path / n) for n in ("requests", "steps")]
    streams = []
    for frame, folder in zip((asked, done), folders):
        frame.repartition(2).write.parquet(folder)
        streams.append(stream_of(spark, folder, frame.schema))
    with pytest.raises(ValueError):
        monitor.request_steps(*streams, "20 minutes")
    joined = monitor.request_steps(*streams, "20 minutes", "1 hour")
    running = joined.writeStream.format("memory").queryName("joined_steps").outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    assert rounded(spark.table("joined_steps")) == rounded(batch)


def test_repeats_inside_and_beyond_the_watermark(spark, tmp_path):
    """Inside the watermark a repeat is dropped by the stream's state, beyond it by the
    stored keys: either way the first stays."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string, ts timestamp"
    for rows in ([(1, "x", 0), (2, "x", 5), (3, "y", 6)], [(4, "x", 8), (5, "z", 300)], [(6, "y", 305), (7, "z", 306), (8, "x", 310)]):
        made = spark.createDataFrame([(i, t, at(m)) for i, t, m in rows], schema)
        arrive(made, source)
    running = streaming_insert_if_absent(
        stream_of(spark, source, schema), target, ["text"], ["doc_id"], str(tmp_path / "log"),
        event_time="ts", watermark="10 minutes",
    )
    running.awaitTermination()
    got = sorted((r.text, r.doc_id) for r in spark.read.parquet(target).collect())
    assert got == [("x", 1), ("y", 3), ("z", 5)]
    dropped = sum(
        op["customMetrics"].get("numDroppedDuplicateRows", 0)
        for p in running.recentProgress for op in p["stateOperators"]
    )
    assert dropped >= 3  # two repeats of x and one of z; y and the last x come again beyond it


@pytest.mark.parametrize("files", [0, 1, 3])
def test_streamed_table_may_be_a_folder(spark, tmp_path, files):
    rows = [(2, "x"), (1, "x"), (3, "y")] if files else []
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(files or 1)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in streaming_insert(spark, str(tmp_path)).collect()]
    assert sorted(got) == ([1, 3] if files else [])
