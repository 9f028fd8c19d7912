import datetime as dt
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.catalog import tables
from askloom.operators import analytics, assemble, sequences, skew
from askloom.sources.arrival import read_in_order
from askloom.sources.batches import in_batches
from askloom.sources.sinks import insert_if_absent


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_tags(spark):
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None)], "Id long, Tag string")
    assert rows(assemble.tags_string_agg(tags), "question_id", "tags") == [(1, "a, b, b"), (2, None)]


def in_tasks(df):
    """Rows of each task that has any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_tasks_follow_the_rows_of_tags(spark, tmp_path):
    """Session partitions are 4, and so few bytes would be merged into one task."""
    lines = [(i % 300 or None, 1 if i % 2 else i % 41) for i in range(2000)] + [(7, None)]
    parts = [(k, f"b{k % 5}" if k else None) for k in range(40)] + [(3, "b9")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    tags = tables.tags(spark, str(tmp_path), rows_per_task=100)
    want = {(o, b) for o, p in lines for k, b in parts if p is not None and p == k}
    assert Counter((r["Id"], r["Tag"]) for r in tags.collect()) == Counter(want)
    assert max(in_tasks(tags)) < len(want) / 5
    listed = assemble.tags_string_agg(tags, rows_per_task=100, rows=tables.most_tags(spark, str(tmp_path)))
    lists = {o: sorted(b for x, b in want if x == o and b) for o, _ in want}
    assert {r["question_id"]: r["tags"] for r in listed.collect()} == {o: ", ".join(bs) or None for o, bs in lists.items()}
    assert max(in_tasks(listed)) < len(lists) / 5


def test_tasks_follow_repeated_tags(spark):
    tags = spark.createDataFrame([(i % 90, "ab"[i % 2]) for i in range(900)], "Id long, Tag string")
    listed = assemble.tags_string_agg(tags, rows_per_task=45)
    assert rows(listed, "question_id", "tags") == [(i, ", ".join("ab"[i % 2] * 10)) for i in range(90)]
    assert max(in_tasks(listed)) < 30


def test_tasks_follow_the_answers(spark):
    questions = spark.createDataFrame([(i, f"t{i}", "b", i) for i in range(200)], "Id long, Title string, Body string, Score int")
    answers = spark.createDataFrame([(i, i % 210, "a", 1) for i in range(2100)], "Id long, ParentId long, Body string, Score int")
    tags = spark.createDataFrame([(i, "x") for i in range(100)], "Id long, Tag string")
    qa = assemble.qa_assemble(questions, answers, tags, rows_per_task=100)
    assert rows(qa.fillna("-"), "answer_id", "tags") == [(i, "x" if i % 210 < 100 else "-") for i in range(2100) if i % 210 < 200]
    assert max(in_tasks(qa)) < 400


def test_a_table_for_one_task_is_left_alone(spark):
    few = spark.range(10)
    assert skew.deal_by_rows(few, 10, "id", rows_per_task=10) is few
    assert skew.deal_by_rows(few, 95, "id", rows_per_task=10).rdd.getNumPartitions() == 10


QA = "question_id long, answer_id long, answer_score int"


def test_best_answers(spark):
    qa = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 3), (2, 4, None), (2, 5, None)], QA)
    assert rows(assemble.best_answer_ties(qa), "answer_id") == [(1,), (2,)]
    assert rows(assemble.best_answer_one(qa), "answer_id") == [(1,), (4,)]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 10])
def test_assembly_with_a_hot_question(spark, rows_per_task):
    questions = spark.createDataFrame([(i, f"t{i}", "b", i) for i in range(5)], "Id long, Title string, Body string, Score int")
    answers = spark.createDataFrame(
        [(i, 0 if i < 100 else i % 7, "a", i % 3) for i in range(160)], "Id long, ParentId long, Body string, Score int"
    )
    tags = spark.createDataFrame([(0, "y"), (0, "x")], "Id long, Tag string")
    qa = assemble.qa_assemble(questions, answers, tags, rows_per_task=rows_per_task)
    want = sorted((0 if i < 100 else i % 7, i) for i in range(160) if (0 if i < 100 else i % 7) < 5)
    assert rows(qa, "question_id", "answer_id") == want
    assert {r["tags"] for r in qa.where("question_id = 0").collect()} == {"x, y"}
    best = assemble.best_answer_ties(qa, rows_per_task=rows_per_task)
    assert best.where("question_id = 0").count() == sum(1 for i in range(160) if i % 3 == 2 and (i < 100 or i % 7 == 0))


def test_hot_key_is_cut_into_parts(spark):
    many = spark.range(100).select(F.lit(1).alias("k"), "id")
    assert rows(skew.hot_keys(many, "k", 10), "k", "_parts") == [(1, 10)]


@pytest.mark.parametrize("blocks", [1, 5])
def test_running_totals(spark, blocks):
    rnd = random.Random(1)
    data = [(rnd.choice("aab"), i, rnd.randint(-3, 3)) for i in rnd.sample(range(1000), 80)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    got = rows(skew.running_totals(df, ["k"], ["o"], {"s": F.col("v")}, blocks=blocks), "k", "o", "s")
    want, sums = [], Counter()
    for k, o, v in sorted(data, key=lambda r: r[1]):
        sums[k] += v
        want.append((k, o, sums[k]))
    assert got == sorted(want)


def test_blocks_keep_the_order_of_a_window(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in [5.0, None, 1.0, nan, 3.0, -inf, inf, 2.0]], "o double")
    got = skew.order_blocks(df, ["o"], 4).orderBy("o").collect()
    blocks = [r["_block"] for r in got]
    assert blocks == sorted(blocks) and len(set(blocks)) > 1


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_blocks_of_times(spark, kind):
    df = spark.range(40).select(
        (F.lit("2024-03-31 00:10:00.25").cast(kind) + F.make_dt_interval(F.col("id").cast("int"))).cast(kind).alias("o")
    )
    blocks = [r["_block"] for r in skew.order_blocks(df, ["o"], 4).orderBy("o").collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) == 4


def test_blocks_follow_the_table_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 25)
    blocked = skew.order_blocks(spark.range(100).withColumnRenamed("id", "o"), ["o"])
    sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 40


def test_blocks_cut_ties(spark):
    """One key, one first order value: the whole tuple cuts, then the other columns."""
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(7).alias("o"), F.col("id").alias("p"), F.lit(0).alias("v"))
    for by in (["k", "o", "p"], ["k", "o"]):
        sizes = [r["count"] for r in skew.order_blocks(df, by, 8).groupBy("_block").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1200


@pytest.mark.parametrize("blocks", [1, 4])
def test_null_keys_and_tied_orders(spark, blocks):
    data = [(None, i // 3, i, i % 4) for i in range(30)] + [("a", 0, i, 1) for i in range(10)]
    df = spark.createDataFrame(data, "k string, o long, p long, v long")
    gains = rows(sequences.best_gain(df, "k", ["o", "p"], "v", blocks=blocks).fillna("-"), "k", "best_gain")
    assert gains == [("-", 3), ("a", 0)]
    runs = rows(sequences.longest_run(df, "k", "p", blocks=blocks).fillna("-"), "k", "longest_run")
    assert runs == [("-", 30), ("a", 10)]
    sums = rows(sequences.runs_with_sum(df, "k", ["o", "p"], "v", 3, blocks=blocks).fillna("-"), "k", "n_runs")
    values = [i % 4 for i in range(30)]
    want = sum(sum(values[i:j]) == 3 for i in range(30) for j in range(i + 1, 31))
    assert sums == [("-", want), ("a", 8)]


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("prices, gain", [([7, 1, 5, 3, 6, 4], 5), ([7, 6, 4, 3, 1], 0), ([2], 0), ([9, 1, 8, 0, 3], 7)])
def test_best_gain(spark, prices, gain, blocks):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "k int, o int, p int")
    assert rows(sequences.best_gain(df, "k", ["o"], "p", blocks=blocks), "best_gain") == [(gain,)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_longest_run(spark, blocks):
    data = [("a", v) for v in (100, 4, 200, 1, 3, 2, 2)] + [("b", 5)]
    df = spark.createDataFrame(data, "k string, v long")
    assert rows(sequences.longest_run(df, "k", "v", blocks=blocks), "k", "longest_run") == [("a", 4), ("b", 1)]


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("values, k, n", [([1, 1, 1], 2, 2), ([1, 2, 3], 3, 2), ([1, -1, 0], 0, 3)])
def test_runs_with_sum(spark, values, k, n, blocks):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, o int, v long")
    assert rows(sequences.runs_with_sum(df, "k", ["o"], "v", k, blocks=blocks), "n_runs") == [(n,)]


def test_runs_with_sum_against_counting(spark):
    rnd = random.Random(2)
    data = [("a" if rnd.random() < 0.7 else "b", i, rnd.randint(-2, 2)) for i in range(120)]
    df = spark.createDataFrame(data, "k string, o int, v long")
    want = []
    for key in "ab":
        vs = [v for k, _, v in data if k == key]
        want.append((key, sum(sum(vs[i:j]) == 1 for i in range(len(vs)) for j in range(i + 1, len(vs) + 1))))
    assert rows(sequences.runs_with_sum(df, "k", ["o"], "v", 1, blocks=4), "k", "n_runs") == want


def test_sorted_position(spark):
    at = sequences.sorted_position
    got = rows(at(numbers(spark, [1, 3, 5, 6]), numbers(spark, [5, 2, 7, 0]), "x", blocks=2), "x", "insert_at")
    assert got == [(0, 0), (2, 1), (5, 2), (7, 4)]
    got = rows(at(numbers(spark, [5, 7, 7, 8, 8, 10]), numbers(spark, [8, 6]), "x", blocks=2), "x", "first_at", "last_at")
    assert got == [(6, -1, -1), (8, 3, 4)]
    assert rows(at(numbers(spark, []), numbers(spark, [8]), "x"), "first_at", "last_at") == [(-1, -1)]


def test_value_counts(spark):
    assert rows(analytics.duplicate_values(numbers(spark, [1, 2, 3, 1]), "x"), "x", "n") == [(1, 2)]
    assert analytics.duplicate_values(numbers(spark, [1, 2, 3, 4]), "x").count() == 0
    assert rows(analytics.top_k_frequent(numbers(spark, [1, 1, 1, 2, 2, 3]), "x", 2), "x") == [(1,), (2,)]
    assert rows(analytics.majority_value(numbers(spark, [2, 2, 1, 1, 1, 2, 2]), "x"), "x") == [(2,)]
    assert analytics.majority_value(numbers(spark, [1, 2]), "x").count() == 0


def test_anagram_groups(spark):
    words = spark.createDataFrame([(w,) for w in "eat tea tan ate nat bat eat".split()], "w string")
    assert rows(analytics.anagram_groups(words, "w"), "signature", "word", "n") == [
        ("abt", "bat", 1), ("aet", "ate", 1), ("aet", "eat", 2), ("aet", "tea", 1), ("ant", "nat", 1), ("ant", "tan", 1),
    ]


def test_transactions(spark):
    tx = spark.createDataFrame([(1, 100), (2, 50), (1, 200), (3, 70), (2, 30)], "user_id int, amount long")
    assert rows(analytics.transaction_stats(tx), "user_id", "count", "total", "avg") == [
        (1, 2, 300, 150.0), (2, 2, 80, 40.0), (3, 1, 70, 70.0),
    ]
    assert rows(analytics.amount_by_user(tx), "user_id", "total_amount") == [(1, 300), (2, 80), (3, 70)]
    assert rows(analytics.user_count_mean_sum(tx), "transaction_count", "total_amount")[-1] == (2, 300)


def test_recency(spark):
    day = lambda d: dt.date(2025, 1, d)
    tx = spark.createDataFrame(
        [(1, 100, day(1)), (1, 200, day(3)), (2, 50, day(1)), (2, 70, day(5)), (2, 80, day(10))],
        "user_id int, amount long, date date",
    )
    assert rows(analytics.customer_recency(tx), "user_id", "days_since_last") == [(1, 7), (2, 0)]


def test_zscore(spark):
    got = [z for (z,) in rows(analytics.zscore(numbers(spark, [1, 2, 3, 4, 5, 6]), "x"), "zscore")]
    assert got[0] == pytest.approx(-1.4638501) and sum(got) == pytest.approx(0)


def test_zscore_of_equal_values(spark):
    assert [r["zscore"] for r in analytics.zscore(numbers(spark, [2, 2]), "x").collect()] == [None, None]


def test_axis_sums(spark):
    cells = spark.createDataFrame([(r, c, v) for r, row in enumerate([[1, 2, 3], [4, 5, 6]]) for c, v in enumerate(row)], "r int, c int, v int")
    assert rows(analytics.axis_sums(cells, "r"), "total") == [(6,), (15,)]
    assert rows(analytics.axis_sums(cells, "c"), "total") == [(5,), (7,), (9,)]


def test_sales(spark):
    sales = spark.createDataFrame([("M", 10.0), ("M", 30.0), ("K", 5.0)], "city string, price double")
    cities = spark.createDataFrame([("M", "Center")], "city string, region string")
    assert rows(analytics.price_stats(sales, "city", "price"), "city", "count", "avg_price", "max_price", "min_price") == [
        ("K", 1, 5.0, 5.0, 5.0), ("M", 2, 20.0, 30.0, 10.0),
    ]
    joined = analytics.broadcast_dim_join(analytics.max_by_group(sales, "city", "price"), cities, "city")
    assert {(r["city"], r["max_price"], r["region"]) for r in joined.collect()} == {("K", 5.0, None), ("M", 30.0, "Center")}
    rolled = analytics.sql_left_join_rollup(sales, cities)
    assert {(r["city"], r["region"], r["count_price"]) for r in rolled.collect()} == {("K", None, 1), ("M", "Center", 2)}


def test_quantities(spark):
    lines = spark.createDataFrame([(1, "1 стакан молока"), (2, "2,5 л воды из крана"), (3, "3 шт яиц"), (4, "соль")], "id int, line string")
    units = spark.createDataFrame(list(analytics.UNIT_MILLILITRES.items()), "unit string, millilitres double")
    got = rows(analytics.quantity_parse(lines, "line", units), "id", "quantity", "unit", "ingredient")
    assert got == [(1, 200.0, "ml", "молока"), (2, 2500.0, "ml", "воды из крана"), (3, 3.0, "шт", "яиц"), (4, None, None, None)]


@pytest.mark.parametrize("values", [
    [], [1], [None, None, 1], [None, 2], [1, 1, 2, 2], [3, 3, 3, 1, 2], [5] * 30 + list(range(29)), [5] * 30 + list(range(30)),
])
@pytest.mark.parametrize("parts", [1, 5])
def test_majority_by_task_summaries(spark, values, parts):
    counts = Counter(values)
    want = [(v, n) for v, n in counts.items() if n > len(values) // 2]
    made = analytics.majority_value(numbers(spark, values).repartition(parts), "x")
    assert [tuple(r) for r in made.collect()] == want


def test_majority_of_doubles(spark):
    nan = float("nan")
    frame = spark.createDataFrame([(nan,), (nan,), (1.0,), (nan,), (0.0,)], "x double").repartition(3)
    assert str(analytics.majority_value(frame, "x").collect()[0]["x"]) == "nan"
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double").coalesce(1)
    assert [tuple(r) for r in analytics.majority_value(zeros, "x").collect()] == [(0.0, 2)]


def test_majority_shuffles_no_distinct_values(spark):
    """What is shuffled is a row per task, however many values there are."""
    frame = spark.range(20_000).selectExpr("id % 9999 AS x").repartition(6)
    made = analytics.majority_candidate(frame, "x")
    assert made.count() <= 1
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("MapInArrow")  # values are grouped after the summaries only


def test_first_in_input_order(spark, tmp_path):
    path, later = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("y", 1), ("x", 2), ("z", 3), ("x", 4), ("y", 5)], "k string, v int").coalesce(1).write.parquet(path)
    spark.createDataFrame([("w", 6), ("z", 7), ("w", 8)], "k string, v int").coalesce(1).write.parquet(later)
    both = read_in_order(spark, path, later)
    assert [r["v"] for r in both.repartition(4).orderBy("arrival").collect()] == [1, 2, 3, 4, 5, 6, 7, 8]
    top = analytics.top_k_frequent(both, "k", 3, arrival="arrival").collect()
    assert [(r["k"], r["n"]) for r in top] == [("y", 2), ("x", 2), ("z", 2)]
    kept = insert_if_absent(both, both.where("k = 'w'"), ["k"], ["arrival"])
    assert sorted((r["k"], r["v"]) for r in kept.collect()) == [("x", 2), ("y", 1), ("z", 3)]
    with pytest.raises(ValueError):
        read_in_order(spark)


def test_plugins_with_batches_of_their_own(spark):
    """Two readers of one session see batches of their own size, and no row is lost."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([batch.num_rows] * batch.num_rows)], names=["id", "rows"])

    frame = spark.range(0, 2500, numPartitions=2)
    small, large = (frame.mapInArrow(in_batches(sizes, n), "id long, rows long") for n in (100, 400))
    both = small.join(large.withColumnRenamed("rows", "more"), "id")
    got = both.groupBy("rows", "more").count().collect()
    assert {r["rows"] for r in got} == {100, 50} and {r["more"] for r in got} == {400, 50}
    assert sum(r["count"] for r in got) == 2500
    wide = spark.range(0, 25_000, numPartitions=1).mapInArrow(in_batches(sizes, 15_000), "id long, rows long")
    assert {r["rows"] for r in wide.select("rows").distinct().collect()} == {15_000, 10_000}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with pytest.raises(ValueError):
        in_batches(sizes, 0)
