"""Grouped statistics and sequence operators over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog.registry import query
from askloom.catalog.tables import table
from askloom.operators import analytics, sequences
from askloom.sources.arrival import read_in_order
from askloom.sources.sinks import insert_if_absent


def _sales(spark, sf):
    """Order prices by the customer's nation as the city; cents keep sums exact."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    return (
        table(spark, sf, "orders")
        .select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
        .join(customer, "o_custkey")
        .join(nation, "n_nationkey")
        .select("city", "price")
    )


def _cities(spark, sf):
    """Cities with regions; those of the first region go by another name."""
    region = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")
    )
    return (
        table(spark, sf, "nation")
        .join(region, "n_regionkey")
        .select(
            F.when(F.col("n_regionkey") > 0, F.col("n_name"))
            .otherwise(F.concat(F.lit("old "), "n_name"))
            .alias("city"),
            "region",
        )
    )


_SQL_SALES = """
sales AS (
  SELECT n_name AS city, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
cities AS (
  SELECT CASE WHEN n_regionkey > 0 THEN n_name ELSE 'old ' || n_name END AS city,
         r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey)"""

_SQL_AVG_PRICE = "round(CAST(sum(price) AS DOUBLE) / count(price), 6) AS avg_price"


def _prices(df):
    """Prices as doubles and averages rounded, for comparison."""
    for name in ("max_price", "min_price"):
        if name in df.columns:
            df = df.withColumn(name, F.col(name).cast("double"))
    if "avg_price" in df.columns:
        df = df.withColumn("avg_price", F.round(F.col("avg_price").cast("double"), 6))
    return df


@query(
    "price_stats_by_city",
    f"""WITH {_SQL_SALES}
    SELECT city, count(price) AS count, {_SQL_AVG_PRICE},
           CAST(max(price) AS DOUBLE) AS max_price, CAST(min(price) AS DOUBLE) AS min_price
    FROM sales GROUP BY city""",
)
def price_stats(spark, sf):
    return _prices(analytics.price_stats(_sales(spark, sf), "city", "price"))


@query(
    "max_by_group",
    f"""WITH {_SQL_SALES}
    SELECT city, CAST(max(price) AS DOUBLE) AS max_price FROM sales GROUP BY city""",
)
def max_by_group(spark, sf):
    return _prices(analytics.max_by_group(_sales(spark, sf), "city", "price"))


@query(
    "broadcast_dim_join",
    f"""WITH {_SQL_SALES}, m AS (
      SELECT city, CAST(max(price) AS DOUBLE) AS max_price FROM sales GROUP BY city)
    SELECT city, max_price, region FROM m LEFT JOIN cities USING (city)""",
)
def broadcast_dim_join(spark, sf):
    dearest = _prices(analytics.max_by_group(_sales(spark, sf), "city", "price"))
    return analytics.broadcast_dim_join(dearest, _cities(spark, sf), "city")


@query(
    "sql_left_join_rollup",
    f"""WITH {_SQL_SALES}
    SELECT s.city, c.region, count(s.price) AS count_price, {_SQL_AVG_PRICE},
           CAST(max(s.price) AS DOUBLE) AS max_price
    FROM sales s LEFT JOIN cities c ON s.city = c.city GROUP BY s.city, c.region""",
)
def sql_left_join_rollup(spark, sf):
    return _prices(analytics.sql_left_join_rollup(_sales(spark, sf), _cities(spark, sf)))


@query(
    "conjunctive_filter",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 200000""",
)
def conjunctive_filter(spark, sf):
    return (
        table(spark, sf, "orders")
        .where(F.col("o_orderstatus") == "F")
        .where(F.col("o_totalprice") > 200000)
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "temp_views",
    """SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey
    GROUP BY n_name""",
)
def temp_views(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("askloom_supplier")
    table(spark, sf, "nation").createOrReplaceTempView("askloom_nation")
    return spark.sql(
        "SELECT n_name, count(*) AS suppliers FROM askloom_supplier "
        "JOIN askloom_nation ON n_nationkey = s_nationkey GROUP BY n_name"
    )


def _transactions(spark, sf):
    """Orders as transactions; cents keep sums exact."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


_SQL_TX = """
tx AS (
  SELECT o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CAST(o_orderdate AS DATE) AS date FROM orders)"""
_SQL_AVG = "round(CAST(sum(amount) AS DOUBLE) / count(amount), 6)"


def _amounts(df):
    """Sums as doubles and averages rounded, for comparison."""
    for name in ("total_amount", "total"):
        if name in df.columns:
            df = df.withColumn(name, F.col(name).cast("double"))
    for name in ("avg_amount", "avg"):
        if name in df.columns:
            df = df.withColumn(name, F.round(F.col(name).cast("double"), 6))
    return df


@query(
    "amount_by_user",
    f"""WITH {_SQL_TX}
    SELECT user_id, CAST(sum(amount) AS DOUBLE) AS total_amount FROM tx GROUP BY user_id""",
)
def amount_by_user(spark, sf):
    return _amounts(analytics.amount_by_user(_transactions(spark, sf)))


@query(
    "user_count_mean_sum",
    f"""WITH {_SQL_TX}
    SELECT user_id, count(amount) AS transaction_count, {_SQL_AVG} AS avg_amount,
           CAST(sum(amount) AS DOUBLE) AS total_amount FROM tx GROUP BY user_id""",
)
def user_count_mean_sum(spark, sf):
    return _amounts(analytics.user_count_mean_sum(_transactions(spark, sf)))


@query(
    "transaction_stats",
    f"""WITH {_SQL_TX}
    SELECT user_id, count(*) AS count, CAST(sum(amount) AS DOUBLE) AS total, {_SQL_AVG} AS avg
    FROM tx GROUP BY user_id""",
)
def transaction_stats(spark, sf):
    return _amounts(analytics.transaction_stats(_transactions(spark, sf)))


@query(
    "customer_recency",
    f"""WITH {_SQL_TX}
    SELECT user_id, CAST(sum(amount) AS DOUBLE) AS total_amount, {_SQL_AVG} AS avg_amount,
           count(amount) AS count_transaction,
           strftime(max(date), '%Y-%m-%d') AS last_transaction_date,
           CAST((SELECT max(date) FROM tx) - max(date) AS INTEGER) AS days_since_last
    FROM tx GROUP BY user_id""",
)
def customer_recency(spark, sf):
    return _amounts(analytics.customer_recency(_transactions(spark, sf))).withColumn(
        "last_transaction_date", F.col("last_transaction_date").cast("string")
    )


@query(
    "duplicate_values",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1",
)
def duplicate_values(spark, sf):
    return analytics.duplicate_values(table(spark, sf, "lineitem"), "l_partkey")


@query(
    "top_k_frequent",
    """SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey
    ORDER BY n DESC, l_partkey LIMIT 10""",
)
def top_k_frequent(spark, sf):
    return analytics.top_k_frequent(table(spark, sf, "lineitem"), "l_partkey", 10)


@query(
    "top_k_first_seen",
    """SELECT o_custkey, count(*) AS n, min(place) AS first_row
    FROM (SELECT o_custkey, row_number() OVER () - 1 AS place FROM orders) GROUP BY o_custkey
    ORDER BY n DESC, first_row LIMIT 10""",
)
def top_k_first_seen(spark, sf):
    """Equal counts by the first row in the file."""
    rows = read_in_order(spark, f"{sf}/orders.parquet")
    top = analytics.top_k_frequent(rows, "o_custkey", 10, arrival="arrival")
    return top.select("o_custkey", "n", F.col("arrival.row").alias("first_row"))


@query(
    "insert_first_seen",
    """SELECT o_custkey, o_orderkey FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place) AS first FROM (
        SELECT o_custkey, o_orderkey, row_number() OVER () AS place FROM orders)) WHERE first = 1""",
)
def insert_first_seen(spark, sf):
    """Of several rows with a key, the one that stands first in the file is inserted."""
    rows = read_in_order(spark, f"{sf}/orders.parquet").select("arrival", "o_custkey", "o_orderkey")
    made = insert_if_absent(rows, rows.where("false"), ["o_custkey"], ["arrival"])
    return made.select("o_custkey", "o_orderkey")


@query(
    "majority_value",
    """SELECT role, count(*) AS n FROM conversations GROUP BY role
    HAVING count(*) > (SELECT count(*) // 2 FROM conversations)""",
)
def majority_value(spark, sf):
    return analytics.majority_value(table(spark, sf, "conversations"), "role")


@query(
    "zscore",
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
         / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS zscore FROM orders""",
)
def zscore(spark, sf):
    scored = analytics.zscore(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"
    )
    return scored.select("o_orderkey", F.round("zscore", 6).alias("zscore"))


@query(
    "axis_sums",
    """WITH cells AS (
      SELECT o_orderstatus AS r, o_orderpriority AS c,
             CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
    SELECT 'row' AS axis, r AS line, CAST(sum(v) AS DOUBLE) AS total FROM cells GROUP BY r
    UNION ALL
    SELECT 'column' AS axis, c AS line, CAST(sum(v) AS DOUBLE) AS total FROM cells GROUP BY c""",
)
def axis_sums(spark, sf):
    cells = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("r"),
        F.col("o_orderpriority").alias("c"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("v"),
    )
    parts = [
        analytics.axis_sums(cells, side).select(
            F.lit(axis).alias("axis"), F.col(side).alias("line"),
            F.col("total").cast("double").alias("total"),
        )
        for axis, side in (("row", "r"), ("column", "c"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "best_gain",
    """WITH low AS (
      SELECT nullif(user_id, 1) AS user_id, value, min(value) OVER (
        PARTITION BY nullif(user_id, 1) ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM events)
    SELECT user_id, round(max(value - m), 2) AS best_gain FROM low GROUP BY user_id""",
)
def best_gain(spark, sf):
    events = table(spark, sf, "events").withColumn("user_id", F.nullif("user_id", F.lit(1)))
    gained = sequences.best_gain(events, "user_id", ["ts", "event_id"], "value")
    return gained.select("user_id", F.round("best_gain", 2).alias("best_gain"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _numbered_events(spark, sf):
    """Events with a whole number each; one user has no id."""
    return table(spark, sf, "events").select(
        F.nullif("user_id", F.lit(1)).alias("user_id"), "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


@query(
    "longest_run",
    f"""WITH v AS (SELECT DISTINCT nullif(user_id, 1) AS user_id, {_K} AS k FROM events),
    runs AS (
      SELECT user_id, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS run FROM v),
    lengths AS (SELECT user_id, run, count(*) AS n FROM runs GROUP BY ALL)
    SELECT user_id, max(n) AS longest_run FROM lengths GROUP BY user_id""",
)
def longest_run(spark, sf):
    return sequences.longest_run(_numbered_events(spark, sf), "user_id", "k")


@query(
    "runs_with_sum",
    f"""WITH v AS (
      SELECT nullif(user_id, 1) AS user_id, event_id, {_K} % 7 - 3 AS k FROM events),
    sums AS (
      SELECT user_id, row_number() OVER w AS at, CAST(sum(k) OVER w AS BIGINT) AS s FROM v
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    starts AS (SELECT * FROM sums UNION ALL SELECT DISTINCT user_id, 0, 0 FROM sums)
    SELECT e.user_id, count(b.at) AS n_runs
    FROM sums e LEFT JOIN starts b ON b.user_id IS NOT DISTINCT FROM e.user_id AND b.at < e.at AND b.s = e.s - 2
    GROUP BY e.user_id""",
)
def runs_with_sum(spark, sf):
    steps = _numbered_events(spark, sf).withColumn("step", F.col("k") % 7 - 3)
    return sequences.runs_with_sum(steps, "user_id", ["event_id"], "step", 2)


@query(
    "sorted_position",
    """WITH probes AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part),
    counted AS (
      SELECT x, count(*) FILTER (l_quantity < x) AS below, count(*) FILTER (l_quantity = x) AS same
      FROM probes, lineitem GROUP BY x)
    SELECT x, below AS insert_at, CASE WHEN same > 0 THEN below ELSE -1 END AS first_at,
           CASE WHEN same > 0 THEN below + same - 1 ELSE -1 END AS last_at FROM counted""",
)
def sorted_position(spark, sf):
    values = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"))
    probes = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"))
    return sequences.sorted_position(values, probes, "x")
