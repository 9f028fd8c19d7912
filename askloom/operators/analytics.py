"""Grouped statistics over sales, transactions and word lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.text import letter_signature
from askloom.session import broadcast_if_small


def price_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("avg_price"),
        F.max(value).alias("max_price"),
        F.min(value).alias("min_price"),
    )


def max_by_group(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias(f"max_{value}"))


def broadcast_dim_join(fact: DataFrame, dim: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join with a dimension that is broadcast once it is measured to be small."""
    return fact.join(broadcast_if_small(dim), on, how)


def sql_left_join_rollup(sales: DataFrame, cities: DataFrame) -> DataFrame:
    """Left join and rollup as SQL text over the two tables."""
    return sales.sparkSession.sql(
        """
        SELECT s.city, c.region, count(s.price) AS count_price,
               avg(s.price) AS avg_price, max(s.price) AS max_price
        FROM {sales} s LEFT JOIN {cities} c ON s.city = c.city
        GROUP BY s.city, c.region
        """,
        sales=sales,
        cities=cities,
    )


def amount_by_user(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(F.sum("amount").alias("total_amount"))


def user_count_mean_sum(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(
        F.count("amount").alias("transaction_count"),
        F.avg("amount").alias("avg_amount"),
        F.sum("amount").alias("total_amount"),
    )


def transaction_stats(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("amount").alias("total"),
        F.avg("amount").alias("avg"),
    )


def customer_recency(tx: DataFrame) -> DataFrame:
    """Totals per user and days between the user's last transaction and the
    last one of all users."""
    newest = tx.select(F.max("date")).scalar()
    return (
        tx.groupBy("user_id")
        .agg(
            F.sum("amount").alias("total_amount"),
            F.avg("amount").alias("avg_amount"),
            F.count("amount").alias("count_transaction"),
            F.max("date").alias("last_transaction_date"),
        )
        .withColumn("days_since_last", F.datediff(newest, F.col("last_transaction_date")))
    )


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def top_k_frequent(df: DataFrame, column: str, k: int, *, arrival: str | None = None) -> DataFrame:
    """The k most frequent values; equal counts by value, or by the first place in
    the order of column ``arrival`` (``sources.arrival``), which comes along then."""
    count = F.count(F.lit(1)).alias("n")
    if arrival is None:
        return df.groupBy(column).agg(count).orderBy(F.col("n").desc(), F.col(column)).limit(k)
    counted = df.groupBy(column).agg(count, F.min(arrival).alias(arrival))
    return counted.orderBy(F.col("n").desc(), F.col(arrival)).limit(k)


def majority_candidate(df: DataFrame, column: str) -> DataFrame:
    """``value, weight``: the only value that can be held by more than half of all
    rows (none in an empty table).

    Each task keeps one value and how much it outweighs all others there (Boyer and
    Moore 1991, Agarwal et al. 2012). A value in more than half of all rows outweighs
    the other tasks' values together, so it is the heaviest: a shuffle row per task.
    """
    kind = df.schema[column].dataType
    value = F.col(column) + 0.0 if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(column)
    schema = T.StructType([T.StructField("value", kind), T.StructField("weight", T.LongType())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = pc.value_counts(batch.column(0))
            top = pc.index(counts.field("counts"), pc.max(counts.field("counts"))).as_py()
            here = 2 * counts.field("counts")[top].as_py() - batch.num_rows
            found = counts.field("values").slice(top, 1)
            if here <= 0:
                continue
            if held is None or not weight:
                held, weight = found, here
            elif repr(held[0]) == repr(found[0]):  # NaN is one value
                weight += here
            elif here > weight:
                held, weight = found, here - weight
            else:
                weight -= here
        if held is not None and weight:
            yield pa.RecordBatch.from_arrays([held, pa.array([weight], pa.int64())], names=["value", "weight"])

    return (
        df.select(value.cast(kind).alias("value")).mapInArrow(summarise, schema)
        .groupBy("value").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight")).limit(1)
    )


def majority_value(df: DataFrame, column: str) -> DataFrame:
    """The value held by more than half of all rows (floor of half), if any, null
    included. Two scans; what is shuffled is a value per task and a count."""
    total = df.select(F.count(F.lit(1))).scalar()
    candidate = F.broadcast(majority_candidate(df, column).select(F.col("value").alias("_value")))
    counted = (
        df.select(column).join(candidate, F.col(column).eqNullSafe(F.col("_value")))
        .groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.where(F.col("n") > F.floor(total / 2))


def anagram_groups(words: DataFrame, column: str) -> DataFrame:
    """``(signature, word, n)``: words with the same letters have one signature,
    and ``n`` is how often each occurs. A row per distinct word, however many share
    a signature; gather them where their number is known to be small."""
    return (
        words.groupBy(F.col(column).alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(letter_signature(F.col("word")).alias("signature"), "word", "n")
    )


def zscore(df: DataFrame, column: str) -> DataFrame:
    """Add ``zscore``: distance from the mean in population deviations over all
    rows; null when all values are equal."""
    stats = df.select(
        F.struct(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))
    ).scalar()
    return df.withColumn(
        "zscore",
        F.try_divide(F.col(column) - stats.getField("mean"), stats.getField("sd")),
    )


def axis_sums(cells: DataFrame, axis: str, value: str = "v") -> DataFrame:
    """Sums along one axis of a matrix held as cells: ``axis`` is the column
    that stays."""
    return cells.groupBy(axis).agg(F.sum(value).alias("total"))


#: Kitchen units in millilitres (fixed values).
UNIT_MILLILITRES = {"стакан": 200.0, "л": 1000.0, "мл": 1.0}


def quantity_parse(df: DataFrame, text: str, units: DataFrame) -> DataFrame:
    """Split ``<number> <unit> <ingredient>`` and convert known units.

    ``units(unit, millilitres)`` gives the factors. An unknown unit and its
    quantity stay as they are; text of another form gives nulls.
    """
    pattern = r"(?U)^\s*(\d+(?:[.,]\d+)?)\s+(\S+)\s+(.*\S)\s*$"

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(F.col(text), pattern, group), F.lit(""))

    parsed = df.withColumns(
        {
            "_quantity": F.replace(part(1), F.lit(","), F.lit(".")).try_cast("double"),
            "_unit": part(2),
            "ingredient": part(3),
        }
    )
    known = broadcast_if_small(units.select(F.col("unit").alias("_unit"), "millilitres"))
    return (
        parsed.join(known, "_unit", "left")
        .withColumns(
            {
                "quantity": F.col("_quantity") * F.coalesce("millilitres", F.lit(1.0)),
                "unit": F.when(F.col("millilitres").isNotNull(), F.lit("ml")).otherwise(
                    F.col("_unit")
                ),
            }
        )
        .drop("_quantity", "_unit", "millilitres")
    )
