"""Operators over ordered values of a key, written so that no task has to hold
all rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.operators.skew import order_blocks, running_totals
from askloom.session import land


def best_gain(
    df: DataFrame, key: str, order: list[str], price: str, *, blocks: int | None = None
) -> DataFrame:
    """``(key, best_gain)``: largest rise from a price to a later one, at least 0.

    Every block of a key is reduced to its lowest price, highest price and best
    gain; the blocks of a key, a bounded number, are then combined in order.
    """
    blocked = order_blocks(df.select(key, *order, price), [key, *order], blocks)
    so_far = (
        Window.partitionBy(key, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reduced = (
        blocked.withColumn("_gain", F.col(price) - F.min(price).over(so_far))
        .groupBy(key, "_block")
        .agg(
            F.min(price).alias("_low"), F.max(price).alias("_high"), F.max("_gain").alias("_gain")
        )
    )
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    across = F.col("_high") - F.min("_low").over(earlier)
    return (
        reduced.withColumn("_gain", F.greatest(F.col("_gain"), across))
        .groupBy(key)
        .agg(F.greatest(F.max("_gain"), F.lit(0)).alias("best_gain"))
    )


def longest_run(df: DataFrame, key: str, value: str, *, blocks: int | None = None) -> DataFrame:
    """``(key, longest_run)``: longest run of consecutive whole numbers; repeats
    do not matter."""
    distinct = land(df.select(key, value).where(F.col(value).isNotNull()).distinct(), "values")
    placed = running_totals(distinct, [key], [value], {"_place": F.lit(1)}, blocks=blocks)
    runs = placed.groupBy(key, (F.col(value) - F.col("_place")).alias("_run")).agg(
        F.count(F.lit(1)).alias("_length")
    )
    return runs.groupBy(key).agg(F.max("_length").alias("longest_run"))


def runs_with_sum(
    df: DataFrame,
    key: str,
    order: list[str],
    value: str,
    k: int,
    *,
    blocks: int | None = None,
) -> DataFrame:
    """``(key, n_runs)``: number of contiguous runs whose values add up to k.

    A run ends where the running sum is s if an earlier running sum is s - k.
    Both kinds of positions are laid in one list per (key, sum), and earlier
    ones are counted by a running total; pairs are never listed. ``value``
    should be a whole number or decimal, so that sums compare exactly. The
    running sums, which are read several times, are written to the scratch folder.
    """
    running = running_totals(
        df.select(key, *order, value),
        [key],
        order,
        {"_sum": F.col(value), "_at": F.lit(1).cast("bigint")},
        blocks=blocks,
    ).select(key, "_sum", "_at")
    summed = land(running, "running-sums")
    zero = F.lit(0).cast(summed.schema["_sum"].dataType)
    starts = summed.select(key, F.col("_sum").alias("_key_sum"), "_at", F.lit(1).alias("_adds"))
    empty = summed.select(key).distinct().select(
        key, zero.alias("_key_sum"), F.lit(0).cast("bigint").alias("_at"), F.lit(1).alias("_adds")
    )
    ends = summed.select(
        key, (F.col("_sum") - k).cast(summed.schema["_sum"].dataType).alias("_key_sum"),
        "_at", F.lit(0).alias("_adds"),
    )
    # At the same position the end comes first: a run holds at least one value.
    counted = running_totals(
        starts.unionByName(empty).unionByName(ends),
        [key, "_key_sum"],
        ["_at", "_adds"],
        {"_earlier": F.col("_adds").cast("bigint")},
        blocks=blocks,
    )
    # A null key groups like any other.
    return counted.groupBy(key).agg(
        F.sum(F.when(F.col("_adds") == 0, F.col("_earlier")).otherwise(F.lit(0))).alias("n_runs")
    )


def sorted_position(
    values: DataFrame, probes: DataFrame, column: str, *, blocks: int | None = None
) -> DataFrame:
    """For every distinct probe value: ``insert_at`` (values smaller than it) and
    the first and last place where it stands in sorted order, -1 when absent.

    Probes are laid among the values with count 0, which turns the range lookup
    into one running total over distinct values.
    """
    def laid(df: DataFrame, count: Column, asked: bool) -> DataFrame:
        return df.where(F.col(column).isNotNull()).groupBy(column).agg(
            count.alias("_n"), F.lit(asked).alias("_asked")
        )

    held = laid(values, F.count(F.lit(1)), False)
    asked = laid(probes, F.lit(0).cast("bigint"), True)
    counted = held.unionByName(asked).groupBy(column).agg(
        F.sum("_n").alias("_n"), F.max("_asked").alias("_asked")
    )
    distinct = land(counted, "counted-values")
    placed = running_totals(distinct, [], [column], {"_upto": F.col("_n")}, blocks=blocks)
    before = F.col("_upto") - F.col("_n")
    absent = F.lit(-1).cast("bigint")
    return placed.where("_asked").select(
        column,
        before.alias("insert_at"),
        F.when(F.col("_n") > 0, before).otherwise(absent).alias("first_at"),
        F.when(F.col("_n") > 0, F.col("_upto") - 1).otherwise(absent).alias("last_at"),
    )
