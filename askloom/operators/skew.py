"""Helpers for keys that may hold a large share of all rows.

``spread_join`` splits the rows of a hot key over several tasks of a join;
``running_totals`` computes running sums without putting a whole key into one
task. ``deal_by_rows`` keeps the rows of a task from growing with the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.session import broadcast_if_small, land

#: Rows of one key that a single task should handle.
ROWS_PER_TASK = 1_000_000


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(key, parts)`` for keys with more rows than one task should handle.

    Only the key column is read and counts are combined before the shuffle. The
    result holds at most ``rows / rows_per_task`` keys.
    """
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )


def deal_by_rows(
    df: DataFrame, rows: int, *keys: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Put equal keys into one task, with about ``rows_per_task`` rows a task,
    however many tasks that makes. ``rows`` is how many there are, at most.

    For joins and groupings of short rows, where what a task holds goes with its
    rows: the session's number of partitions does not follow the table, and
    adaptive execution merges partitions by compressed bytes, which puts millions
    of short rows into a task. A table for one task is left alone.
    """
    if rows <= rows_per_task:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // rows_per_task)), *keys)


def spread_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    *,
    rows_per_task: int = ROWS_PER_TASK,
    rows: int | None = None,
) -> DataFrame:
    """Join ``many`` with a table that is unique per key.

    A hot key of ``many`` is cut into parts by a hash of the whole row, which
    does not change when a task is run again; the matching row of ``one`` is
    repeated once per part. Other keys have one part. With ``rows``, at most how
    many rows ``many`` has, the number of tasks follows them.
    """
    hot = hot_keys(many.where(F.col(key).isNotNull()), key, rows_per_task)
    # Counted once; its size is measured before it is shipped.
    hot = broadcast_if_small(land(hot, "hot-keys"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    # Never null, so that no filter recomputes the hash to test it.
    place = F.coalesce(F.pmod(F.xxhash64(*many.columns), parts).cast("int"), F.lit(0))
    left = (
        many.join(hot, key, "left")
        .withColumn("_part", place)
        .drop("_parts")
    )
    if rows is not None:
        left = deal_by_rows(left, rows, key, "_part", rows_per_task=rows_per_task)
    right = (
        one.join(hot, key, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [key, "_part"], how).drop("_part")


def order_blocks(df: DataFrame, by: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add ``_block``: which of ``blocks`` about equally filled ranges a row falls
    into when all rows are sorted by ``by``, nulls first. Runs a count, and for more
    than one block stores the rows with their block.

    By default a block holds about a million rows, however many blocks that makes.
    Ranges are cut on all of ``by`` and, among rows that tie there, on the other
    columns, so neither a key nor an order value that a third of all rows share
    stays in one block. A block never changes once it is stored.
    """
    if blocks is None:
        blocks = -(-df.count() // ROWS_PER_TASK)
    if blocks <= 1:
        return df.withColumn("_block", F.lit(0))
    rest = [f.name for f in df.schema if f.name not in by and _sorts(f.dataType)]
    ranges = df.repartitionByRange(blocks, *by, *rest)
    return land(ranges.withColumn("_block", F.spark_partition_id()), "blocks")


def _sorts(kind: T.DataType) -> bool:
    """Whether Spark can order values of a type."""
    if isinstance(kind, T.ArrayType):
        return _sorts(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sorts(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    *,
    blocks: int | None = None,
) -> DataFrame:
    """Add running sums (current row included) per key in the given order.

    Sums run inside (key, block) groups; the sum of all earlier blocks, one row
    per key and block, is added afterwards. The first order column should
    differ between most rows of a key.
    """
    values = {f"_value_{name}": value for name, value in totals.items()}
    blocked = order_blocks(df.withColumns(values), [*keys, *order], blocks)
    group = [*keys, "_block"]
    local = (
        Window.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = blocked.withColumns(
        {name: F.sum(f"_value_{name}").over(local) for name in totals}
    ).drop(*values)

    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = blocked.groupBy(*group).agg(
        *[F.sum(f"_value_{name}").alias(f"_sum_{name}") for name in totals]
    )
    offsets = sums.select(
        *group,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_offset_{name}")
            for name in totals
        ],
    )
    theirs = {name: f"_of_{name}" for name in group}
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in theirs.items()]
    return (
        within.join(offsets.withColumnsRenamed(theirs), same)
        .withColumns({name: F.col(name) + F.col(f"_offset_{name}") for name in totals})
        .drop("_block", *theirs.values(), *[f"_offset_{name}" for name in totals])
    )
