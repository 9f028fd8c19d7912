"""Writers. Every write is one job, and on a file system that renames in one step a
failure leaves no part of it. Appending to an object store without a committer made
for it may leave files of a failed job, and two loads that run at one time may both
add a key; let loads into one target follow each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.chunking import dimension_bucket
from askloom.sources.dumps import path_exists
from askloom.sources.schemas import CHUNK_COLUMNS, EMBEDDING_COLUMNS


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key. Tasks keep one row per key before the
    shuffle, so a key with very many copies costs one row per task."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1).drop(
        "_first"
    )


def insert_if_absent(
    incoming: DataFrame, existing: DataFrame | None, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The rows an insert would add: the first row of every new key. Stored rows
    win over incoming ones. Key columns must not be null, as in a primary key."""
    fresh = first_per_key(incoming, key, order)
    if existing is None:
        return fresh
    return fresh.join(existing.select(*key), list(key), "left_anti")


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path, or an empty one."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append_new_rows(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_if_absent(
    incoming: DataFrame,
    path: str,
    key: Sequence[str],
    order: Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Append the new keys to the table at ``path`` and return the table."""
    spark = incoming.sparkSession
    existing = stored_table(spark, path, incoming.schema)
    append_new_rows(insert_if_absent(incoming, existing, key, order), path, partition_by)
    return stored_table(spark, path, incoming.schema)


def embedding_sink(rows: DataFrame, root: str) -> DataFrame:
    """Store embedding rows under their width class, one folder per class. A
    stored chunk id wins; inside the input the lowest chunk index wins."""
    sized = rows.select(*EMBEDDING_COLUMNS).withColumn("dim", dimension_bucket(F.size("embedding")))
    return write_if_absent(sized, root, ["dim", "chunk_id"], ["chunk_index"], ["dim"])


def chunk_sink_contract(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check a chunk table before it is stored: ``(valid, rejects)``.

    Missing columns and an embedding that is not a list fail at once, with all
    names. Rows with a missing key, number or embedding go to ``rejects`` with a
    ``reason``.
    """
    missing = sorted(set(CHUNK_COLUMNS) - set(chunks.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not isinstance(chunks.schema["embedding"].dataType, T.ArrayType):
        kind = chunks.schema["embedding"].dataType.simpleString()
        raise TypeError(f"embedding must be a list, got {kind}")
    longs = ("question_id", "answer_id")
    ints = ("chunk_index", "question_score", "answer_score")
    cast = chunks.select(
        "chunk_id",
        *[F.col(name).try_cast("bigint").alias(name) for name in longs],
        *[F.col(name).try_cast("int").alias(name) for name in ints],
        "title",
        "tags",
        "chunk_text",
        F.col("embedding").cast("array<float>").alias("embedding"),
    ).select(*CHUNK_COLUMNS)
    reason = F.when(F.col("chunk_id").isNull(), F.lit("chunk_id is missing"))
    reason = reason.when(F.col("embedding").isNull(), F.lit("embedding is missing"))
    for name in (*longs, *ints):
        reason = reason.when(F.col(name).isNull(), F.lit(f"{name} is not a whole number"))
    checked = cast.withColumn("reason", reason)
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    return valid, checked.where(F.col("reason").isNotNull())


def chunk_sink(chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Store the chunks that meet the contract and whose ``chunk_id`` is new:
    ``(stored table, rejects)``. A stored chunk wins; inside the input the lowest
    chunk index does."""
    valid, rejects = chunk_sink_contract(chunks)
    return write_if_absent(valid, path, ["chunk_id"], ["chunk_index", "question_id", "answer_id", "chunk_text"]), rejects


def csv_sink(
    df: DataFrame,
    path: str,
    *,
    sep: str = ",",
    files: int | None = None,
    null_value: str = "",
    encoding: str = "UTF-8",
) -> None:
    """CSV with a header, in at most ``files`` files where a number is given. One
    file is written by one task, so ask for it only where the rows allow that."""
    if files is not None:
        df = df.coalesce(files)
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", null_value)
        .option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
