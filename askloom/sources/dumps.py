"""CSV dumps to typed staging tables, and the other table sources."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.sources.batches import Plugin, in_batches
from askloom.sources.records import can_split, read_csv_records
from askloom.sources.schemas import (
    ANSWER_COLUMNS,
    QUESTION_COLUMNS,
    TAG_COLUMNS,
    text_schema,
)


#: A multi-line file up to this size is read by one task; a larger one in splits.
ONE_TASK_BYTES = 64 << 20


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A glob is present if it matches anything.
    found = files.globStatus(target)
    return found is not None and len(found) > 0


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file that a path, folder or glob names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    most, left = 0, [status.getPath() for status in files.globStatus(target) or ()]
    while left:
        for status in files.listStatus(left.pop()):
            if status.isDirectory():
                left.append(status.getPath())
            else:
                most = max(most, status.getLen())
    return most


def required_inputs(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Fail with a list of all inputs that are missing."""
    missing = [f"{name}: {path}" for name, path in paths.items() if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing inputs:\n" + "\n".join(missing))


def read_dump(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...],
    *,
    encoding: str = "ISO-8859-1",
    drop_columns: Collection[str] = (),
    limit: int | None = None,
    null_value: str = "NA",
    multi_line: bool = True,
    one_task_bytes: int = ONE_TASK_BYTES,
) -> DataFrame:
    """Text columns of a CSV dump with a header; fields may hold line breaks.

    Small multi-line files are read by one task each. If one is larger than
    ``one_task_bytes``, all are read in splits (``records.read_csv_records``), which
    reads the text again instead of storing it; encodings that can't be split stay with one task.
    Turn ``multi_line`` off for dumps without line breaks: those are split anyhow.
    """
    required_inputs(spark, {"dump": path})
    left = [name for name in columns if name not in set(drop_columns)]
    if not left:
        raise ValueError("no columns are left")
    if multi_line and can_split(encoding) and largest_file(spark, path) > one_task_bytes:
        dump = read_csv_records(spark, path, columns, encoding=encoding, null_value=null_value).select(*left)
        return dump if limit is None else dump.limit(limit)
    reader = (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_value)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )
    dump = reader.csv(path).select(*left)
    return dump if limit is None else dump.limit(limit)


def read_questions(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_dump(spark, path, QUESTION_COLUMNS, **options)


def read_answers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_dump(spark, path, ANSWER_COLUMNS, **options)


def read_tags(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Tags may be spelled ``NA`` or ``null``; only an empty field is missing."""
    return read_dump(spark, path, TAG_COLUMNS, null_value="", **options)


def nullable_int_cast(value: Column) -> Column:
    """``26.0`` to 26; NaN, blanks and text to null."""
    number = value.try_cast("double")
    # Directly where possible: a double does not hold every long id.
    return F.coalesce(
        value.try_cast("bigint"), F.when(~F.isnan(number), number).try_cast("bigint")
    )


def _required_int(name: str, kind: str = "bigint") -> Column:
    value = nullable_int_cast(F.col(name))
    refusal = F.raise_error(
        F.concat(F.lit(f"{name} is not a whole number: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    )
    return F.when(value.isNotNull(), value.cast(kind)).otherwise(refusal.cast(kind)).alias(name)


def stage_questions(dump: DataFrame) -> DataFrame:
    return dump.select(
        _required_int("Id"),
        nullable_int_cast(F.col("OwnerUserId")).alias("OwnerUserId"),
        F.col("CreationDate").cast("string").alias("CreationDate"),
        F.col("ClosedDate").cast("string").alias("ClosedDate"),
        _required_int("Score", "int"),
        "Title",
        "Body",
    )


def stage_answers(dump: DataFrame) -> DataFrame:
    return dump.select(
        _required_int("Id"),
        nullable_int_cast(F.col("OwnerUserId")).alias("OwnerUserId"),
        F.col("CreationDate").cast("string").alias("CreationDate"),
        _required_int("ParentId"),
        _required_int("Score", "int"),
        "Body",
    )


def stage_tags(dump: DataFrame) -> DataFrame:
    return dump.select(_required_int("Id"), "Tag")


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; names that are not there are ignored."""
    return df.withColumnsRenamed(dict(names))


def read_documents(
    spark: SparkSession,
    path: str,
    batch_rows: int | None = None,
    work: Plugin | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Stored documents; with ``work``, what this plug-in makes of them (columns of
    ``schema``), fed with batches of ``batch_rows`` rows. The size holds for this plug-in
    alone; the session's setting is left as it is."""
    if batch_rows is not None and batch_rows <= 0:
        raise ValueError("batch_rows must be positive")
    if (work is None) != (schema is None) or (work is None and batch_rows is not None):
        raise ValueError("batches need a plug-in and its schema")
    stored = spark.read.parquet(path)
    if work is None:
        return stored
    return stored.mapInArrow(work if batch_rows is None else in_batches(work, batch_rows), schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Rows of a database query; with a partition column, in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column is None:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) AS asked")
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )
