"""The order in which rows stand in their files.

Rows of a Spark table have no order, but a file's rows do: Parquet files give each row
its number. With it, operators that keep the first of several rows can mean the first
that arrived, and a job that runs again keeps the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_in_order(spark: SparkSession, *paths: str, name: str = "arrival") -> DataFrame:
    """Parquet tables with ``arrival``: the position of the path, the file in it and
    the row in the file. Later paths come after earlier ones; inside a path files come
    by name, as writers number them. Reading it moves no row."""
    found = None
    for at, path in enumerate(paths):
        rows = spark.read.parquet(path)
        here = F.struct(
            F.lit(at).alias("source"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        )
        rows = rows.select(here.alias(name), "*")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        raise ValueError("no paths are given")
    return found
