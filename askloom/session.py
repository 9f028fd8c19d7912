"""Session settings and the two things every job needs from its cluster:
a shared scratch folder and a size check to run before broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may hold to be shipped to every task.
BROADCAST_ROWS = 200_000
#: Most bytes of row text (JSON length) a side may hold to be shipped to every task.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "askloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution chooses join sides by measured size, merges small
    shuffle partitions and splits skewed ones, so no partition count is forced.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings: dict[str, object] = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables, under the folder the cluster names.

    A temporary folder is made only where nothing is configured and the session is
    local, as in tests; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share"
            )
        root = tempfile.mkdtemp(prefix="askloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def land(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Used where one intermediate result feeds several branches: it is computed
    once, and a lost executor re-reads files instead of re-running the plan.
    """
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows if the scan has fewer splits than there are cores, as
    with one small file. A scan with enough splits is left alone, so nothing is
    shuffled at scale. For scans whose rows cost much work each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a side before it is broadcast. Runs one job that stops after
    ``max_rows + 1`` rows."""
    measured = (
        df.limit(max_rows + 1)
        .select(F.length(F.to_json(F.struct("*"))).alias("bytes"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    return measured["rows"] <= max_rows and measured["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds: int) -> DataFrame:
    """Mark a side for broadcast when it is measured to be small, else leave
    the choice (sort-merge with skew splitting) to the optimizer."""
    return F.broadcast(df) if fits_broadcast(df, **bounds) else df
