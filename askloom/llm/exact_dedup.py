"""Exact duplicates by a persistent digest index.

The index is a Spark table ``digest, doc_id``, bucketed and sorted by digest. New
documents are grouped by digest, groups that the index knows are removed by a
sort-merge anti-join, and the rest is appended. The index is not shuffled for it;
once a bucket has several files, one per append, Spark sorts it again. A document
stays if the index names it for its digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import ROW, numbered, texts
from askloom.operators.skew import spread_join
from askloom.session import land, spread

BUCKETS = 64


@dataclass(frozen=True)
class DigestIndex:
    """A stored index. ``path`` alone holds its state; the table name is local to
    the session and is created again over the same files when it is missing."""

    spark: SparkSession
    path: str
    name: str
    buckets: int = BUCKETS

    def __post_init__(self):
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def absent(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index doesn't hold."""
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add the groups that are new. Each bucket gets one sorted file per call.
        Calls are to follow one another: two at a time could add a digest twice."""
        new = self.absent(groups).select("digest", "doc_id")
        new.repartition(self.buckets, "digest").write.insertInto(self.name)


def digests(docs: DataFrame, *others: str) -> DataFrame:
    return texts(docs, *others).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), *others)


def exact_dedup(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the largest ``doc_id`` stays, unless the index already holds
    the text; then its entry stays and all new copies go. ``group_size`` counts
    the rows of ``docs`` with the text. Runs jobs: digests are stored once, and
    the index is extended, in so many ``batches`` of falling ids. Later ones meet
    what those before them have stored; the result is the same for any number.

    Null texts count as empty. A null ``doc_id`` is smaller than any other; where
    a text has no other, all its rows stay with a null ``keep_id``. Rows that
    repeat an id and its text share the decision. Other columns are ignored.
    """
    found = land(digests(docs), "digests")
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    for batch in _falling(found, batches):
        index.append(batch.groupBy("digest").agg(F.max("doc_id").alias("doc_id")))
    known = index.rows().hint("merge").select("digest", F.col("doc_id").alias("keep_id"))
    stays = sizes.join(known, "digest")
    return spread_join(found, stays, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _falling(found: DataFrame, batches: int) -> list[DataFrame]:
    """``found`` in batches of about equal size, the largest ids first, null ids last."""
    if batches <= 1:
        return [found]
    shares = [1 - i / batches for i in range(1, batches)]
    bounds = found.agg(F.percentile_approx("doc_id", shares).alias("b")).first()["b"]
    if bounds is None:
        return [found]
    made, above = [], None
    for bound in [*bounds, None]:
        rows = F.lit(True) if above is None else F.col("doc_id").isNull() | (F.col("doc_id") <= above)
        made.append(found.where(rows if bound is None else rows & (F.col("doc_id") > bound)))
        above = bound
    return made


def keep_one_row(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` with one row of each text, all columns kept: one with the largest
    ``doc_id``, null being smaller than any other. Of a text that the index holds
    already, only a row with its entry's id stays. Every row has a decision of its
    own, so copies without an id or with the same id go too; which of rows with
    equal id and text stays is open. Runs jobs, and extends the index."""
    keyed = numbered(spread(docs))
    found = land(digests(keyed, ROW), "digests")
    groups = found.groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
    held = index.rows().hint("merge").select("digest", F.lit(True).alias("held"))
    groups = land(groups.join(held, "digest", "left"), "digest-groups")
    index.append(groups)
    known = index.rows().hint("merge").select("digest", F.col("doc_id").alias("keep_id"))
    named = spread_join(found, groups.select("digest", "held").join(known, "digest"), "digest").where(
        F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("held").isNull() | F.col("keep_id").isNotNull())
    )
    stays = named.groupBy("digest").agg(F.min(ROW).alias(ROW)).select(ROW)
    return keyed.join(stays, ROW, "left_semi").drop(ROW)


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
