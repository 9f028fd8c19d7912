"""A term index that follows inserts: segments, superseded chunks, compaction.

Each append stores the token counts of its own chunks as a list per chunk, numbers the
chunks, and writes their postings as a segment; it never reads or rewrites an older
text. A chunk that comes again supersedes its older version: the pair (segment, number)
is noted. Readers leave those numbers out by bitmaps, a bit per chunk, so postings and
lists are filtered where they are read and not shuffled. Readers see the segments of the
newest generation, which is written last; an append that fails leaves nothing that they
see.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.operators.lexical import (
    TERM_BUCKETS,
    LexicalIndex,
    bitmaps,
    by_bucket,
    counted_rows,
    repeated_ids,
    spelled,
    with_bit,
)
from askloom.session import BROADCAST_BYTES, broadcast_if_small, land
from askloom.sources.dumps import path_exists

_GENERATION = "generation long, segment string, buckets int"
_CHUNKS = "chunk_id string, dl int, terms string, counts string, no long"


@dataclass(frozen=True)
class SegmentedIndex:
    """A folder of segments. One writer at a time."""

    spark: SparkSession
    path: str
    buckets: int = TERM_BUCKETS

    # -- what is there -----------------------------------------------------

    def _newest(self) -> tuple[int, list[str], int]:
        """Number, segments and buckets of the newest generation (a row per segment,
        which compaction keeps few)."""
        if not path_exists(self.spark, f"{self.path}/generations/*/*.parquet"):
            return 0, [], self.buckets
        rows = self.spark.read.schema(_GENERATION).parquet(f"{self.path}/generations/*")
        rows = rows.where(F.col("generation") == rows.select(F.max("generation")).scalar()).collect()
        return rows[0]["generation"], sorted(r["segment"] for r in rows if r["segment"]), rows[0]["buckets"]

    def segments(self) -> list[str]:
        return self._newest()[1]

    def _table(self, name: str, segments: list[str], schema: str) -> DataFrame:
        """Rows of a table in some segments, by folder."""
        paths = [f"{self.path}/{name}/segment={s}" for s in segments]
        paths = [p for p in paths if path_exists(self.spark, f"{p}/_SUCCESS")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _live(self, table: DataFrame, segments: list[str]) -> DataFrame:
        """Rows of numbered chunks that no later segment supersedes."""
        noted = self._table("superseded", segments, "of string, no long").select(F.col("of").alias("segment"), "no")
        # A word of a bitmap has up to 20 digits when its size is taken.
        maps = broadcast_if_small(land(bitmaps(noted, "segment"), "superseded"), max_bytes=2 * BROADCAST_BYTES)
        return with_bit(table, maps, "segment", bit=0)

    # -- writing -----------------------------------------------------------

    def append(self, chunks: DataFrame, text: str = "chunk_text") -> None:
        """Add chunks, and replace those whose ``chunk_id`` is there already. Ids are
        not null and occur once per append."""
        number, older, buckets = self._newest()
        segment = uuid.uuid4().hex
        self._write(spelled(counted_rows(chunks, text)), segment, buckets)
        self._supersede(self._table_of(segment).select("chunk_id"), older, segment)
        self._commit(number + 1, [*older, segment], buckets)

    def delete(self, chunk_ids: DataFrame) -> None:
        """Take chunks out; ids that are not there are ignored."""
        number, older, buckets = self._newest()
        if not older:
            return
        segment = uuid.uuid4().hex
        self._supersede(chunk_ids.select("chunk_id").distinct(), older, segment)
        self._commit(number + 1, [*older, segment], buckets)

    def compact(self) -> None:
        """One segment of all live chunks, made of the stored counts. Older folders
        stay for readers that have them open; they are the owner's to clear."""
        number, older, buckets = self._newest()
        if len(older) < 2:
            return
        segment = uuid.uuid4().hex
        self._write(self._live_chunks(older).drop("segment", "no"), segment, buckets)
        self._commit(number + 1, [segment], buckets)

    def _table_of(self, segment: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks/segment={segment}")

    def _live_chunks(self, segments: list[str]) -> DataFrame:
        return self._live(self._table("chunks", segments, _CHUNKS), segments)

    def _write(self, lists: DataFrame, segment: str, buckets: int) -> None:
        """Store the lists with a number per chunk, then their postings. The numbers
        are those of the stored rows, so no second run of a task changes them."""
        lists.withColumn("no", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(
            f"{self.path}/chunks/segment={segment}"
        )
        stored = self._table_of(segment)
        term, tf = F.split("terms", " "), F.split("counts", " ").cast("array<int>")
        # n: chunk rows that hold the term.
        rows = stored.select("chunk_id", "dl", "no", F.lit(1).alias("n"), term.alias("term"), tf.alias("tf")).where("dl > 0")
        repeated = repeated_ids(stored)
        once = rows
        if not repeated.isEmpty():
            repeated, same = broadcast_if_small(repeated), F.col("chunk_id").eqNullSafe(F.col("_id"))
            once, more = (rows.join(repeated, same, how) for how in ("left_anti", "left_semi"))
        posted = once.select("chunk_id", "dl", "no", "n", F.arrays_zip("term", "tf").alias("posted"))
        if once is not rows:
            # Rows that share their id are superseded together, so any number of theirs does.
            more = more.select("chunk_id", "dl", "no", F.inline(F.arrays_zip("term", "tf"))).groupBy("chunk_id", "dl", "term").agg(
                F.sum("tf").cast("int").alias("tf"), F.min("no").alias("no"), F.count(F.lit(1)).cast("int").alias("n")
            )
            posted = posted.unionByName(more.select("chunk_id", "dl", "no", "n", F.array(F.struct("term", "tf")).alias("posted")))
        by_bucket(posted, buckets, stored.count()).write.option("compression", "zstd").partitionBy("bucket").parquet(
            f"{self.path}/postings/segment={segment}"
        )

    def _supersede(self, ids: DataFrame, older: list[str], segment: str) -> None:
        """Note the older live versions of some chunks. Ids and numbers are read, no terms."""
        if not older:
            return
        held = self._live_chunks(older).select("segment", "chunk_id", "no")
        held.join(ids, "chunk_id", "left_semi").select(F.col("segment").alias("of"), "no").write.parquet(
            f"{self.path}/superseded/segment={segment}"
        )

    def _commit(self, number: int, segments: list[str], buckets: int) -> None:
        rows = [(number, s, buckets) for s in segments] or [(number, None, buckets)]
        self.spark.createDataFrame(rows, _GENERATION).coalesce(1).write.parquet(
            f"{self.path}/generations/{number:010d}"
        )

    # -- reading -----------------------------------------------------------

    def read(self) -> LexicalIndex:
        """The index of all live chunks, for the searches of ``lexical``. Postings are
        pruned by term bucket in every segment. Statistics are those of the live postings
        and chunk lists, and are stored once per call."""
        _, segments, buckets = self._newest()
        chunks = self._live_chunks(segments)
        kind = dict(chunks.dtypes)["chunk_id"]
        posted = self._live(self._table(
            "postings", segments, f"term string, chunk_id {kind}, tf int, dl int, no long, n int, bucket int"
        ), segments)
        terms = posted.groupBy("term").agg(F.sum("n").alias("df"))
        totals = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl"))
        return LexicalIndex(posted, land(terms, "terms"), land(totals, "totals"), buckets)
