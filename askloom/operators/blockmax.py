"""Ranked term search that leaves whole blocks of postings out.

Chunks are dealt into blocks. For each term and block the index holds the postings as
one row, and apart from them the greatest term count and the least chunk length,
which bound the term's part of any BM25 score in the block. A search adds the bounds
up, scores the most promising blocks of each query, and then reads only those other
blocks whose bound reaches the k-th score found. No answer is lost (block-max
pruning, Ding and Suel 2011).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.operators.lexical import (
    CHUNKS_PER_TASK,
    SCORE_DIGITS,
    TERM_BUCKETS,
    LexicalIndex,
    _in_buckets,
    _plans_of_queries,
    coded,
    cut_lists,
    list_rows,
    run_starts,
    spelled,
    term_bucket,
    term_lists,
)
from askloom.session import broadcast_if_small, fits_broadcast, land

# What tasks run is sent by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LISTS = (
    "term string, block int, posted array<struct<chunk_id:{kind},tf:int,dl:int>>, "
    "max_tf int, min_dl int, n int, tokens long"
)
#: Rows that a task groups or scores at once, beyond those of a single block.
ROWS_AT_ONCE = 20_000
#: Terms of all queries that are sent to the tasks which score blocks, and their bytes.
MAX_SHIPPED_TERMS = 100_000
MAX_SHIPPED_BYTES = 16 * 1024 * 1024
#: Chunks of a block, on average.
BLOCK_CHUNKS = 64
#: Blocks per query that are scored to find a threshold.
LEAD_BLOCKS = 8


@dataclass(frozen=True)
class BlockIndex:
    """``lists(bucket, term, block, posted)``: the postings of a term in a block as an
    array of ``chunk_id, tf, dl``; ``maxima(bucket, term, block, max_tf, min_dl, n)``,
    other columns of the same files; and the statistics of a ``LexicalIndex``."""

    lists: DataFrame
    maxima: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int

    def part(self, table: DataFrame) -> LexicalIndex:
        """A table as postings, for what the plain search has too."""
        return LexicalIndex(table, self.terms, self.totals, self.buckets)


def write_blocks(
    chunks: DataFrame, path: str, text: str = "chunk_text", *, buckets: int = TERM_BUCKETS, block_chunks: int = BLOCK_CHUNKS
) -> BlockIndex:
    """Store the index. A term in a third of all chunks is so many rows of bounded size,
    written by many tasks."""
    spark = chunks.sparkSession
    n_chunks = chunks.count()
    n_blocks = max(1, -(-n_chunks // block_chunks))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(n_blocks)).cast("int")
    # A chunk is one row until it is in its block; grouping and writing then shuffle
    # nothing. A task writes a file of every folder, for some ten thousands of chunks.
    tasks = max(1, -(-n_chunks // (4 * CHUNKS_PER_TASK)))
    lists = spelled(term_lists(chunks, text)).where("dl > 0").withColumn("block", block).repartition(tasks, "block")
    kind = dict(chunks.dtypes)["chunk_id"]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches, ROWS_AT_ONCE):
            yield _group_block(rows)

    rows = (
        lists.sortWithinPartitions("block", "chunk_id", "dl")
        .select("block", "chunk_id", "dl", F.split("terms", " ").alias("terms"), F.split("counts", " ").cast("array<int>").alias("counts"))
        .mapInArrow(group, _LISTS.format(kind=kind))
        .withColumn("bucket", term_bucket(F.col("term"), buckets))
    )
    # Rows come in order of terms, by pieces; ordering by a number alone needs no comparisons.
    rows.sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    stored = spark.read.schema(f"{_LISTS.format(kind=kind)}, bucket int").parquet(f"{path}/lists")
    stored.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    # The counts add up to all tokens, so texts are split once.
    tokens = stored.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    totals = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    totals.select(
        "n_chunks", (tokens / F.nullif("n_chunks", F.lit(0))).alias("avg_dl"),
        F.lit(buckets).alias("buckets"), F.lit(kind).alias("id_type"),
    ).write.mode("overwrite").parquet(f"{path}/totals")
    return read_blocks(spark, path)


def whole_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of their ``block`` as batches of about so many that end with a block."""
    held: list[pa.RecordBatch] = []

    def together() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            rows = together()
            block = rows.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield rows.slice(0, cut)
                rows = rows.slice(cut)
            held = [rows]
    if held:
        yield together()


def _group_block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Chunks of whole blocks as a row for each term and block, in this order."""
    row = list_rows(rows.column("terms"))
    words, codes = coded(rows.column("terms").flatten())
    blocks, place = np.unique(rows.column("block").to_numpy(), return_inverse=True)
    keys = codes * max(1, len(blocks)) + place[row]
    order = np.argsort(keys, kind="stable")
    starts = run_starts(keys[order])
    code, at = np.divmod(keys[order][starts], max(1, len(blocks)))
    row, tf = row[order], rows.column("counts").flatten().to_numpy()[order]
    dl = rows.column("dl").to_numpy()[row]
    posted = pa.StructArray.from_arrays(
        [rows.column("chunk_id").take(pa.array(row)), pa.array(tf), pa.array(dl)], names=["chunk_id", "tf", "dl"]
    )
    offsets = np.append(starts, len(keys))
    return pa.RecordBatch.from_arrays(
        [
            words.take(pa.array(code)), pa.array(blocks[at].astype(np.int32)), cut_lists(offsets, posted),
            pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)),
            pa.array(np.diff(offsets).astype(np.int32)), pa.array(np.add.reduceat(tf.astype(np.int64), starts)),
        ],
        names=["term", "block", "posted", "max_tf", "min_dl", "n", "tokens"],
    )


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    totals = spark.read.parquet(f"{path}/totals")
    known = totals.first()
    # By schemas of their own: an empty table has no files.
    rows = spark.read.schema(f"{_LISTS.format(kind=known['id_type'])}, bucket int").parquet(f"{path}/lists")
    return BlockIndex(
        rows.select("term", "block", "posted", "bucket"), rows.select("term", "block", "max_tf", "min_dl", "n", "bucket"),
        spark.read.schema("term string, df long").parquet(f"{path}/terms"), totals, known["buckets"],
    )


@dataclass(frozen=True)
class _Asked:
    """The terms of all queries, for tasks. A unit is a query with what it needs."""

    ids: pa.Array  # of queries
    words: pa.Array
    idf: np.ndarray  # of words
    query: np.ndarray  # of units
    needed: np.ndarray  # of units
    unit: np.ndarray  # of rows of units and words, with
    word: np.ndarray


def _asked_terms(terms: DataFrame) -> _Asked:
    rows = terms.where("query_id IS NOT NULL").select("query_id", "needed", "term", "idf").toArrow().combine_chunks()
    ids, words = rows["query_id"].unique(), rows["term"].unique()
    query, word = (
        pc.index_in(rows[n], value_set=v).to_numpy().astype(np.int64) for n, v in (("query_id", ids), ("term", words))
    )
    needed = rows["needed"].to_numpy().astype(np.int64)
    units, unit = np.unique(np.stack([query, needed], axis=1).reshape(-1, 2), axis=0, return_inverse=True)
    idf = np.zeros(len(words))
    idf[word] = rows["idf"].to_numpy()
    return _Asked(ids, words, idf, units[:, 0], units[:, 1], unit.reshape(-1), word)


def _block_scores(lists: DataFrame, blocks: DataFrame, terms: DataFrame, bm25: tuple[float, float, float]) -> DataFrame:
    """Scores of the chunks of blocks, ``query_id, block``, that hold enough terms. The
    lists of a block and the queries that want it meet in a task, where a block is a
    product of two small matrices, queries by terms and terms by chunks. No row is made
    for a pair of query and chunk that shares too few terms."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(_asked_terms(terms))
    kinds = dict(blocks.dtypes)["query_id"], lists.schema["posted"].dataType.elementType["chunk_id"].dataType.simpleString()
    wanted = blocks.where("query_id IS NOT NULL").groupBy("block").agg(F.collect_list("query_id").alias("queries"))
    lists = lists.join(broadcast_if_small(wanted.select("block")), "block", "left_semi")
    none = {"term": F.lit(None).cast("string"), "posted": F.lit(None).cast(lists.schema["posted"].dataType)}
    meeting = lists.select("block", F.lit(1).alias("kind"), "term", "posted", F.lit(None).cast(wanted.schema["queries"].dataType).alias("queries"))
    meeting = meeting.unionByName(wanted.withColumns(none).select("block", F.lit(0).alias("kind"), "term", "posted", "queries"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for rows in whole_blocks(batches, ROWS_AT_ONCE):
            yield _score_blocks(rows, asked, *bm25)

    return (
        meeting.repartition("block").sortWithinPartitions("block")
        .mapInArrow(meet, f"query_id {kinds[0]}, chunk_id {kinds[1]}, _sum double")
        .select("query_id", "chunk_id", F.round("_sum", SCORE_DIGITS).alias("score"))
    )


def _score_blocks(rows: pa.RecordBatch, asked: _Asked, k1: float, b: float, avg_dl: float) -> pa.RecordBatch:
    """Rows of whole blocks: lists of terms, and the queries that want a block."""
    is_list = rows.column("kind").to_numpy() == 1
    block = rows.column("block").to_numpy()
    wants, lists = rows.filter(pa.array(~is_list)), rows.filter(pa.array(is_list))
    wanted = wants.column("queries")
    wanted_block = block[~is_list][list_rows(wanted)]
    wanted_query = pc.index_in(wanted.flatten(), value_set=asked.ids)
    known = wanted_query.is_valid().to_numpy(zero_copy_only=False)
    wanted_block, wanted_query = wanted_block[known], wanted_query.drop_null().to_numpy().astype(np.int64)
    place = list_rows(lists.column("posted"))
    word = pc.index_in(lists.column("term"), value_set=asked.words).to_numpy().astype(np.int64)[place]
    at = block[is_list][place]
    chunk, tf, dl = lists.column("posted").flatten().flatten()
    tf, dl = (x.to_numpy().astype(np.float64) for x in (tf, dl))
    part = asked.idf[word] * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avg_dl)))
    found = chunk.dictionary_encode(null_encoding="encode")
    code = found.indices.to_numpy().astype(np.int64)
    starts = run_starts(at)
    queries, chunks, sums = [], [], []
    position = np.full(len(asked.words), -1)
    for first, last in zip(starts, np.append(starts[1:], len(at))):
        here = slice(*np.searchsorted(wanted_block, [at[first], at[first] + 1]))
        times = np.bincount(wanted_query[here], minlength=len(asked.ids))[asked.query]
        units = np.flatnonzero(times)
        if not len(units):
            continue
        words, w = np.unique(word[first:last], return_inverse=True)
        codes, c = np.unique(code[first:last], return_inverse=True)
        shape = len(words), len(codes)
        cells = w * shape[1] + c
        held = np.bincount(cells, minlength=shape[0] * shape[1]).reshape(shape).astype(np.float64)
        parts = np.bincount(cells, weights=part[first:last], minlength=shape[0] * shape[1]).reshape(shape)
        position[words] = np.arange(len(words))
        row = np.full(len(asked.query), -1)
        row[units] = np.arange(len(units))
        pairs = np.flatnonzero((position[asked.word] >= 0) & (row[asked.unit] >= 0))
        has = np.bincount(
            row[asked.unit[pairs]] * len(words) + position[asked.word[pairs]], minlength=len(units) * len(words)
        ).reshape(len(units), len(words)) * times[units][:, None].astype(np.float64)
        position[words] = -1
        q, x = np.nonzero(has @ held >= asked.needed[units][:, None])
        # Mostly few pairs hold enough terms.
        sums.append((has @ parts)[q, x] if len(q) > len(units) else (has[q] * parts.T[x]).sum(axis=1))
        queries.append(asked.query[units[q]])
        chunks.append(codes[x])
    none = np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            asked.ids.take(pa.array(np.concatenate([none, *queries]))),
            found.dictionary.take(pa.array(np.concatenate([none, *chunks]))),
            pa.array(np.concatenate([np.zeros(0), *sums])),
        ],
        names=["query_id", "chunk_id", "_sum"],
    )


def blockmax_topk(
    index: BlockIndex,
    queries: DataFrame,
    k: int,
    *,
    min_share: float = 0.5,
    k1: float = 1.2,
    b: float = 0.75,
    lead: int = LEAD_BLOCKS,
    watch: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """The rows of ``lexical.any_term_topk``. ``watch`` is handed the stored table of the
    blocks that are read after the first ones, ``query_id, block``. Stores the bounds, the
    first scores and that table; runs jobs for them."""
    if lead < 1:
        raise ValueError("lead must be positive")
    totals = index.totals.first()
    n_chunks, avg_dl = totals["n_chunks"], totals["avg_dl"]

    def impact(tf: Column, dl: Column) -> Column:
        return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.lit(avg_dl)))

    idf = F.log(1.0 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    plans = _plans_of_queries(index.part(index.maxima), queries, min_share)
    terms = land(
        plans.select("query_id", "needed", F.inline("known")).withColumn("idf", idf), "asked-terms"
    )
    asked = broadcast_if_small(terms)
    maxima = _in_buckets(index.part(index.maxima), terms)
    bounds = (
        maxima.join(asked, "term").groupBy("query_id", "block", "needed")
        .agg(
            F.sum(F.col("idf") * impact(F.col("max_tf"), F.col("min_dl"))).alias("bound"),
            F.count(F.lit(1)).alias("_held"),
        )
        .where(F.col("_held") >= F.col("needed"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), F.col("block"))
    bounds = land(bounds.withColumn("place", F.row_number().over(order)).drop("_held"), "block-bounds")

    def listed() -> DataFrame:
        """The lists of terms that some query has; others are not shuffled."""
        lists = _in_buckets(index.part(index.lists), terms).drop("bucket")
        return lists.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")

    def joined_scores(blocks: DataFrame) -> DataFrame:
        wanted = blocks.select("query_id", "block").join(terms, "query_id")
        rows = listed().join(broadcast_if_small(wanted), ["term", "block"])
        rows = rows.select("query_id", "needed", "idf", F.inline("posted"))
        return (
            rows.groupBy("query_id", "chunk_id", "needed")
            .agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("dl"))).alias("_sum"), F.count(F.lit(1)).alias("_held"))
            .where(F.col("_held") >= F.col("needed"))
            .select("query_id", "chunk_id", F.round("_sum", SCORE_DIGITS).alias("score"))
        )

    shipped = fits_broadcast(terms, max_rows=MAX_SHIPPED_TERMS, max_bytes=MAX_SHIPPED_BYTES)

    def scores(blocks: DataFrame) -> DataFrame:
        return _block_scores(listed(), blocks, terms, (k1, b, avg_dl)) if shipped else joined_scores(blocks)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    first = bounds.where(F.col("place") <= lead)
    found = scores(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = land(found, "first-scores")
    limits = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    # A bound is a sum in another order, so it may be smaller by a rounding.
    rest = bounds.where(F.col("place") > lead).join(limits, "query_id", "left").where(
        F.col("_least").isNull() | (F.col("bound") + 10.0**-SCORE_DIGITS >= F.col("_least"))
    )
    rest = land(rest.select("query_id", "block"), "other-blocks")
    if watch:
        watch(rest)
    every = found.drop("rank").unionByName(scores(rest))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
