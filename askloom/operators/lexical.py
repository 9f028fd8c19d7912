"""Inverted index and ranked term search for whole tables of queries.

Tables: ``chunks(chunk_id, chunk_text, ...)`` and ``queries(query_id, text)``.

A chunk that holds at least m of a query's n terms holds at least j of the
query's n-m+j rarest terms, for any j up to m. So candidates come from the rarest
terms only (one term per query for the all-terms match), and the common terms,
whose postings may cover a third of the corpus, are only looked up for those
candidates by ``(chunk_id, term)``. No list of all pairs sharing a common term is
ever made.
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

from askloom.functions.text import simple_tokens
from askloom.operators import skew
from askloom.session import broadcast_if_small, fits_broadcast, land

# What tasks run is sent by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folders of a large stored index. A search reads only those its terms fall in.
TERM_BUCKETS = 256
#: Chunks whose postings in all buckets one task writes, on average.
CHUNKS_PER_TASK = 10_000
#: Tokens that are counted at once.
TOKENS_AT_ONCE = 4_000_000
#: Scores are ranked after rounding, so that equal scores tie exactly.
SCORE_DIGITS = 9
#: Chunks that hold a query's rarest term, from which on its next rarest thins them out.
THIN_FROM = 20_000


def postings(chunks: DataFrame, text: str = "chunk_text", positions: bool = False) -> DataFrame:
    """``(term, chunk_id, tf, dl)``: one row per term and chunk; ``dl`` is the
    chunk's token count. With ``positions``, also the term's places in the chunk,
    in order."""
    packed = term_lists(chunks, text, positions, native=True)
    more = ["positions"] if positions else []
    # Outer, as the filter on empty lists would split all texts once more.
    flat = packed.select("chunk_id", "dl", F.inline_outer("posted")).where("term IS NOT NULL")
    return flat.select("term", "chunk_id", "tf", "dl", *more)


def term_lists(
    chunks: DataFrame, text: str = "chunk_text", positions: bool = False, *, native: bool = False
) -> DataFrame:
    """``(chunk_id, dl, posted)``: the postings, as an array of ``term, tf`` (and
    ``positions``) in the order of terms, empty for a chunk without tokens.

    Tokens of a chunk are counted in its row, so none is shuffled. Rows that share their
    ``chunk_id`` (and ``dl``) count as one chunk: such ids are looked for first, by a job
    over the ids alone, and only their tokens are grouped; each of those has a row.
    ``native`` makes a plan without Python, which takes longer.
    """
    counted = _counted_natively if native else counted_rows
    repeated = repeated_ids(chunks)
    if repeated.isEmpty():
        return counted(chunks, text, positions)
    repeated, same = broadcast_if_small(repeated), F.col("chunk_id").eqNullSafe(F.col("_id"))
    once, more = (chunks.join(repeated, same, how) for how in ("left_anti", "left_semi"))
    names = ["term", "tf", *(["positions"] if positions else [])]
    grouped = _grouped(more, text, positions).select("chunk_id", "dl", F.array(F.struct(*names)).alias("posted"))
    return counted(once, text, positions).unionByName(grouped)


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """Ids, as ``_id``, that several rows have. Stores them; runs a job for it."""
    return land(
        chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("_id")),
        "repeated-ids",
    )


def spelled(lists: DataFrame) -> DataFrame:
    """Term lists with ``terms`` and ``counts`` as texts with blanks between, as tokens
    hold none; they take less room than arrays."""
    kept = [n for n in lists.columns if n != "posted"]
    return lists.select(
        *kept, F.array_join("posted.term", " ").alias("terms"),
        F.array_join(F.col("posted.tf").cast("array<string>"), " ").alias("counts"),
    )


#: Numbers of a bitmap, as words of 64.
BITMAP = 1 << 15


def bitmaps(numbers: DataFrame, *keys: str) -> DataFrame:
    """The numbers ``no`` of each key as bitmaps: ``*keys, _map, _words``."""
    n_words = BITMAP // 64
    bit = F.expr("shiftleft(1L, CAST(no % 64 AS INT))")
    words = numbers.groupBy(*keys, F.floor(F.col("no") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = F.map_from_entries(F.collect_list(F.struct((F.col("_word") % n_words).cast("int").alias("at"), "_bits")))
    maps = words.groupBy(*keys, F.floor(F.col("_word") / n_words).alias("_map")).agg(held.alias("_held"))
    whole = F.transform(
        F.sequence(F.lit(0), F.lit(n_words - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0).cast("long"))
    )
    return maps.select(*keys, "_map", whole.alias("_words"))


def with_bit(table: DataFrame, maps: DataFrame, *keys: str, bit: int = 1) -> DataFrame:
    """Rows whose number ``no`` has the bit in the bitmaps, or has it not."""
    word = F.expr(f"get(_words, CAST(no % {BITMAP} AS INT) DIV 64)")
    found = table.withColumn("_map", F.floor(F.col("no") / BITMAP)).join(maps, [*keys, "_map"], "left")
    held = F.coalesce(F.getbit(word, (F.col("no") % 64).cast("int")), F.lit(0))
    return found.where(held == bit).drop("_map", "_words")


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where in a sorted array the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order, and the place of each word among them."""
    found = words.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    places = np.empty(len(order), dtype=np.int64)
    places[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), places[found.indices.to_numpy()]


def cut_lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


def list_rows(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of a list column without nulls."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def joined(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of terms or numbers, each as one text with a blank between: tokens hold
    none, and one text takes much less of a shuffle than an array."""
    return pc.binary_join(cut_lists(offsets, values.cast(pa.string())), " ")


def in_pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of so many list values at most, a row at least."""
    ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _count_tokens(batch: pa.RecordBatch, positions: bool) -> pa.RecordBatch:
    """Rows ``chunk_id, _tokens`` as term lists."""
    lists = batch.column("_tokens")
    rows = list_rows(lists)
    words, codes = coded(lists.flatten())
    keys = rows * max(1, len(words)) + codes
    order = np.argsort(keys, kind="stable") if positions else None
    keys = keys[order] if positions else np.sort(keys)
    starts = run_starts(keys)
    row, code = np.divmod(keys[starts], max(1, len(words)))
    ends = np.append(starts[1:], len(keys))
    fields = {"term": words.take(pa.array(code)), "tf": pa.array((ends - starts).astype(np.int32))}
    lengths = np.diff(lists.offsets.to_numpy())
    if positions:
        first = np.cumsum(lengths) - lengths
        at = (order - first[rows[order]]).astype(np.int32)
        fields["positions"] = cut_lists(np.append(starts, len(keys)), pa.array(at))
    posted = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    offsets = np.searchsorted(row, np.arange(len(lists) + 1))
    return pa.RecordBatch.from_arrays(
        [batch.column("chunk_id"), pa.array(lengths.astype(np.int32)), cut_lists(offsets, posted)],
        names=["chunk_id", "dl", "posted"],
    )


def counted_rows(chunks: DataFrame, text: str, positions: bool = False) -> DataFrame:
    """Term lists, one of each row. Tokens are counted by batch."""
    kind = chunks.select("chunk_id").schema["chunk_id"].dataType.simpleString()
    posted = f"array<struct<term:string,tf:int{',positions:array<int>' if positions else ''}>>"
    tokens = chunks.select("chunk_id", simple_tokens(F.col(text)).alias("_tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "_tokens", TOKENS_AT_ONCE):
                yield _count_tokens(piece, positions)

    return tokens.mapInArrow(count, f"chunk_id {kind}, dl int, posted {posted}")


def _starts_of_runs(items: Column, key: Callable[[Column], Column]) -> Column:
    """Where in a sorted array the runs of items with the same key begin, from 0."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1))
    return F.filter(
        F.coalesce(places, F.array().cast("array<int>")),
        lambda i: (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1))),
    )


def _counted_natively(chunks: DataFrame, text: str, positions: bool) -> DataFrame:
    """The same rows as ``counted_rows`` by SQL functions alone, for plans without Python.
    Equal tokens are runs once sorted."""
    tokens = simple_tokens(F.col(text))
    if positions:
        tokens = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    term = (lambda x: x["term"]) if positions else (lambda x: x)
    tokens = chunks.select("chunk_id", F.sort_array(tokens).alias("_tokens"))
    runs = tokens.select("*", F.size("_tokens").alias("dl"), _starts_of_runs(F.col("_tokens"), term).alias("_runs"))

    def posting(start: Column, i: Column) -> Column:
        tf = F.coalesce(F.get("_runs", i + 1), F.col("dl")) - start
        places = F.transform(F.slice("_tokens", start + 1, tf), lambda x: x["at"]) if positions else None
        return F.struct(
            term(F.get("_tokens", start)).alias("term"), tf.alias("tf"),
            *([places.alias("positions")] if positions else []),
        )

    return runs.select("chunk_id", "dl", F.transform("_runs", posting).alias("posted"))


def _grouped(chunks: DataFrame, text: str, positions: bool) -> DataFrame:
    """Postings of any chunks, by grouping all tokens."""
    tokens = chunks.select("chunk_id", simple_tokens(F.col(text)).alias("_tokens"))
    counts = [F.count(F.lit(1)).cast("int").alias("tf")]
    if positions:
        counts.append(F.array_sort(F.collect_list("position")).alias("positions"))
    return (
        tokens.select("chunk_id", F.size("_tokens").alias("dl"), F.posexplode("_tokens").alias("position", "term"))
        .groupBy("term", "chunk_id", "dl")
        .agg(*counts)
        .select("term", "chunk_id", "tf", "dl", *(["positions"] if positions else []))
    )


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _share_out(batch: pa.RecordBatch, buckets: int, counts: str, kept: list[str]) -> pa.RecordBatch:
    """A row per chunk and bucket, with its terms and their counts or places."""
    rows = list_rows(batch.column("posted"))
    keys = rows * buckets + batch.column("_buckets").flatten().to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = run_starts(keys)
    row, bucket = np.divmod(keys[starts], buckets)
    offsets, order = np.append(starts, len(keys)), pa.array(order)
    posted = batch.column("posted").flatten()
    terms, held = (pc.struct_field(posted, name).take(order) for name in ("term", counts))
    held = cut_lists(offsets, held) if counts == "positions" else joined(offsets, held)
    return pa.RecordBatch.from_arrays(
        [batch.column(n).take(pa.array(row)) for n in kept] + [pa.array(bucket.astype(np.int32)), joined(offsets, terms), held],
        names=[*kept, "bucket", "_terms", "_counts"],
    )


def by_bucket(lists: DataFrame, buckets: int, n_chunks: int) -> DataFrame:
    """Postings of term lists with their ``bucket``, dealt for writing: each bucket is
    cut by a hash of the chunk, so that tasks grow in number with the chunks and not in
    size. A chunk's terms of a bucket are shuffled as one row, and as one text. Columns
    that the lists have beside ``posted`` are the chunk's and stay."""
    parts = max(1, -(-n_chunks // (CHUNKS_PER_TASK * buckets)))
    kept = [n for n in lists.columns if n != "posted"]
    # With places, tf is their number.
    counts = "positions" if "positions" in lists.schema["posted"].dataType.elementType.names else "tf"
    of = F.transform("posted", lambda x: term_bucket(x["term"], buckets))
    types = ", ".join(f"`{n}` {lists.schema[n].dataType.simpleString()}" for n in kept)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "posted", TOKENS_AT_ONCE):
                yield _share_out(piece, buckets, counts, kept)

    shared = lists.withColumn("_buckets", of).mapInArrow(
        share, f"{types}, bucket int, _terms string, _counts {'array<array<int>>' if counts == 'positions' else 'string'}"
    )
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")
    held = F.col("_counts") if counts == "positions" else F.split("_counts", " ").cast("array<int>")
    dealt = shared.repartitionById(buckets * parts, F.col("bucket") * parts + part).select(
        *kept, "bucket", F.split("_terms", " ").alias("_terms"), held.alias("_counts")
    )

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, "_terms", TOKENS_AT_ONCE):
            yield _in_term_order(rows, counts, kept)

    posted = dealt.mapInArrow(flat, f"{types}, bucket int, term string, {counts} {'array<int>' if counts == 'positions' else 'int'}")
    tf = F.size("positions") if counts == "positions" else F.col("tf")
    others = [n for n in kept if n not in ("chunk_id", "dl")]
    # Ordering by a number alone needs no comparisons, and keeps the order of terms.
    return posted.select(
        "bucket", "term", "chunk_id", tf.alias("tf"), "dl", *(["positions"] if counts == "positions" else []), *others
    ).sortWithinPartitions("bucket")


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches together, up to so many list values."""
    held, n = [], 0
    for batch in batches:
        for piece in in_pieces(batch, column, most):
            values = len(piece.column(column).flatten())
            if held and n + values > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(piece)
            n += values
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _in_term_order(rows: pa.RecordBatch, counts: str, kept: list[str]) -> pa.RecordBatch:
    """A row per term and chunk of the rows of ``_share_out``, by bucket, term and chunk."""
    rows = rows.take(pc.sort_indices(rows.column("chunk_id")))
    row = list_rows(rows.column("_terms"))
    words, codes = coded(rows.column("_terms").flatten())
    bucket = rows.column("bucket").to_numpy().astype(np.int64)
    order = np.argsort(bucket[row] * max(1, len(words)) + codes, kind="stable")
    row, held = pa.array(row[order]), rows.column("_counts").flatten().take(pa.array(order))
    return pa.RecordBatch.from_arrays(
        [rows.column(n).take(row) for n in (*kept, "bucket")] + [words.take(pa.array(codes[order])), held],
        names=[*kept, "bucket", "term", counts],
    )


@dataclass(frozen=True)
class LexicalIndex:
    """Postings with the statistics that scoring needs.

    ``terms(term, df)`` counts chunks per term; ``totals(n_chunks, avg_dl)`` is
    one row over all chunks, those without tokens included. Stored postings have
    a ``bucket`` column with ``buckets`` values.
    """

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int = 0


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_totals(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    length = F.size(simple_tokens(F.col(text)))
    return chunks.select(length.alias("dl")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl")
    )


def lexical_index(chunks: DataFrame, text: str = "chunk_text", positions: bool = False) -> LexicalIndex:
    posted = postings(chunks, text, positions)
    return LexicalIndex(posted, document_frequencies(posted), corpus_totals(chunks, text))


def write_index(
    chunks: DataFrame, path: str, text: str = "chunk_text", buckets: int = TERM_BUCKETS,
    positions: bool = False,
) -> LexicalIndex:
    """Store the index: postings in one folder per term bucket, in term order (a very
    large file in several runs), with the places of the terms if asked for.

    A task writes one file of one folder, so a folder has few files, and the
    postings of a very common term are still written by many tasks.
    """
    spark = chunks.sparkSession
    posted = by_bucket(term_lists(chunks, text, positions), buckets, chunks.count())
    posted.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    document_frequencies(stored).write.mode("overwrite").parquet(f"{path}/terms")
    # The stored counts add up to all tokens, so texts are split once.
    tokens = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens")).scalar()
    totals = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    totals.select(
        "n_chunks",
        (tokens / F.nullif("n_chunks", F.lit(0))).alias("avg_dl"),
        F.lit(buckets).alias("buckets"),
    ).write.mode("overwrite").parquet(f"{path}/totals")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    posted, terms, totals = (
        spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "totals")
    )
    return LexicalIndex(posted, terms, totals, totals.first()["buckets"])


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """Distinct terms of every query with their number: ``(query_id, term, n_terms)``."""
    terms = queries.select(
        "query_id", F.array_distinct(simple_tokens(F.col(text))).alias("_terms")
    )
    return terms.select(
        "query_id", F.explode("_terms").alias("term"), F.size("_terms").alias("n_terms")
    )


def _needed(n_terms: Column, min_share: float) -> Column:
    """Terms a chunk must hold: the share of the query's terms, rounded up."""
    if not 0 < min_share <= 1:
        raise ValueError("min_share must lie in (0, 1]")
    return F.greatest(F.lit(1), F.ceil(F.round(n_terms * F.lit(float(min_share)), 9)).cast("int"))


def _plans_of_queries(index: LexicalIndex, queries: DataFrame, min_share: float) -> DataFrame:
    """Per query: its terms that occur in the corpus, rarest first, as
    ``known`` (term, df), with ``n_terms`` and ``needed``. Queries with too few
    known terms cannot match and are left out."""
    known = (
        query_terms(queries)
        .join(index.terms, "term")
        .groupBy("query_id", "n_terms")
        .agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("known"))
    )
    return known.withColumn("needed", _needed(F.col("n_terms"), min_share)).where(
        F.size("known") >= F.col("needed")
    )


def _in_buckets(index: LexicalIndex, probes: DataFrame) -> DataFrame:
    """Restrict stored postings to the folders of the probed terms. At most one
    number per folder is fetched."""
    if not index.buckets:
        return index.postings
    bucket = term_bucket(F.col("term"), index.buckets)
    used = probes.select(bucket.alias("bucket")).distinct().collect()
    return index.postings.where(F.col("bucket").isin([row["bucket"] for row in used]))


@dataclass(frozen=True)
class _Folders:
    """Postings by the folders of terms in some role; a number per folder and role."""

    index: LexicalIndex
    used: list[tuple[int, tuple[bool, ...]]]

    def any(self, role: int) -> bool:
        return any(roles[role] for _, roles in self.used)

    def __call__(self, role: int) -> DataFrame:
        return self._in([bucket for bucket, roles in self.used if roles[role]])

    def every(self) -> DataFrame:
        return self._in([bucket for bucket, _ in self.used])

    def _in(self, buckets: list[int]) -> DataFrame:
        posted = self.index.postings
        return posted.where(F.col("bucket").isin(buckets)) if self.index.buckets else posted


def _folders(index: LexicalIndex, terms: DataFrame, *roles: Column) -> _Folders:
    """The folders of all terms with the roles that their terms have, in one job."""
    bucket = term_bucket(F.col("term"), index.buckets) if index.buckets else F.lit(0)
    rows = (
        terms.select(bucket.alias("bucket"), *(r.alias(f"_{i}") for i, r in enumerate(roles)))
        .groupBy("bucket").agg(*(F.bool_or(f"_{i}") for i in range(len(roles)))).collect()
    )
    return _Folders(index, [(row[0], tuple(row[1:])) for row in rows])


def _matched_terms(
    index: LexicalIndex, queries: DataFrame, min_share: float, *more: str
) -> DataFrame:
    """``(query_id, chunk_id, n_terms, needed, term, df, tf, dl)`` and columns ``more``
    of the postings, one row per matched term of every candidate.

    The query plans and the lookups of the candidates are written to the scratch
    folder, computed once and measured. One job tells which folders are read. Small lookups are shipped to the postings
    scan. Otherwise the postings are first reduced to about the candidate chunks, by
    bitmaps of their hashed ids, and then both sides are shuffled.
    """
    plans = land(_plans_of_queries(index, queries, min_share), "query-plans")
    hits = F.lit(1) if min_share == 1 else F.ceil(F.col("needed") / 3).cast("int")
    n_probes = (F.size("known") - F.col("needed") + hits).cast("int")
    terms = plans.select(
        "query_id", hits.alias("hits"), n_probes.alias("_probes"), F.col("known")[0]["df"].alias("_least"),
        F.posexplode("known").alias("_place", "_known"),
    ).select("query_id", "hits", "_probes", "_least", "_place", "_known.term", "_known.df")
    is_probe = F.col("_place") < F.col("_probes")
    # The next rarest term thins many candidates out before all terms are looked up.
    is_second = (F.col("_place") == 1) & (F.col("_least") > THIN_FROM) & F.lit(min_share == 1)
    folders = _folders(index, terms, is_probe, is_second)
    probes = terms.where(is_probe).select("query_id", "hits", "term", "df")
    probed = folders(0).select("term", "chunk_id")
    found = _by_term(probed, probes).select("query_id", "chunk_id", "hits")
    if folders.any(1):
        second = terms.where(is_second).select("query_id", "term")
        wanted = found.select("query_id", "chunk_id").join(second, "query_id", "left")
        held = folders(1).select("term", "chunk_id", F.lit(True).alias("_held"))
        found = (
            wanted.join(held, ["chunk_id", "term"], "left")
            .where("term IS NULL OR _held")
            .select("query_id", "chunk_id")
        )
    if min_share < 1:
        # Several probes of a query may meet in the same chunk.
        found = (
            found.groupBy("query_id", "chunk_id", "hits")
            .agg(F.count(F.lit(1)).alias("_hit"))
            .where(F.col("_hit") >= F.col("hits"))
        )
    found = found.select("query_id", "chunk_id")
    lookups = found.join(plans, "query_id").select(
        "query_id", "chunk_id", "n_terms", "needed", F.explode("known").alias("_known")
    ).select("query_id", "chunk_id", "n_terms", "needed", "_known.term", "_known.df")
    lookups = land(lookups, "lookups")
    posted = folders.every().select("term", "chunk_id", "tf", "dl", *more)
    if fits_broadcast(lookups):
        return posted.join(F.broadcast(lookups), ["chunk_id", "term"])
    # A bit or more per chunk keeps nearly all others out; only the bits are sent.
    n_bits = 16 * max(1, lookups.select(F.approx_count_distinct("chunk_id")).first()[0])
    bit = F.pmod(F.xxhash64("chunk_id"), F.lit(n_bits))
    maps = land(bitmaps(lookups.select(bit.alias("no"))), "candidates")
    if fits_broadcast(maps):
        posted = with_bit(posted.withColumn("no", bit), F.broadcast(maps)).drop("no")
    return lookups.join(posted, ["chunk_id", "term"])


def _by_term(posted: DataFrame, probes: DataFrame) -> DataFrame:
    """Postings of the probed terms. The postings of a term with very many are cut
    into parts by chunk, and its probes are repeated once per part."""
    parts = F.ceil(F.col("df") / skew.ROWS_PER_TASK).cast("int")
    hot = probes.where(F.col("df") > skew.ROWS_PER_TASK).select("term", parts.alias("_parts"))
    many = posted.join(broadcast_if_small(hot.distinct()), "term", "left").withColumn(
        "_part",
        F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.coalesce("_parts", F.lit(1))), F.lit(0)),
    )
    each = probes.withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(parts, F.lit(1)).cast("bigint") - 1))
    )
    return many.drop("_parts").join(each, ["term", "_part"])


def all_terms_match(index: LexicalIndex, queries: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Chunks that hold every term of the query (or ``min_share`` of them):
    ``(query_id, chunk_id, n_terms, n_matched)``. A query without terms matches
    nothing. Runs two jobs: the query plans and the lookups."""
    return (
        _matched_terms(index, queries, min_share)
        .groupBy("query_id", "chunk_id", "n_terms", "needed")
        .agg(F.count(F.lit(1)).cast("int").alias("n_matched"))
        .where(F.col("n_matched") >= F.col("needed"))
        .drop("needed")
    )


def lexical_topk(
    index: LexicalIndex,
    queries: DataFrame,
    k: int,
    *,
    k1: float = 1.2,
    b: float = 0.75,
    min_share: float = 1.0,
) -> DataFrame:
    """BM25 over the matching chunks, k best per query:
    ``(query_id, chunk_id, score, rank)``.

    Okapi BM25 with idf ``ln(1 + (N - df + 0.5) / (df + 0.5))`` (Robertson and
    Zaragoza 2009). Equal scores are ordered by chunk id.
    """
    n_chunks = index.totals.select("n_chunks").scalar()
    avg_dl = index.totals.select("avg_dl").scalar()
    idf = F.log(1.0 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / avg_dl)
    scored = (
        _matched_terms(index, queries, min_share)
        .withColumn("_part", idf * F.col("tf") * (k1 + 1.0) / damped)
        .groupBy("query_id", "chunk_id", "needed")
        .agg(F.sum("_part").alias("_sum"), F.count(F.lit(1)).alias("_matched"))
        .where(F.col("_matched") >= F.col("needed"))
        .select("query_id", "chunk_id", F.round("_sum", SCORE_DIGITS).alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def any_term_topk(
    index: LexicalIndex, queries: DataFrame, k: int, *, min_share: float = 0.5, **bm25: float
) -> DataFrame:
    """``lexical_topk`` with a share of the terms as the condition: long
    questions seldom have a chunk with all their terms."""
    return lexical_topk(index, queries, k, min_share=min_share, **bm25)


def proximity_topk(
    index: LexicalIndex, queries: DataFrame, k: int, *, min_share: float = 1.0
) -> DataFrame:
    """Matching chunks by how near their matched terms stand to each other, k best
    per query: ``(query_id, chunk_id, n_covers, score, rank)``. The index has to hold
    positions.

    A cover is a run of tokens that holds every matched term and no smaller such run.
    The score is the sum over all covers of terms by length, so terms side by side
    count one, and terms far apart next to nothing (cover density, Clarke, Cormack and
    Tudhope 2000). Equal scores are ordered by chunk id. A chunk's covers are found in
    one pass over the places of the query's terms in it.
    """
    if "positions" not in index.postings.columns:
        raise ValueError("the index has no positions")
    matched = (
        _matched_terms(index, queries, min_share, "positions")
        .groupBy("query_id", "chunk_id", "needed")
        .agg(F.collect_list("positions").alias("_places"))
        .where(F.size("_places") >= F.col("needed"))
    )
    places = F.transform(
        "_places", lambda at, term: F.transform(at, lambda p: F.struct(p.alias("at"), term.alias("term")))
    )
    # Last place of each term so far; the earliest of them begins a run that ends
    # here, and the run is a cover if that beginning is new.
    start = F.struct(
        F.transform("_places", lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begin"),
        F.lit(0).alias("n"), F.lit(0.0).alias("sum"),
    )

    def step(seen: Column, here: Column) -> Column:
        last = F.transform(seen["last"], lambda x, i: F.when(i == here["term"], here["at"]).otherwise(x))
        begin = F.array_min(last)
        new = begin > seen["begin"]
        part = F.size(seen["last"]).cast("double") / (here["at"] - begin + 1)
        return F.struct(
            last.alias("last"), begin.alias("begin"),
            (seen["n"] + F.when(new, 1).otherwise(0)).alias("n"),
            (seen["sum"] + F.when(new, part).otherwise(0.0)).alias("sum"),
        )

    covers = F.aggregate(F.array_sort(F.flatten(places)), start, step)
    scored = matched.select("query_id", "chunk_id", covers.alias("_c")).select(
        "query_id", "chunk_id", F.col("_c.n").alias("n_covers"), F.round("_c.sum", SCORE_DIGITS).alias("score")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
