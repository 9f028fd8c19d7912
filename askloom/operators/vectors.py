"""Embedding and nearest-neighbour search for whole tables of queries.

Tables: ``chunks(chunk_id, embedding, ...)`` and ``queries(query_id, embedding)``.

An exact search has to compare every query with every chunk, but it need not
produce a row per comparison: each task multiplies its Arrow batches with the
query matrix and keeps only the k best chunks per query, so what is shuffled is
k rows per query and task, whatever the corpus size.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.text import simple_tokens

#: Distances are ranked after rounding, so that equal vectors tie exactly.
DISTANCE_DIGITS = 9
#: Most queries whose vectors are shipped to every task (384 floats each: 12 MB).
MAX_SHIPPED_QUERIES = 8192
#: Bytes of query vectors that are shipped to every task, at most.
MAX_SHIPPED_BYTES = 64 << 20
#: Chunks per cell when the query table is too large to ship.
GRID_CHUNKS = 65_536
# Queries multiplied at once; bounds the distance block held by one task.
_QUERY_SLICE = 512
# Scores of vectors against centroids held at once.
_SCORES_AT_ONCE = 4_000_000

# Functions of this module travel to the tasks by value, so that executors need
# not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Encoder = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


# --------------------------------------------------------------------------
# embedding


def hash_buckets(text: Column, dim: int) -> Column:
    """Bucket of every token: the first 32 bits of its MD5, modulo ``dim``."""
    return F.transform(
        simple_tokens(text),
        lambda token: (
            F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % F.lit(dim)
        ).cast("int"),
    )


def _bucket_vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Unit vectors of bucket counts, one row per list of buckets."""
    lists = batch.column("_buckets")
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), lengths)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    counts = np.bincount(rows * dim + flat, minlength=len(lists) * dim).reshape(-1, dim)
    counts = counts.astype(np.float64)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def _float_lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    values = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def embed_text(
    df: DataFrame, text: str = "text", *, encoder: Encoder | None = None, dim: int = 384
) -> DataFrame:
    """Add ``embedding`` (array of ``dim`` floats) to a table.

    ``encoder`` is a function over an iterator of Arrow batches, so a model is
    loaded once per Python worker; it returns each batch with the column
    appended. Without one, vectors are hashed term frequencies of unit length;
    the hashing itself runs in the JVM.
    """
    out = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    if encoder is not None:
        return df.mapInArrow(encoder, out)

    names = df.columns

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _float_lists(_bucket_vectors(batch, dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names] + [vectors], names=[*names, "embedding"]
            )

    return df.withColumn("_buckets", hash_buckets(F.col(text), dim)).mapInArrow(hashed, out)


# --------------------------------------------------------------------------
# exact and cell-restricted search


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; a missing vector becomes zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if lists.null_count:
        present = lists.is_valid().to_numpy(zero_copy_only=False)
        filled = np.zeros((len(lists), dim))
        if present.any():
            filled[present] = _matrix(lists.drop_null(), dim)
        return filled
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and not (lengths == dim).all():
        wrong = int(lengths[lengths != dim][0])
        raise ValueError(f"embedding of width {wrong} among vectors of width {dim}")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length; a zero row becomes NaN, as it has no direction."""
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


class _Best:
    """The k nearest chunks seen so far for every query."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.bar = np.full(n_queries, np.inf)  # distance of the k-th best
        self.query = np.empty(0, dtype=np.int64)
        self.dist = np.empty(0)
        self.chunk = np.empty(0, dtype=object)

    def offer(self, query: np.ndarray, dist: np.ndarray, chunk: np.ndarray) -> None:
        if not len(query):
            return
        query = np.concatenate([self.query, query])
        dist = np.concatenate([self.dist, dist])
        chunk = np.concatenate([self.chunk, chunk])
        _, id_rank = np.unique(chunk, return_inverse=True)
        order = np.lexsort((id_rank, dist, query))
        query, dist, chunk = query[order], dist[order], chunk[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        keep = place < self.k
        self.query, self.dist, self.chunk = query[keep], dist[keep], chunk[keep]
        full = place[keep] == self.k - 1
        self.bar[self.query[full]] = self.dist[full]

    def offer_block(
        self, distances: np.ndarray, queries: np.ndarray, chunk_ids: np.ndarray
    ) -> None:
        """A block of distances, one row per query and one column per chunk."""
        k = self.k
        bar = self.bar[queries][:, None]
        if distances.shape[1] > k:
            own = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
            bar = np.minimum(bar, own)
        row, col = np.nonzero(distances <= bar)
        self.offer(queries[row], distances[row, col], chunk_ids[col])


def _distances(queries: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Rounded cosine distances; pairs with a zero vector come out infinite."""
    with np.errstate(invalid="ignore"):
        raw = np.round(1.0 - queries @ chunks.T, DISTANCE_DIGITS)
    return np.where(np.isnan(raw), np.inf, raw)


def _answer(best: _Best, query_ids: np.ndarray, types: list[pa.DataType]) -> pa.RecordBatch:
    finite = np.isfinite(best.dist)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids[best.query].tolist(), type=types[0]),
            pa.array(best.chunk.tolist(), type=types[1]),
            pa.array(best.dist, mask=~finite, type=pa.float64()),
        ],
        names=["query_id", "chunk_id", "distance"],
    )


def _scan_batch(
    best: _Best,
    batch: pa.RecordBatch | pa.Table,
    queries: np.ndarray,
    probes: np.ndarray | None,
) -> None:
    chunk_ids = np.array(batch.column("chunk_id").to_pylist(), dtype=object)
    vectors = _unit_rows(_matrix(batch.column("embedding"), queries.shape[1]))
    if probes is None:
        groups = [(np.arange(len(queries)), slice(None))]
    else:
        cells = np.asarray(batch.column("cell").to_pylist())
        groups = [
            (np.nonzero((probes == cell).any(axis=1))[0], cells == cell)
            for cell in np.unique(cells)
        ]
    for wanted, members in groups:
        for start in range(0, len(wanted), _QUERY_SLICE):
            part = wanted[start : start + _QUERY_SLICE]
            best.offer_block(_distances(queries[part], vectors[members]), part, chunk_ids[members])


def _out_schema(chunks: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in schema.fields[:2]]


def _rank_nearest(candidates: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(
        F.col("distance").asc_nulls_last(), F.col("chunk_id")
    )
    return candidates.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    max_shipped: int,
    grid_chunks: int,
    probe_column: str | None,
) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    columns = ["query_id", "embedding"] + ([probe_column] if probe_column else [])
    asked = queries.select(*columns).where(F.col("embedding").isNotNull())
    schema = _out_schema(chunks, queries)
    types = _arrow_types(schema)
    corpus = chunks.select("chunk_id", "embedding", *(["cell"] if probe_column else []))

    shipped = asked.limit(max_shipped + 1).toArrow()
    # Bounded in rows and in bytes.
    if shipped.num_rows > max_shipped or shipped.nbytes > MAX_SHIPPED_BYTES:
        if probe_column is None:
            found = _stream_search(corpus, asked, k, grid_chunks, schema)
        else:
            found = _grid_search(corpus, asked, k, max_shipped, grid_chunks, probe_column, schema)
        return _rank_nearest(found, k)
    if shipped.num_rows == 0:
        return _rank_nearest(queries.sparkSession.createDataFrame([], schema), k)

    dim = len(shipped.column("embedding")[0])
    query_ids = np.array(shipped.column("query_id").to_pylist(), dtype=object)
    matrix = _unit_rows(_matrix(shipped.column("embedding"), dim))
    probes = np.array(shipped.column(probe_column).to_pylist()) if probe_column else None
    if probes is not None:
        # Reaches the scan: only the cells that some query probes are read.
        corpus = corpus.where(F.col("cell").isin([int(c) for c in np.unique(probes)]))
    sent = queries.sparkSession.sparkContext.broadcast((query_ids, matrix, probes))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, wanted = sent.value
        best = _Best(len(ids), k)
        for batch in batches:
            _scan_batch(best, batch, vectors, wanted)
        yield _answer(best, ids, types)

    return _rank_nearest(corpus.mapInArrow(nearest, schema), k)


def _stream_search(corpus: DataFrame, asked: DataFrame, k: int, part_chunks: int, schema: T.StructType) -> DataFrame:
    """Queries beyond the shipping bound: chunks are cut into parts, each shuffled once,
    and the queries go to every part. In a task the chunks of a part come first and
    stay; the queries pass by in batches, so their number is not bounded by memory.
    Half-size targets leave room for uneven hashing."""
    parts = max(1, math.ceil(2 * corpus.count() / part_chunks))
    types = _arrow_types(schema)
    names = [f.name for f in schema]
    held = corpus.select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"),
        "chunk_id", F.lit(None).cast(schema["query_id"].dataType).alias("query_id"), "embedding",
    )
    passing = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"),
        F.lit(None).cast(schema["chunk_id"].dataType).alias("chunk_id"), "query_id", "embedding",
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []
        for batch in batches:
            part, kind = (batch.column(n).to_numpy() for n in ("part", "kind"))
            borders = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *borders], [*borders, len(part)]):
                if a == b:
                    continue
                if part[a] != at:
                    at, ids, vectors = part[a], [], []
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    lists = rows.column("embedding")
                    width = len(lists.drop_null()[0]) if lists.null_count < len(lists) else 0
                    ids += rows.column("chunk_id").to_pylist()
                    vectors.append(_unit_rows(_matrix(lists, width)))
                elif ids:
                    yield _passing_queries(rows, ids, vectors, k, types)

    sent = held.unionByName(passing).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return sent.mapInArrow(meet, schema).select(*names)


def _passing_queries(
    rows: pa.RecordBatch, ids: list, vectors: list[np.ndarray], k: int, types: list[pa.DataType]
) -> pa.RecordBatch:
    """Answers of a part, whose vectors come in blocks, to a batch of queries."""
    dim = len(rows.column("embedding")[0])
    queries = _unit_rows(_matrix(rows.column("embedding"), dim))
    best, chunk_ids, first = _Best(len(queries), k), np.array(ids, dtype=object), 0
    for block in vectors:
        block = block if block.shape[1] else np.full((len(block), dim), np.nan)
        if block.shape[1] != dim:
            raise ValueError(f"embedding of width {block.shape[1]} among vectors of width {dim}")
        for start in range(0, len(queries), _QUERY_SLICE):
            part = np.arange(start, min(len(queries), start + _QUERY_SLICE))
            best.offer_block(_distances(queries[part], block), part, chunk_ids[first : first + len(block)])
        first += len(block)
    return _answer(best, np.array(rows.column("query_id").to_pylist(), dtype=object), types)


def _grid_search(
    corpus: DataFrame,
    asked: DataFrame,
    k: int,
    block_queries: int,
    block_chunks: int,
    probe_column: str,
    schema: T.StructType,
) -> DataFrame:
    """Queries beyond the shipping bound, with cells: both sides are cut into blocks
    that meet in bounded tasks. Chunks go only to the query blocks that probe their
    cell, and queries only to the chunk blocks of the cells that they probe. Half-size
    targets leave room for uneven hashing."""
    n_query_blocks = max(1, math.ceil(2 * asked.count() / block_queries))
    n_chunk_blocks = max(1, math.ceil(2 * corpus.count() / block_chunks))
    types = _arrow_types(schema)

    def block(column: Column, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    left = corpus.withColumn("chunk_block", block(F.col("chunk_id"), n_chunk_blocks))
    right = asked.withColumn("query_block", block(F.col("query_id"), n_query_blocks))
    keys = ["query_block", "chunk_block", "cell"]
    right = right.withColumn("cell", F.explode(probe_column))
    probed = right.select(F.col("cell").alias("_cell"), F.col("query_block").alias("_asked"))
    left = left.join(probed.distinct(), F.col("cell") == F.col("_cell"))
    left = left.drop("_cell").withColumnRenamed("_asked", "query_block")
    held = left.select(
        F.col("cell").alias("_cell"), F.col("query_block").alias("_asked"),
        F.col("chunk_block").alias("_held"),
    ).distinct()
    right = right.join(
        held, (F.col("cell") == F.col("_cell")) & (F.col("query_block") == F.col("_asked"))
    ).drop("_cell", "_asked").withColumnRenamed("_held", "chunk_block")
    out_names = schema.names

    def cell(chunk_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not chunk_rows.num_rows or not query_rows.num_rows:
            return pa.Table.from_batches(
                [], schema=pa.schema(list(zip(out_names, [*types, pa.float64()])))
            )
        dim = len(query_rows.column("embedding")[0])
        vectors = _unit_rows(_matrix(query_rows.column("embedding"), dim))
        probes = np.array(query_rows.column(probe_column).to_pylist())
        best = _Best(len(vectors), k)
        for batch in chunk_rows.to_batches(max_chunksize=8192):
            _scan_batch(best, batch, vectors, probes)
        ids = np.array(query_rows.column("query_id").to_pylist(), dtype=object)
        return pa.Table.from_batches([_answer(best, ids, types)])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def vector_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    max_shipped: int = MAX_SHIPPED_QUERIES,
    grid_chunks: int = GRID_CHUNKS,
) -> DataFrame:
    """Exact k nearest chunks by cosine distance:
    ``(query_id, chunk_id, distance, rank)``.

    Equal distances are ordered by chunk id. A zero vector has no distance: its
    rows carry null and come last. Reads the query vectors once when called, to
    check that they may be shipped.
    """
    return _search(chunks, queries, k, max_shipped, grid_chunks, None)


# --------------------------------------------------------------------------
# approximate search


class CellIndex:
    """Centroids that split the vector space into cells."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = _unit_rows(np.asarray(centroids, dtype=np.float64))


def _nearest_cells(vectors: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """Cells of every vector, nearest first. Vectors without direction go to
    the first cells."""
    out = np.empty((len(vectors), min(count, len(centroids))), np.int64)
    # A bounded number of scores at a time, however many cells there are.
    step = max(1, _SCORES_AT_ONCE // len(centroids))
    for a in range(0, len(vectors), step):
        score = -np.nan_to_num(vectors[a : a + step] @ centroids.T, nan=-2.0)
        if out.shape[1] == 1:
            out[a : a + step, 0] = score.argmin(axis=1)
        else:
            out[a : a + step] = np.argsort(score, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def _unit(embedding: str) -> Column:
    """The vector at length one; null for a vector without direction."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.when(norm > 0, F.transform(embedding, lambda x: x.cast("double") / norm))


def fit_cells(chunks: DataFrame, n_cells: int, *, seed: int = 7) -> CellIndex:
    """Fit cell centroids with k-means over all vectors. Runs Spark jobs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = chunks.select(_unit("embedding").alias("unit")).where(F.col("unit").isNotNull())
    features = unit.select(array_to_vector("unit").alias("features"))
    features.persist()  # read once per iteration
    try:
        model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(features)
    finally:
        features.unpersist()
    return CellIndex(np.array(model.clusterCenters()))


def mean_cells(chunks: DataFrame, group: str) -> CellIndex:
    """One cell per known group, in order of the groups: its centroid is the mean
    of the group's vectors at length one. Runs a job; the driver holds a vector
    per group, so group by something that the caller knows to be few."""
    unit = chunks.select(group, _unit("embedding").alias("unit"))
    means = (
        unit.where(F.col("unit").isNotNull() & F.col(group).isNotNull())
        .select(group, F.posexplode("unit").alias("place", "x"))
        .groupBy(group, "place")
        .agg(F.avg("x").alias("x"))
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("place", "x")))["x"].alias("mean"))
        .orderBy(group)
    )
    return CellIndex(np.array([row["mean"] for row in means.collect()]))


def assign_cells(chunks: DataFrame, index: CellIndex) -> DataFrame:
    """Add ``cell``. Write the result partitioned or sorted by cell, so that a
    search reads only the cells it probes."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("cell", T.IntegerType())])
    sent = chunks.sparkSession.sparkContext.broadcast(index.centroids)
    dim = index.centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unit_rows(_matrix(batch.column("embedding"), dim))
            cells = _nearest_cells(vectors, sent.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, type=pa.int32())],
                names=[*batch.schema.names, "cell"],
            )

    return chunks.mapInArrow(assign, schema)


def _probe_cells(queries: DataFrame, index: CellIndex, nprobe: int) -> DataFrame:
    schema = T.StructType(
        [*queries.schema.fields, T.StructField("probes", T.ArrayType(T.IntegerType()))]
    )
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)
    dim = index.centroids.shape[1]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unit_rows(_matrix(batch.column("embedding"), dim))
            cells = _nearest_cells(vectors, sent.value, nprobe)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.tolist(), type=pa.list_(pa.int32()))],
                names=[*batch.schema.names, "probes"],
            )

    return queries.mapInArrow(probe, schema)


def ann_topk(
    celled_chunks: DataFrame,
    queries: DataFrame,
    k: int,
    index: CellIndex,
    nprobe: int,
    *,
    max_shipped: int = MAX_SHIPPED_QUERIES,
    grid_chunks: int = GRID_CHUNKS,
) -> DataFrame:
    """Approximate k nearest: the exact search inside the ``nprobe`` cells
    nearest to each query. With every cell probed it equals ``vector_topk``."""
    asked = _probe_cells(
        queries.select("query_id", "embedding").where(F.col("embedding").isNotNull()),
        index,
        min(nprobe, len(index.centroids)),
    )
    return _search(celled_chunks, asked, k, max_shipped, grid_chunks, "probes")
