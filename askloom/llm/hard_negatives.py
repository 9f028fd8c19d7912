"""Hard negatives by a multiway hyperplane tree with range tables.

A node of the tree has several split points; each vector goes to its closest one.
The node stores, for every split point and every subtree, the least and the
greatest distance between them. A search asks for an annulus around the anchor: a
subtree is left out as soon as the distances from one split point that its range
allows and those that the annulus allows don't meet. Leaves are compared exactly.

Inner products become distances by one more coordinate that gives all stored
vectors the same length; the anchor has zero there. So a window of scores is an
annulus, however long the vectors are.

The root's subtrees are cut into parts of bounded size, also a subtree of equal
vectors. Anchors travel to the parts that may hold answers, in blocks; a task holds
the tree of one part and one block of anchors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.common import ROW, arrow_schema
from askloom.session import land

#: Rows of a part, split points of a node and of the root at most, rows of a leaf.
PART_ROWS = 8192
SPLITS, ROOT_SPLITS = 16, 64
LEAF_ROWS = 512
#: Rows of the sample from which the root's split points and first bounds come, at
#: most, and bytes of the sample and of a block of anchors.
SAMPLE_ROWS = 2048
SAMPLE_BYTES = 8 << 20
BLOCK_BYTES = 2 << 20
#: Scores compared at once.
_AT_ONCE = 1 << 21
_NO_ID = np.int64((1 << 63) - 1)
_MESSAGE = "part int, kind int, payload binary"


@dataclass
class Vectors:
    """Rows in order of their ids (null last): whole-number vectors with labels."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.row[at], self.id[at], self.label[at], self.v[at])

    def ordered(self) -> Vectors:
        return self.take(np.lexsort((self.row, self.id)))

    def dump(self) -> bytes:
        head = np.array([len(self), self.v.shape[1]], "<i8").tobytes()
        return head + b"".join(x.astype("<i8").tobytes() for x in (self.row, self.id, self.label, self.v))

    @classmethod
    def load(cls, data: bytes) -> tuple[Vectors, bytes]:
        """Vectors, and what is written after them."""
        n, width = np.frombuffer(data, "<i8", 2).tolist()
        every = np.frombuffer(data, "<i8", n * (3 + width), 16)
        v = every[3 * n :].reshape(n, width)
        return cls(every[:n], every[n : 2 * n], every[2 * n : 3 * n], v), data[16 + every.nbytes :]

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, width: int) -> Vectors:
        """From columns ``ROW, vec_id, label, v``; shorter vectors end in zeros."""
        lists = batch.column("v")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        v = np.zeros((len(lists), width), np.int64)
        v[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return cls(
            batch.column(ROW).to_numpy(), batch.column("vec_id").fill_null(int(_NO_ID)).to_numpy(),
            batch.column("label").to_numpy().astype(np.int64), v,
        )


@dataclass
class Wanted:
    """Windows of scores: for anchor ``of[i]``, the ``k`` best from ``low[i]`` to
    ``high[i]`` among rows of its own label (itself left out) or of another. ``number``
    tells the windows of an anchor apart."""

    anchors: Vectors
    of: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool

    def __post_init__(self):
        self.best = np.full((len(self.of), self.k), -np.inf)
        self.id = np.full((len(self.of), self.k), _NO_ID)
        self.row = np.full((len(self.of), self.k), -1, np.int64)

    def take(self, at: np.ndarray) -> Wanted:
        used, of = np.unique(self.of[at], return_inverse=True)
        return Wanted(self.anchors.take(used), of, self.number[at], self.low[at], self.high[at], self.k, self.same)

    def dump(self) -> bytes:
        return self.anchors.dump() + np.concatenate([self.of, self.number, self.low, self.high]).astype("<f8").tobytes()

    @classmethod
    def load(cls, data: bytes, k: int, same: bool) -> Wanted:
        anchors, rest = Vectors.load(data)
        of, number, low, high = np.frombuffer(rest, "<f8").reshape(4, -1)
        return cls(anchors, of.astype(np.int64), number.astype(np.int64), low.copy(), high.copy(), k, same)

    def compare(self, which: np.ndarray, rows: Vectors) -> None:
        """Exact comparison of some windows with rows that are in order of ids."""
        for a in range(0, len(which), step := max(1, _AT_ONCE // max(1, len(rows)))):
            some = which[a : a + step]
            used, of = np.unique(self.of[some], return_inverse=True)
            mine = self.anchors.take(used)
            scores = products(mine.v, rows.v)
            fit = mine.label[:, None] == rows.label
            if self.same:
                fit &= mine.row[:, None] != rows.row
            else:
                fit = ~fit
            scores[~fit] = -np.inf
            scores = scores[of]
            scores[(scores < self.low[some, None]) | (scores > self.high[some, None])] = -np.inf
            line = np.arange(len(some))
            found, places = [], []
            for _ in range(min(self.k, len(rows))):
                at = scores.argmax(1)  # of equal scores the first, which has the least id
                found.append(scores[line, at])
                places.append(at)
                scores[line, at] = -np.inf
            if found:
                self._add(some, np.stack(found, 1), rows, np.stack(places, 1))

    def _add(self, some: np.ndarray, found: np.ndarray, rows: Vectors, places: np.ndarray) -> None:
        best = np.concatenate([self.best[some], found], 1)
        ids = np.concatenate([self.id[some], rows.id[places]], 1)
        row = np.concatenate([self.row[some], rows.row[places]], 1)
        order = np.lexsort((row, ids, -best), axis=-1)[:, : self.k]
        self.best[some] = np.take_along_axis(best, order, 1)
        self.id[some] = np.take_along_axis(ids, order, 1)
        self.row[some] = np.take_along_axis(row, order, 1)
        # Less than the last of k is not asked for any more; as much may win by its id.
        self.low[some] = np.maximum(self.low[some], self.best[some, -1])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, as doubles."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    raise ValueError("scores of 2^53 and more are not exact")


def lifted(v: np.ndarray, length2: float) -> np.ndarray:
    """Vectors with one more coordinate, after which all have the squared length."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, length2 - (v * v).sum(1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)))


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Places of up to ``most`` different points, each far from those before it."""
    chosen = [0]
    near = distances(points, points[:1])[:, 0]
    while len(chosen) < most and near.max() > 1e-6 * (1.0 + np.abs(points).max()):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


@dataclass
class Ranges:
    """Split points of a node with the distances from each (row) to each subtree
    (column); a subtree without vectors has an empty range."""

    points: np.ndarray
    least: np.ndarray
    most: np.ndarray
    length2: float

    def open_to(self, wanted: Wanted, which: np.ndarray) -> np.ndarray:
        """Whether a subtree may hold an answer, for each of the windows."""
        used, of = np.unique(wanted.of[which], return_inverse=True)
        v = wanted.anchors.v[used].astype(np.float64)
        squared = ((v * v).sum(1) + self.length2)[of]
        slack = 1e-6 * (1.0 + np.sqrt(squared))
        near = np.sqrt(np.maximum(0.0, squared - 2.0 * wanted.high[which])) - slack
        far = np.sqrt(np.maximum(0.0, squared - 2.0 * wanted.low[which])) + slack
        anchors = np.column_stack([v, np.zeros(len(v))])
        to_points = distances(anchors, self.points)[of]
        open_ = np.repeat((self.least <= self.most).any(0)[None], len(which), 0)
        for i in range(len(self.points)):
            d = to_points[:, i]
            low = np.maximum(d - far, near - d)[:, None]
            open_ &= (self.most[i] >= low) & (self.least[i] <= (d + far)[:, None])
        return open_


class Tree:
    """A part's vectors; leaves are ranges of ``rows``."""

    def __init__(self, rows: Vectors, leaf: int = LEAF_ROWS, splits: int = SPLITS, seed: int = 0):
        v = rows.v.astype(np.float64)
        self.rows, self.leaf, self.splits = rows, leaf, splits
        self.length2 = float((v * v).sum(1).max(initial=0.0))
        self.lifted = lifted(rows.v, self.length2)
        self.rng = np.random.default_rng(seed)
        self.compared = 0
        self.root = self._grow(np.arange(len(rows)))

    def _grow(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        sample = self.rng.choice(at, min(len(at), 3 * self.splits), replace=False)
        points = self.lifted[sample][far_apart(self.lifted[sample], self.splits)]
        if len(points) == 1:  # equal vectors, as far as can be seen
            return at
        d = distances(self.lifted[at], points)
        cell = d.argmin(1)
        parts = [np.flatnonzero(cell == j) for j in range(len(points))]
        least = np.stack([d[p].min(0, initial=np.inf) for p in parts], 1)
        most = np.stack([d[p].max(0, initial=-np.inf) for p in parts], 1)
        if max(map(len, parts)) == len(at):
            return at
        return Ranges(points, least, most, self.length2), [self._grow(at[p]) for p in parts]

    def search(self, wanted: Wanted) -> None:
        stack = [(self.root, np.arange(len(wanted.of)), None)]
        while stack:
            node, which, check = stack.pop()
            if check is not None:  # bounds may have moved since the node was put off
                ranges, j = check
                which = which[ranges.open_to(wanted, which)[:, j]]
            if not len(which):
                continue
            if isinstance(node, np.ndarray):
                for a in range(0, len(node), self.leaf):
                    part = node[a : a + self.leaf]
                    self.compared += len(which) * len(part)
                    wanted.compare(which, self.rows.take(part))
                continue
            ranges, children = node
            may = ranges.open_to(wanted, which)
            # The subtree that most windows are open to is searched first.
            for j in np.argsort(may.sum(0), kind="stable").tolist():
                if may[:, j].any():
                    stack.append((children[j], which[may[:, j]], (ranges, j)))


# --------------------------------------------------------------------------
# the same over a cluster


@dataclass
class Root:
    """Split points of the root, parts of each of its subtrees, and a sample of the
    rows, whose scores are the first bounds."""

    width: int
    ranges: Ranges
    parts: np.ndarray
    sample: Vectors

    def cells(self, v: np.ndarray) -> np.ndarray:
        return distances(lifted(v, self.ranges.length2), self.ranges.points)


def usable(rows: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: vectors as whole numbers, ``floor(scale * x)``. Rows
    without label or vector, or with a null or non-finite component, are left out."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col("label").isNotNull() & x.isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"),
    )


def plant(stored: DataFrame, part_rows: int = PART_ROWS) -> Root:
    """The root for numbered vectors. Runs three jobs; fetches a bounded sample and
    the range table of the root."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    seen = stored.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("length2")
    ).first()
    width, length2 = max(1, seen["width"] or 0), float(seen["length2"] or 0.0)
    if length2 >= 2.0**53:
        raise ValueError("scores of 2^53 and more are not exact")
    length2 *= 1.0 + 1e-9
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    sample = Vectors.of(stored.orderBy(F.xxhash64(ROW), ROW).limit(most).toArrow(), width).ordered()
    points = lifted(sample.v, length2)
    m = max(1, min(ROOT_SPLITS, -(-seen["n"] // part_rows)))
    points = points[far_apart(points, m)] if len(points) else np.zeros((1, width + 1))
    empty = Ranges(points, np.empty((0, 0)), np.empty((0, 0)), length2)
    root = Root(width, empty, np.ones(len(points), np.int64), sample)
    schema = "cell int, point int, n long, least double, most double"
    types = arrow_schema(stored, schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = root.cells(Vectors.of(batch, width).v)
            cell = d.argmin(1)
            for j in np.unique(cell).tolist():
                mine = d[cell == j]
                k = mine.shape[1]
                columns = [[j] * k, range(k), [len(mine)] * k, mine.min(0), mine.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    table = (
        stored.mapInArrow(measure, schema).groupBy("cell", "point")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    )
    root.ranges.least = np.full((len(points), len(points)), np.inf)
    root.ranges.most = np.full((len(points), len(points)), -np.inf)
    for r in table:
        root.ranges.least[r["point"], r["cell"]] = r["least"]
        root.ranges.most[r["point"], r["cell"]] = r["most"]
        root.parts[r["cell"]] = max(1, -(-r["n"] // part_rows))
    return root


def search(stored: DataFrame, root: Root, wanted: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor_row, window, score, found_row, found_id``: for each window,
    what each part has found, some ``k`` of which are the best.

    ``wanted`` has the columns of ``stored`` and ``low, high``, arrays of doubles
    with a window's bounds in each place; ``window`` is its place.
    """
    offset = np.concatenate([[0], np.cumsum(root.parts)])
    block = max(64, BLOCK_BYTES // (8 * root.width))
    width = root.width
    answer = "anchor_row long, window int, score long, found_row long, found_id long"
    message, answers = arrow_schema(stored, _MESSAGE), arrow_schema(stored, answer)

    def rows_of(made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], f.type) for i, f in enumerate(message)], schema=message
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Vectors.of(batch, width)
            if not len(rows):
                continue
            cell = root.cells(rows.v).argmin(1)
            # Equal vectors share a cell, so its parts are dealt by row.
            spread = (rows.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = offset[cell] + (spread % root.parts[cell].astype(np.uint64)).astype(np.int64)
            yield rows_of([(p, 0, rows.take(np.flatnonzero(part == p)).dump()) for p in np.unique(part).tolist()])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, block):
                batch = whole.slice(a, block)
                low, high = batch.column("low"), batch.column("high")
                of = np.repeat(np.arange(batch.num_rows), low.value_lengths().to_numpy(zero_copy_only=False))
                bounds = [x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (low, high)]
                number = np.arange(len(of)) - np.searchsorted(of, of)
                asked = Wanted(Vectors.of(batch, width), of, number, bounds[0].copy(), bounds[1], k, same)
                every = np.arange(len(of))
                for b in range(0, len(root.sample), LEAF_ROWS):
                    asked.compare(every, root.sample.take(np.arange(b, min(len(root.sample), b + LEAF_ROWS))))
                may = root.ranges.open_to(asked, every)
                for j in np.flatnonzero(may.any(0)).tolist():
                    payload = asked.take(np.flatnonzero(may[:, j])).dump()
                    yield rows_of([(int(p), 1, payload) for p in range(offset[j], offset[j + 1])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, at = [], None, None
        for batch in batches:
            for part, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part != at:
                    held, tree, at = [], None, part
                if kind == 0:
                    held.append(Vectors.load(payload)[0])
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    joined = [np.concatenate([getattr(h, f) for h in held]) for f in ("row", "id", "label", "v")]
                    tree, held = Tree(Vectors(*joined).ordered(), seed=part), []
                asked = Wanted.load(payload, k, same)
                tree.search(asked)
                window, place = np.nonzero(asked.best > -np.inf)
                columns = [
                    asked.anchors.row[asked.of[window]], asked.number[window],
                    asked.best[window, place].astype(np.int64),
                    asked.row[window, place], asked.id[window, place],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c).cast(f.type) for c, f in zip(columns, answers)], schema=answers
                )

    parts = int(offset[-1])
    sent = stored.mapInArrow(deal, _MESSAGE).unionByName(wanted.mapInArrow(send, _MESSAGE))
    return (
        sent.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(meet, answer)
    )


def mine(
    rows: DataFrame,
    *,
    label: Column | None = None,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``
    from ``vec_id, embedding, label``.

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives
    are the best other rows of its label; its hard negatives for a positive are the
    best rows of other labels whose score is within ``percent`` of the positive's.
    A score is the inner product of the whole-number vectors; ties go to the smaller
    id, a null one last, and then to the row stored first.

    Rows without label, vector or a finite number in each place take no part. Rows
    that repeat an id stay rows of their own, also as anchors; a null id is no
    anchor's (2^63 - 1 is read as null). Shorter vectors count as ending in zeros;
    vectors whose squared length reaches 2^53 are refused. A positive with a score
    below zero has no negatives. Other columns are ignored. Runs jobs for the root
    of the tree and to store vectors and positives.
    """
    stored = land(usable(rows, label).withColumn(ROW, F.monotonically_increasing_id()), "vectors")
    root = plant(stored, part_rows)
    anchors = stored.where(F.col("vec_id") % every == 0)
    whole = [F.array(F.lit(x)).alias(n) for n, x in (("low", float("-inf")), ("high", float("inf")))]
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "found_id", "found_row")
    near = search(stored, root, anchors.select("*", *whole), positives, same=True)
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    by_score = Window.partitionBy("anchor_row").orderBy("score")
    near = land(
        near.where("score >= 0").select(
            "anchor_row", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"),
            (F.dense_rank().over(by_score) - 1).alias("window"),
        ),
        "positives",
    )
    least, most = percent
    bounds = near.groupBy("anchor_row").agg(F.array_sort(F.collect_set("positive_score")).alias("_s")).select(
        F.col("anchor_row").alias(ROW),
        F.transform("_s", lambda s: (s * least + F.pmod(-s * least, F.lit(100))).cast("double") / 100).alias("low"),
        F.transform("_s", lambda s: (s * most - s * most % 100).cast("double") / 100).alias("high"),
    )
    far = search(stored, root, anchors.join(bounds, ROW), negatives, same=False)
    best = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "found_id", "found_row")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col(ROW).alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    known = [F.nullif(F.col(n), F.lit(int(_NO_ID))).alias(m) for n, m in (("positive_id", "positive_id"), ("found_id", "negative_id"))]
    return (
        near.join(far, ["anchor_row", "window"]).join(named, "anchor_row")
        .select("anchor_id", known[0], F.col("rank").cast("int").alias("rank"), known[1],
                "positive_score", F.col("score").alias("negative_score"))
    )


def changed_label(labels: int = 10) -> Column:
    """Labels of which those of every seventh id are moved on by one."""
    label, vec = F.col("label").cast("long"), F.col("vec_id")
    return F.when(vec % 7 == 0, (label + 1) % labels).otherwise(label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n
  ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
