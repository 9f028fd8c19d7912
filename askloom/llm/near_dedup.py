"""Near-duplicates by b-bit MinHash.

Every document keeps the two low bits of its minima, packed into 48 bytes, and a
hash per band of whole minima. Documents that share a band are candidates; a bit
count of their signatures, corrected for chance agreement of two bits, drops the
pairs that are far below the threshold. What remains falls into families, whose
members are compared exactly on their full shingle sets.

Documents of equal shingle sets form a class and are compared once, by their
smallest id. No pair of a group is ever a row: comparisons run as arithmetic on
blocks of members, which give one row per member and block at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import (
    ROW,
    SQL_LOWER,
    SQL_WORD,
    by_row,
    mapped,
    mix,
    numbered,
    shingle_set,
    texts,
    without,
    word_hashes,
)
from askloom.llm.graphs import connected_components, in_blocks, labels, sorted_groups
from askloom.operators.skew import spread_join
from askloom.session import land

SHINGLE_WORDS = 5
#: Minima of a signature, and low bits kept of each.
HASHES = 192
BITS = 2
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Standard errors below the threshold at which an estimate still counts.
MARGIN = 5.5
#: Members of a bucket or family that are compared at once.
BLOCK_MEMBERS = 256
#: Shingles of a family that are compared at once.
BLOCK_SHINGLES = 1_000_000


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands: the most rows for which a pair at the threshold is missed
    with a chance of ``MISS`` at most."""
    t = percent / 100
    for rows in range(16, 0, -1):
        bands = HASHES // rows
        if (1 - t**rows) ** bands <= MISS:
            return rows, bands
    return 1, HASHES


def estimate_floor(percent: int) -> float:
    """Estimated similarity below which a pair is dropped."""
    t, chance = percent / 100, 1 / (1 << BITS)
    agree = t + (1 - t) * chance
    return t - MARGIN * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a shingle set."""
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    scale = (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    shift = (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)[:, None]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(least, (scale * x[None, a : a + 1024] + shift).min(axis=1), out=least)
    return least


def low_bits(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 to a word."""
    bits = (least & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (bits << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def band_hashes(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    part = least[: rows * bands].reshape(bands, rows).astype(np.uint64)
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((part * factors).sum(axis=1, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by bit counts, corrected for lanes that agree by chance."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature, bands`` of every document."""
    rows, bands = banding(percent)

    def work(batch):
        out = {k: [] for k in ("n_shingles", "set_key", "signature", "bands")}
        for text in batch.column("text").to_pylist():
            found = shingle_set(word_hashes(words_of(text)), SHINGLE_WORDS)
            out["n_shingles"].append(len(found))
            out["set_key"].append(xxhash.xxh3_128_digest(found.tobytes()))
            least = minima(found)
            out["signature"].append(low_bits(least).tobytes())
            out["bands"].append(band_hashes(least, rows, bands).view(np.int64))
        return out | {"doc_id": batch.column("doc_id")}

    return mapped(
        texts(docs), work,
        "doc_id long, n_shingles long, set_key binary, signature binary, bands array<bigint>",
    )


_LINKS = "u long, v long"


def _emit(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    at = np.flatnonzero(label != np.arange(len(label)))
    if not len(at):
        return None
    return pa.RecordBatch.from_pydict(
        {"u": pa.array(ids[label[at]], pa.int64()), "v": pa.array(ids[at], pa.int64())}
    )


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """Links that join what shares a band and is estimated to be similar enough.
    Inside a bucket only connectivity is kept: a link per member at most."""
    floor = estimate_floor(percent)
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    crowds = (
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("bucket", F.ceil(F.col("n") / BLOCK_MEMBERS).alias("blocks"))
    )
    members = banded.join(crowds, "bucket").join(
        classes.select("id", "n_shingles", "signature"), "id"
    )

    def work(table: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        ids, n = table.column("id").to_numpy(), table.column("n_shingles").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64)
        sig = sig.reshape(len(ids), -1)
        mine, within = table.column("_mine").to_numpy(), (table.column("_i").to_numpy() == table.column("_j").to_numpy())
        label, u, v, held = np.arange(len(ids)), [], [], 0
        left = np.arange(len(ids))
        for d in range(1, len(ids)):
            left = left[left + d < len(ids)]
            left = left[group[left] == group[left + d]]
            if not len(left):
                break
            a, b = left, left + d
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            maybe = (100 * low >= percent * high) & (within[a] | (mine[a] != mine[b])) & (label[a] != label[b])
            a, b = a[maybe], b[maybe]
            near = estimate(sig[a], sig[b]) >= floor
            u.append(a[near])
            v.append(b[near])
            held += len(u[-1])
            if held > 200_000:
                label, u, v, held = _joined(label, u, v), [], [], 0
        return _emit(ids, _joined(label, u, v))

    return sorted_groups(
        in_blocks(members, "bucket", "blocks", "id"), ["bucket", "_i", "_j"], work, _LINKS
    )


def _joined(label: np.ndarray, u: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
    n = len(label)
    return labels(n, np.concatenate([np.arange(n), *u]), np.concatenate([label, *v]))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a product of incidence matrices."""
    m = len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    use = often[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((m, m), np.float64), 2048
    for a in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((m, width), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out.astype(np.int64)


def true_links(docs: DataFrame, classes: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links of family members whose full sets are similar enough; again one per
    member and block pair at most, with the same components as all links."""
    members = families.join(classes.select("id", "n_shingles"), "id")
    sizes = members.groupBy("component").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
        ).alias("blocks")
    )
    placed = members.join(sizes, "component").select(
        "id", F.col("component").alias("family"), "blocks"
    )
    held = texts(docs).join(placed, F.col("doc_id") == F.col("id")).select("id", "family", "blocks", "text")

    def sets(batch):
        return {
            "id": batch.column("id"),
            "family": batch.column("family"),
            "blocks": batch.column("blocks"),
            "shingles": [
                shingle_set(word_hashes(words_of(t)), SHINGLE_WORDS).tobytes()
                for t in batch.column("text").to_pylist()
            ],
        }

    full = mapped(held, sets, "id long, family long, blocks long, shingles binary")

    def work(table: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        label = np.arange(len(ids))
        bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            shared = shared_counts(sets[a:b])
            union = n[a:b, None] + n[None, a:b] - shared
            u, v = np.nonzero(np.triu(100 * shared >= percent * union, 1))
            label[a:b] = a + labels(b - a, u, v)
        return _emit(ids, label)

    return sorted_groups(in_blocks(full, "family", "blocks", "id"), ["family", "_i", "_j"], work, _LINKS)


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their sets of distinct five-word shingles (texts in
    lower case A-Z, words between ASCII white space) have a Jaccard similarity of
    ``percent`` / 100 or more; of fewer words the whole sequence is one shingle.
    ``component_id`` is the smallest id that links reach, and that row is kept.
    Shingles are compared by 64-bit hashes.

    Texts without words (null, empty) are linked with nothing. Rows without
    ``doc_id`` too: they have no ``component_id`` and are kept. Rows that repeat an
    id are one document. Other columns are ignored. Runs jobs and stores what
    they find.
    """
    signed = land(signatures(docs, percent), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = land(
        usable.groupBy("set_key").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    families = land(connected_components(candidate_links(classes, percent)), "families")
    found = land(connected_components(true_links(docs, classes, families, percent)), "components")
    # Different sets of one id (rows that repeat an id) also meet there.
    reach = classes.select("set_key", "id").join(found, "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("_component")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return (
        spread_join(signed.select("doc_id", "n_shingles", "set_key"), reach, "set_key", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of its rows, all columns kept: one
    with the smallest ``doc_id``, null being larger than any other. Rows are linked
    and dropped one by one, whatever their ids, so copies without an id or with the
    same id go too; which of rows with equal ids stays is open. Texts without words
    are linked with nothing and stay. Runs jobs, as ``near_dedup`` does."""
    keyed = numbered(docs)
    found = near_dedup(by_row(keyed), percent).select(F.col("doc_id").alias(ROW), "component_id")
    ids = keyed.select(ROW, F.col("doc_id").cast("long").alias("doc_id"))
    rows = land(found.join(ids, ROW), "near-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(ROW).alias("row"))
    first = (
        rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(order)["row"].alias("first"))
        .where("n > 1").drop("n")
    )
    return without(keyed, spread_join(rows, first, "component_id").where(F.col(ROW) != F.col("first")))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({SQL_LOWER}, {SQL_WORD}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT *, least(5, len(w)) AS k FROM words WHERE len(w) > 0))
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
