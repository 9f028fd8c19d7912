"""Token ids in compressed binary files: range asymmetric numeral system with one
static frequency table for the whole corpus.

A corpus is a folder with two Parquet tables:

``frequencies``  id, start, frequency: slots of each id among ``2 ** scale``
``blocks``       one row per block of whole documents, in ascending doc_id order:
    block        place in the order of all blocks (not dense)
    start        ids in all blocks before it
    n_ids        ids in this block
    doc_ids      document ids, 8 bytes each; all-ones for null
    lengths      ids of each document, packed
    lanes        interleaved coders; id number i of the block belongs to lane i % lanes
    states       coder states at each checkpoint, 8 bytes each: ``lanes`` per checkpoint
    offsets      place in ``words`` of each checkpoint, packed
    words        the coded stream, 4 bytes each
    checksums    crc32 of the ids from each checkpoint to the next, 4 bytes each

Every block is decoded alone, and every stretch between two checkpoints too, so
reading is as parallel as wished. Spark's committer makes each table appear whole
or not at all; a lost executor only repeats its own blocks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.bpe import byte_alphabet
from askloom.llm.common import (
    NO_ID,
    arrow_schema,
    mapped,
    pack_any,
    pieces,
    texts,
    unpack_any,
    worker_store,
)
from askloom.session import scratch_folder

#: Ids after which a block is closed, at the end of the document.
BLOCK_IDS = 1 << 19
#: Most lanes of a block, and steps between checkpoints.
LANES = 2048
CHECKPOINT_STEPS = 128
#: Binary digits of the frequency table's total.
SCALE = 20
#: Id written after each document (part of the format).
END_ID = 1
#: Bytes of text that a task encodes (range partitions are of about this size).
TASK_BYTES = 48 << 20
REMEMBERED = 500_000

_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


# --------------------------------------------------------------------------
# ids of texts


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin letters that are one letter in lower case too, composed, so that
#: no normalisation joins them to what follows; and the ASCII marks after it.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")


class _Words(dict):
    """Ids of lower-case words, by the library's BPE model."""

    def __init__(self, model):
        self.model = model
        self.letter = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else "".join([self.letter[b] for b in word.encode()])
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids


class _Chunks(dict):
    """Ids of runs of text between white space."""

    def __init__(self, tokenizer, plain: bool):
        self.tokenizer, self.plain = tokenizer, plain
        self.words = _Words(tokenizer.model)

    def __missing__(self, raw: bytes) -> bytes:
        text = raw.decode()
        found = _WORD.fullmatch(text) if self.plain else None
        if found:
            word, marks = found.groups()
            ids = self.words[word.lower()]
            if marks:
                ids += self.words[marks]
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[raw] = ids
        return ids


class ChunkEncoder:
    """Ids by the tokenizers library, remembered for each run of text between white
    space, and for its word and its marks. Whether that is exact depends on the
    vocabulary, so its settings are looked at: other vocabularies are encoded as
    whole texts, or as whole runs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t["content"] for t in spec["added_tokens"]]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex", "")
        # White space only parts words, is dropped, and is in no added token.
        self.separable = (
            splits[0].get("behavior") == "Removed"
            and splits[0].get("invert") is True
            and pattern.endswith(r"[^\s\p{L}\p{N}]+")
            and not any(len(t.split()) != 1 for t in added)
        )
        # Letters and marks are parted, in lower case, and spelt as bytes.
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.chunks = _Chunks(
            self.tokenizer,
            normal == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in splits] == ["Split", "ByteLevel"]
            and not any(_WORD.fullmatch(t) for t in added),
        )

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers."""
        if not self.separable:
            found = self.tokenizer.encode_batch(batch, add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in found]
        for known in (self.chunks, self.chunks.words):
            if len(known) > REMEMBERED:
                known.clear()
        look = self.chunks.__getitem__
        return [b"".join(map(look, text.encode().split())) for text in batch]


def encoder(path: str) -> ChunkEncoder:
    store = worker_store().setdefault("chunk-encoders", {})
    if path not in store:
        store[path] = ChunkEncoder(path)
    return store[path]


# --------------------------------------------------------------------------
# the coder


def slots(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2 ** scale``, at least 1 for each id that occurs."""
    total, seen = 1 << scale, int((counts > 0).sum())
    if not seen:
        return np.zeros(len(counts), np.int64)
    spare = total - seen
    share = (counts > 0) + np.floor(counts / counts.sum() * spare).astype(np.int64)
    share[np.argmax(counts)] += total - share.sum()
    return share


def lane_count(n: int) -> int:
    return max(1, min(LANES, n // 64))


def encode_block(ids: np.ndarray, start: np.ndarray, frequency: np.ndarray, scale: int = SCALE):
    """``lanes, states, offsets, words, checksums`` of a block's ids."""
    n, lanes = len(ids), lane_count(len(ids))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    shift, top = np.uint64(scale), np.uint64(63 - scale)
    out: list[np.ndarray] = []
    states, offsets, checks, written = [], [], [], 0
    f_all, s_all = frequency[ids].astype(np.uint64), start[ids].astype(np.uint64)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        f, s, x = f_all[a:b], s_all[a:b], state[: b - a]
        full = x >= (f << top)
        if full.any():
            out.append(x[full].astype(np.uint32))
            written += len(out[-1])
            x = np.where(full, x >> _32, x)
        div = x // f
        state[: b - a] = (div << shift) + (x - div * f) + s
        if step % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
            offsets.append(written)
            last = min(n, (step + CHECKPOINT_STEPS) * lanes)
            checks.append(zlib.crc32(ids[a:last].astype("<u4").tobytes()))
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    return (
        lanes,
        np.concatenate(states[::-1]).astype("<u8").tobytes() if states else b"",
        pack_any(np.array([written - o for o in offsets[::-1]], np.uint64)),
        words.astype("<u4").tobytes(),
        np.array(checks[::-1], "<u4").tobytes(),
    )


def decode_stretch(
    n: int, first: int, lanes: int, state: np.ndarray, words: np.ndarray, at: int,
    symbol: np.ndarray, start: np.ndarray, frequency: np.ndarray, scale: int = SCALE,
) -> np.ndarray:
    """Ids number ``first`` to ``first + n`` of a block, from a checkpoint on."""
    shift, mask = np.uint64(scale), np.uint64((1 << scale) - 1)
    state, out = state.copy(), np.empty(n, np.uint32)
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        slot = x & mask
        s = symbol[slot.astype(np.int64)]
        out[a:b] = s
        x = frequency[s] * (x >> shift) + slot - start[s]
        low = x < _LOW
        k = int(low.sum())
        if k:
            x[low] = (x[low] << _32) | words[at : at + k]
            at += k
        state[: b - a] = x
    return out


def decode_block(n: int, lanes: int, states: bytes, offsets: bytes, words: bytes, checksums: bytes, table) -> np.ndarray:
    """All ids of a block; raises if a stretch doesn't match its checksum."""
    symbol, start, frequency = table
    state = np.frombuffer(states, "<u8").reshape(-1, lanes)
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    out = []
    for k, (at, check) in enumerate(zip(unpack_any(offsets).tolist(), np.frombuffer(checksums, "<u4").tolist())):
        first = k * CHECKPOINT_STEPS * lanes
        ids = decode_stretch(
            min(n - first, CHECKPOINT_STEPS * lanes), first, lanes, state[k], stream, at,
            symbol, start, frequency,
        )
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError(f"checksum of stretch {k} differs")
        out.append(ids)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


# --------------------------------------------------------------------------
# writing

_RAW = "shard int, place int, n_ids long, doc_ids binary, lengths binary, ids binary, counts binary"
_BLOCK = (
    "block long, start long, n_ids long, doc_ids binary, lengths binary, lanes int, "
    "states binary, offsets binary, words binary, checksums binary"
)


def _raw_blocks(ordered: DataFrame, vocabulary: str) -> DataFrame:
    """Blocks of whole documents with their ids, in the order of each partition,
    and a last row that only holds the partition's count of every id."""
    schema = arrow_schema(ordered, _RAW)

    def run(batches):
        shard, place = TaskContext.get().partitionId(), 0
        docs, lengths, parts, held = [], [], [], 0
        counts = np.zeros(1, np.int64)

        def block():
            nonlocal counts
            ids = np.frombuffer(b"".join(parts), "<u4")
            found = np.bincount(ids, minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
            planes = ids.view(np.uint8).reshape(-1, 4).T.tobytes()
            return row(
                place, held, np.array(docs, "<i8").tobytes(), pack_any(np.array(lengths, np.uint64)),
                zstandard.ZstdCompressor(level=3).compress(planes), None,
            )

        def row(*values):
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((shard, *values), schema)], schema=schema
            )

        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for piece in pieces(batch):
                found = encoder(vocabulary).encode(piece.column("text").to_pylist())
                for doc, ids in zip(piece.column("doc_id").to_pylist(), found):
                    docs.append(NO_ID if doc is None else doc)
                    lengths.append(len(ids) // 4 + 1)
                    parts += (ids, end)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield block()
                        place += 1
                        docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield block()
        yield row(None, 0, None, None, None, pack_any(counts.astype(np.uint64)))

    return ordered.mapInArrow(run, _RAW)


# Characters of a text that take part in the choice of ranges, which passes the driver.
_RANGE_CHARS = 128


def _raw_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def write_corpus(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode all texts, each followed by the end id, into a corpus folder.

    Documents are written in ascending ``doc_id`` order; null ids come first, rows
    with one id in the order of their texts. Null and empty texts are the end id
    alone. Other columns are ignored. Runs jobs: ids are stored once (compressed)
    and counted before they are coded.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    source = texts(docs)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Texts count too, by their beginnings, so that rows with one id are split as well.
    ordered = source.repartitionByRange(
        max(1, -(-size // TASK_BYTES)), F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(_RANGE_CHARS))
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    raw_path = scratch_folder(spark, "token-ids")
    _raw_blocks(ordered, vocabulary).write.option("compression", "none").parquet(raw_path)
    stored = spark.read.parquet(raw_path)
    raw = stored.where("place IS NOT NULL").drop("counts")

    # The table holds a row per id of the vocabulary, however large the corpus.
    counted = stored.where("place IS NULL").select("counts").mapInArrow(_add_counts, "id int, n long")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_id = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    by_id[counts["id"]] = counts["n"]
    frequency = slots(by_id)
    start = np.cumsum(frequency) - frequency
    seen = np.flatnonzero(frequency)
    spark.createDataFrame(
        [(int(i), int(start[i]), int(frequency[i])) for i in seen],
        "id int, start long, frequency long",
    ).coalesce(1).write.parquet(f"{path}/frequencies")

    # One row per block without its ids: sums per shard, then over the shards.
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = raw.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    starts = (
        raw.select("shard", "place", "n_ids")
        .withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(shards, "shard")
        .select("shard", "place", (F.col("_inside") + F.col("_before")).alias("start"))
    )
    shared = spark.sparkContext.broadcast((start, frequency))

    def code(batch):
        start, frequency = shared.value
        made = {name: [] for name in ("lanes", "states", "offsets", "words", "checksums")}
        for data in batch.column("ids").to_pylist():
            for name, value in zip(made, encode_block(_raw_ids(data).astype(np.int64), start, frequency)):
                made[name].append(value)
        return {name: batch.column(name) for name in ("block", "start", "n_ids", "doc_ids", "lengths")} | made

    placed = raw.join(starts, ["shard", "place"]).select(
        (F.col("shard").cast("long") * (1 << 32) + F.col("place")).alias("block"),
        "start", "n_ids", "doc_ids", "lengths", "ids",
    )
    mapped(placed, code, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def _add_counts(batches):
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            total = unpack_any(data).astype(np.int64)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"id": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())}
            )


# --------------------------------------------------------------------------
# reading


def read_corpus(spark: SparkSession, path: str, want, schema: str) -> DataFrame:
    """Decode every block and hand ``want(doc_ids, starts, lengths, ids)`` the
    documents of each; it returns the columns of ``schema``."""
    rows = spark.read.parquet(f"{path}/frequencies").toPandas()
    size = int(rows["id"].max()) + 1 if len(rows) else 1
    start, frequency = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    start[rows["id"]], frequency[rows["id"]] = rows["start"], rows["frequency"]
    shared = spark.sparkContext.broadcast((start, frequency))
    blocks = spark.read.parquet(f"{path}/blocks")
    types = arrow_schema(blocks, schema)

    def run(batches):
        start, frequency = shared.value
        symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64))
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(
                    row["n_ids"], row["lanes"], row["states"], row["offsets"], row["words"],
                    row["checksums"], (symbol, start, frequency),
                )
                lengths = unpack_any(row["lengths"]).astype(np.int64)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                starts = row["start"] + np.cumsum(lengths) - lengths
                made = want(docs, starts, lengths, ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) for f in types], schema=types
                )

    return blocks.mapInArrow(run, schema)


def _doc_column(docs: np.ndarray) -> list:
    return [None if d == NO_ID else d for d in docs.tolist()]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, end id included."""

    def want(docs, starts, lengths, ids):
        cut = np.split(ids.astype(np.int32), np.cumsum(lengths)[:-1])
        return {"doc_id": _doc_column(docs), "start": starts, "ids": cut}

    return read_corpus(spark, path, want, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document."""

    def want(docs, starts, lengths, ids):
        data = memoryview(ids.astype("<u4").tobytes())
        ends = np.cumsum(lengths)
        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
        return {"doc_id": _doc_column(docs), "start": starts, "n_tokens": lengths, "ids_crc32": crc}

    return read_corpus(spark, path, want, "doc_id long, start long, n_tokens long, ids_crc32 long")
