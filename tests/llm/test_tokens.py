"""BPE against the library, and the token files' round trip."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from askloom.llm import bpe, token_files
from askloom.llm import queries as llm
from askloom.session import scratch_folder

BYTES, WORDS = bpe.default_vocabulary(), token_files.default_vocabulary()
CODEC = bpe.Codec(BYTES)
LIBRARY = {BYTES: Tokenizer.from_file(BYTES), WORDS: Tokenizer.from_file(WORDS)}


def ids_of(text, path=BYTES):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=40),
    st.text(alphabet="ab 's\n\t1é日\x1c\x85 ", max_size=60),
    st.lists(st.sampled_from(["the", " ", "  ", "<|endoftext|>", "ing", "\n", "zzzz", "1"]), max_size=20).map("".join),
), max_size=5))
def test_bpe_equals_library(batch):
    texts = [t.encode("utf-8", "ignore").decode() for t in batch]
    for text, made in zip(texts, CODEC.encode(texts)):
        ids = np.frombuffer(made, "<u4").tolist()
        assert ids == ids_of(text)
        assert CODEC.decode(ids) == LIBRARY[BYTES].decode(ids, skip_special_tokens=False)


def test_bpe_methods_agree():
    words = ["x" * 700, "the" * 120, "intangibility" * 3, "é" * 300, "ab" * 30]
    for word in words:
        raw = word.encode()
        merged = CODEC.merge_exactly(raw).tolist()
        assert merged == ids_of(word)
        assert CODEC.propose([raw])[0].tolist() == CODEC.propose_long(raw).tolist()
    assert CODEC.sound.all()


def test_pair_check_equals_merging():
    rng = np.random.default_rng(4)
    tokens = [i for i, b in enumerate(CODEC.bytes) if b and i != 50256]
    x, y = rng.choice(tokens, 3000), rng.choice(tokens, 3000)
    fits = CODEC.compatible(x, y)
    for a, b, ok in zip(x.tolist(), y.tolist(), fits.tolist()):
        assert ok == (CODEC.merge_exactly(CODEC.bytes[a] + CODEC.bytes[b]).tolist() == [a, b])


def test_decode_bad_utf8():
    ids = [int(CODEC.byte_id[0xE6]), int(CODEC.byte_id[0x97]), *ids_of("a")]
    assert CODEC.decode(ids) == LIBRARY[BYTES].decode(ids, skip_special_tokens=False)


def expected(text):
    ids = ids_of(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY[BYTES].decode(ids, skip_special_tokens=False))


def test_round_trip(awkward, nothing):
    got = sorted((tuple(r) for r in bpe.round_trip(awkward).collect()), key=repr)
    want = sorted(((r.doc_id, *expected(r.text)) for r in awkward.collect()), key=repr)
    assert got == want
    assert bpe.round_trip(nothing).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(awkward)).where("doc_id > 0").collect()}
    assert back == {r.doc_id: r.text or "" for r in awkward.where("doc_id > 0").collect()}


def test_round_trip_query(spark, sf, rows):
    got = {r.doc_id: tuple(r)[1:] for r in llm.op2_bpe_round_trip(spark, sf).collect()}
    assert got == {d: expected(t) for d, t in rows}


# -- token files --------------------------------------------------------------


def layout_of(rows):
    """Rows as files hold them: null ids first, then by id and text."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out, at = [], 0
    for d, t in ordered:
        ids = [*ids_of(t, WORDS), 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def read(spark, docs):
    path = scratch_folder(spark, "tokens")
    token_files.write_corpus(docs, path)
    return path, [tuple(r) for r in token_files.read_digests(spark, path).collect()]


def test_token_files_query(spark, sf, rows):
    got = sorted(tuple(r) for r in llm.op5_token_files(spark, sf).collect())
    assert got == sorted(layout_of(rows))


def test_token_files_cases(spark, awkward, nothing, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    path, got = read(spark, awkward)
    assert sorted(got, key=lambda r: r[1]) == layout_of(rows)
    whole = [i for r in sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start) for i in r.ids]
    assert len(whole) == sum(r[2] for r in got)
    monkeypatch.setattr(token_files, "TASK_BYTES", 3000)
    assert sorted(read(spark, awkward)[1], key=lambda r: r[1]) == layout_of(rows)
    assert read(spark, nothing)[1] == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_000, 300_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n), 49_000)
    counts = np.bincount(ids, minlength=49_001) + 0
    frequency = token_files.slots(counts)
    assert n == 0 or frequency.sum() == 1 << token_files.SCALE
    start = np.cumsum(frequency) - frequency
    coded = token_files.encode_block(ids, start, frequency)
    table = (np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency), start.astype(np.uint64), frequency.astype(np.uint64))
    assert token_files.decode_block(n, *coded, table).tolist() == ids.tolist()


def test_checkpoints_and_checksums():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 300, 300_000)
    frequency = token_files.slots(np.bincount(ids))
    start = np.cumsum(frequency) - frequency
    lanes, states, offsets, words, checks = token_files.encode_block(ids, start, frequency)
    symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)
    state = np.frombuffer(states, "<u8").reshape(-1, lanes)
    at = token_files.unpack_any(offsets).tolist()
    assert len(state) == len(at) > 1
    span = token_files.CHECKPOINT_STEPS * lanes
    last = token_files.decode_stretch(  # the last stretch alone
        len(ids) - span * (len(at) - 1), span * (len(at) - 1), lanes, state[-1],
        np.frombuffer(words, "<u4").astype(np.uint64), at[-1], symbol, start.astype(np.uint64), frequency.astype(np.uint64),
    )
    assert last.tolist() == ids[span * (len(at) - 1) :].tolist()
    broken = bytearray(words)
    broken[100] ^= 1
    with pytest.raises((ValueError, IndexError)):
        token_files.decode_block(
            len(ids), lanes, states, offsets, bytes(broken), checks,
            (symbol, start.astype(np.uint64), frequency.astype(np.uint64)),
        )


def test_chunk_encoder_equals_library():
    import random

    made = token_files.ChunkEncoder(WORDS)
    assert made.separable and made.chunks.plain
    rng = random.Random(1)
    letters = [*"ab THE  \n\t  'sé日😀1²٣.,-_\x1c\x85ΣİḰß", "<|endoftext|>", "it's", "We'll "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [f"a{chr(c)} {chr(c)}B {chr(c)}.. x{chr(c)}y" for c in range(0x600) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, made.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text, WORDS), text


def test_other_vocabularies_are_encoded_whole():
    made = token_files.ChunkEncoder(BYTES)
    assert not made.separable
    assert np.frombuffer(made.encode(["a  b c"])[0], "<u4").tolist() == ids_of("a  b c")


def test_rows_with_one_id_are_split(spark, monkeypatch):
    """A third of all rows without an id: no range holds them all."""
    monkeypatch.setattr(token_files, "TASK_BYTES", 2000)
    rows = [(None if i % 3 == 0 else i, f"text number {i * 7919 % 1000}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path, got = read(spark, docs)
    assert sorted(got, key=lambda r: r[1]) == [tuple(r) for r in layout_of(rows)]
    blocks = spark.read.parquet(f"{path}/blocks").selectExpr("block >> 32 AS shard", "length(doc_ids) / 8 AS n")
    sizes = [r["n"] for r in blocks.groupBy("shard").sum("n").toDF("shard", "n").collect()]
    assert sum(sizes) == 900 and max(sizes) < 250
