"""Piece encoding against the library, fill-in-the-middle against its definition,
hard negatives against brute force."""

import hashlib
import math

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from askloom.llm import fill_middle, hard_negatives, pieces
from askloom.llm import queries as llm
from askloom.llm.hard_negatives import Tree, Vectors, Wanted

MODEL = pieces.default_model()
CODEC = pieces.Codec(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- pieces -------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text(max_size=60),
    st.text(alphabet="ab \n\t▁.é日\x00", max_size=80),
    st.lists(st.sampled_from(["the", " ", "  ", "▁", "ing", "\n", "<s>", "<0x0A>", "́", ".", "www."]), max_size=20).map("".join),
))
def test_pieces_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(CODEC.encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 270)), max_size=10))
def test_decode_any_ids(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("word", ["x" * 50_000, "ab" * 30_000, "日本語" * 9000 + "x" * 999, " " * 40_000, "\n" * 3000])
def test_pieces_of_long_words(word):
    assert np.frombuffer(CODEC.encode(word), "<u4").tolist() == LIBRARY.encode(word)
    assert all(len(w) <= 1024 for w in CODEC.word)


def test_search_equals_merging_and_steps_back():
    rng = np.random.default_rng(5)
    some = [t for t in CODEC.id if "▁" not in t]
    before = CODEC.stepped_back
    for _ in range(1000):
        word = "".join(rng.choice(some, 3))[:40]
        assert ["".join(CODEC.text[t]) for t in CODEC.search(word)] == CODEC.merge(list(word))
    assert CODEC.stepped_back > before


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    path = tmp_path / "changed.model"
    path.write_bytes(data + b"\x12\x02\x18\x01")  # a trainer block that says: no merge model
    with pytest.raises(ValueError):
        pieces.Codec(str(path))


def expected_pieces(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))


def test_piece_round_trip(awkward, nothing):
    got = sorted((tuple(r) for r in pieces.round_trip(awkward).collect()), key=repr)
    assert got == sorted(((r.doc_id, *expected_pieces(r.text)) for r in awkward.collect()), key=repr)
    assert pieces.round_trip(nothing).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(awkward)).where("doc_id > 0").collect()}
    assert back == {r.doc_id: r.text or "" for r in awkward.where("doc_id > 0").collect()}


def test_piece_query(spark, sf, rows):
    got = {r.doc_id: tuple(r)[1:] for r in llm.op11_piece_round_trip(spark, sf).collect()}
    assert got == {d: expected_pieces(t) for d, t in rows}


# -- fill-in-the-middle -------------------------------------------------------


def expected_cut(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, a, b - a, sha(out), sha(text)


@pytest.mark.parametrize("units", [1, 7, 16_384])
def test_fill_in_middle(spark, awkward, nothing, units):
    more = [(i, f"héllo 日本語 {'😀' * i} <P" + (">" if i % 9 == 0 else "") + "S>") for i in range(100, 160)]
    docs = awkward.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    if units == 1:
        docs = docs.where("length(text) < 200 OR text IS NULL")
    made = fill_middle.fill_in_middle(fill_middle.store(docs, units))
    got = sorted((tuple(r) for r in fill_middle.digests(made).collect()), key=repr)
    source = docs.select("doc_id", "text").collect()
    assert got == sorted(((r.doc_id, *expected_cut(r.doc_id, r.text)) for r in source), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = fill_middle.as_text(fill_middle.restored(made), "frames")
    assert sorted(map(repr, back.collect())) == sorted(
        repr(r) for r in docs.selectExpr("doc_id", "coalesce(text, '') AS frames").collect()
    )
    assert fill_middle.digests(fill_middle.fill_in_middle(fill_middle.store(nothing))).count() == 0


def test_only_cut_frames_are_opened(monkeypatch):
    text = " ".join(map(str, range(3000)))[:10_000]
    frames = fill_middle.Frames.of(text, 100)
    opened = []
    plain = fill_middle.Frames.bytes
    monkeypatch.setattr(fill_middle.Frames, "bytes", lambda self, i: opened.append(i) or plain(self, i))
    made = fill_middle.rearrange(frames, "psm", 1234, 5678)
    assert len(opened) == 4 and set(opened) == {12, 56}
    assert set(frames.data) - set(made.data) == {frames.data[12], frames.data[56]}
    assert b"".join(made.stream()).decode() == f"<P>{text[:1234]}<S>{text[5678:]}<M>{text[1234:5678]}"


# -- hard negatives -----------------------------------------------------------


def brute_negatives(rows, every=50, positives=5, negatives=3):
    """``rows``: (vec_id or None, embedding or None, label or None)."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for k, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), i is None, i or 0, same, j)
            for j, (i, v, other) in enumerate(kept) if j != k for same in [other == label]
        )
        for p in [s for s in scored if s[3]][:positives]:
            fit = [n for n in scored if not n[3] and 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0]]
            for rank, n in enumerate(fit[:negatives], 1):
                out.append((anchor, None if p[1] else p[2], rank, None if n[1] else n[2], -p[0], -n[0]))
    return sorted(out, key=repr)


def mined(frame, **options):
    made = hard_negatives.mine(frame, label=hard_negatives.changed_label(), **options)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in columns) for r in made.collect()), key=repr)


def random_rows(n, seed, width=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.5, (5, width))
    v = centres[rng.integers(0, 5, n)] + rng.normal(0, 0.2, (n, width))
    return [(int(i), v[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


def test_mining_equals_brute_force(spark):
    rows = random_rows(700, 1)
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(150)]  # equal vectors, a hot group
    rows += [(50, rows[3][1], 1), (50, rows[50][1], 0), (7, rows[9][1], 1)]  # repeated ids
    rows += [(None, rows[k][1], k % 4) for k in range(9)]
    rows += [(2000, None, 1), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2100, [float("nan")] * 6, 1),
             (2150, [float("inf")] * 6, 2), (2200, rows[1][1], None), (2250, [0.0] * 6, 1),
             (2300, [-x for x in rows[2][1]], 3), (2350, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    frame = frame.selectExpr("*", "1 AS part", "2 AS v", "3 AS low", "4 AS anchor_row")
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(frame) == want
    assert mined(frame, part_rows=40) == want
    assert mined(frame.where("false")) == []
    assert mined(frame.where("vec_id = 50")) == brute_negatives([r for r in rows if r[0] == 50])


def test_too_long_vectors_are_refused(spark):
    frame = spark.createDataFrame([(50, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        mined(frame)


def test_tree_leaves_out_and_loses_nothing():
    rng = np.random.default_rng(2)
    v = np.rint(256 * (np.repeat(rng.normal(0, 1, (40, 4)), 100, 0) + rng.normal(0, 0.02, (4000, 4)))).astype(np.int64)
    rows = Vectors(np.arange(4000), np.arange(4000), rng.integers(0, 3, 4000), v)
    tree = Tree(rows, leaf=64)
    some = rows.take(np.arange(0, 4000, 97))
    scores = some.v @ v.T
    top = np.sort(scores, 1)[:, -30].astype(float)
    for same in (True, False):
        wanted = Wanted(some, np.arange(len(some)), np.zeros(len(some), np.int64), np.full(len(some), -np.inf), top, 3, same)
        tree.compared = 0
        tree.search(wanted)
        assert tree.compared < 0.5 * len(some) * 4000
        for i in range(len(some)):
            fit = [j for j in range(4000) if (rows.label[j] == some.label[i]) == same and j != some.row[i] and scores[i, j] <= top[i]]
            best = sorted(fit, key=lambda j: (-scores[i, j], j))[:3]
            assert wanted.row[i].tolist() == best
