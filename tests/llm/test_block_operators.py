"""Operators that compare every window, and the language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from askloom.llm import ngram_lm, suffix_dedup, window_dedup
from askloom.llm.common import NO_ID, Layout, pack, pack_any, unpack, unpack_any

SPREAD = Layout(blocks=5, slices=7)


def of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def order(doc):
    return NO_ID if doc is None else doc


def covered(n, starts, width):
    marks = np.zeros(n + 1, int)
    for i in starts:
        marks[i] += 1
        marks[i + width] -= 1
    return np.cumsum(marks[:-1]) > 0


def brute_windows(rows, width=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, NO_ID), order(d))
    out = []
    for d, w in words:
        gone = covered(len(w), [i for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < order(d)], width)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_strings(rows, length=50):
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], NO_ID), order(d))
    out = []
    for d, b in raw:
        gone = covered(len(b), [i for i in range(len(b) - length + 1) if first[b[i : i + length]] < order(d)], length)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def awkward_rows(awkward):
    return [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]


@pytest.mark.parametrize("operator, brute", [
    (window_dedup.repeated_passages, brute_windows), (suffix_dedup.repeated_strings, brute_strings),
])
class TestRepeats:
    def test_documents(self, spark, rows, operator, brute):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want = brute(rows)
        assert sum(r[2] for r in want) > 0
        assert of(operator(docs, layout=SPREAD)) == want
        assert of(operator(docs)) == want

    def test_cases(self, awkward, awkward_rows, nothing, operator, brute):
        assert of(operator(awkward, layout=SPREAD)) == brute(awkward_rows)
        assert operator(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_noise(spark, seed):
    """Texts of few letters: periods, overlaps, borders and ties everywhere."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 90))) for _ in range(6)]
    rows = [(i % 25, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert of(suffix_dedup.repeated_strings(docs, layout=SPREAD)) == brute_strings(rows)
    assert of(window_dedup.repeated_passages(docs, width=3, layout=SPREAD)) == brute_windows(rows, 3)


def test_every_string_has_one_minimizer(monkeypatch):
    """Also across the pieces of a long document, and wherever the string stands."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 3000).astype(np.uint8).tobytes().decode()
    texts = [text, text[500:900], "x" * 49, "", "y" + text[100:400], "z" * 200]

    def hash_of_strings():
        table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
        block = suffix_dedup.Block(table)
        found = {}
        for first, last, h in zip(*(x.tolist() for x in block.minimizers(50))):
            for at in range(first, last + 1):
                assert at not in found
                found[at] = h
        ends = np.concatenate([[0], block.ends])
        whole = [a for x, y in zip(ends, ends[1:]) for a in range(x, y - 49)]
        assert sorted(found) == whole
        by_string = {}
        for at, h in found.items():
            assert by_string.setdefault(bytes(block.data[at : at + 50]), h) == h
        return found

    whole = hash_of_strings()
    monkeypatch.setattr(suffix_dedup, "_HASHED_AT_ONCE", 300)
    assert hash_of_strings() == whole


def test_run_length_index():
    rng = random.Random(2)
    for trial in range(150):
        letters = b"ab" if trial % 2 else b"abcde"
        pieces = list({bytes(rng.choice(letters) for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 12))})
        owner = [rng.randint(0, 9) for _ in pieces]
        length = rng.randint(2, 6)
        best = {}
        for p, o in zip(pieces, owner):
            for i in range(len(p) - length + 1):
                best[p[i : i + length]] = min(best.get(p[i : i + length], 99), o)
        want = [(k, i, best[p[i : i + length]]) for k, p in enumerate(pieces) for i in range(len(p) - length + 1)]
        got = suffix_dedup.first_owners(
            np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), np.array(owner), length
        )
        assert list(zip(*(x.tolist() for x in got))) == want


def test_index_follows_the_runs():
    """The index of many near copies holds the samples of few runs, and the matches
    that stream from them are those of the sorted suffixes."""
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 400).astype(np.uint8)
    copies = []
    for k in range(50):
        one = passage.copy()
        one[8 * k] = 65
        copies += [one, np.array([255], np.uint8)]
    text = np.concatenate(copies)
    index = suffix_dedup.RunLengthIndex(text, 1000, 1000)
    assert sum(x.nbytes for x in vars(index).values()) < 8 * len(text)
    assert len(index.place) < len(text) / 10
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:].tobytes()))
    before, match = index.stream(0, len(text))
    assert (before[order[1:]] == order[:-1]).all()
    for a, b in zip(order[::97], order[1::97]):
        x, y = text[a:].tobytes(), text[b:].tobytes()
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert max(0, match[b]) == same
    part = index.stream(700, 900)
    assert (part[0] == before[700:900]).all() and (part[1] == match[700:900]).all()


def test_long_run_and_common_passage(spark):
    """A megabyte of one letter, and a passage that a third of the rows hold often."""
    passage = " ".join(f"word{k}" for k in range(12))
    rows = [(i, f"{i * i} " + (passage + f" {i} ") * (3 if i % 3 == 0 else 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert of(suffix_dedup.repeated_strings(docs, layout=SPREAD)) == brute_strings(rows)
    run = spark.createDataFrame([(1, "a" * 1_000_000), (2, "b" + "a" * 1_000_000)], "doc_id long, text string")
    got = [r[:4] for r in of(suffix_dedup.repeated_strings(run, layout=SPREAD))]
    assert got == [(1, 1_000_000, 0, 0), (2, 1_000_001, 1_000_000, 1)]


def test_sketch_overestimates():
    """Windows that occur twice are never missed, however small the sketch."""
    found = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for bits in (8, 12):
        for row in range(window_dedup.ROWS):
            distinct = np.sort(found)
            n = np.where(np.isin(distinct, found[:50]), 2, 1)
            cells = window_dedup.Cells.of_row(distinct, n, row, bits)
            assert (np.diff(cells.cell.astype(np.int64)) > 0).all() and cells.total.sum() == 550
            assert (cells.total[cells.of][n == 2] >= 2).all()


def test_keys_that_share_a_half():
    first, second = np.array([7, 3, 7, 7, 3], np.uint64), np.array([2, 9, 1, 2, 9], np.uint64)
    a, b, (order,) = window_dedup.in_order(first, second)
    assert a.tolist() == [3, 3, 7, 7, 7] and b.tolist() == [9, 9, 1, 2, 2]
    assert first[order].tolist() == a.tolist() and second[order].tolist() == b.tolist()


def test_packed_arrays():
    x = np.array([0, 0, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    assert unpack(pack(x)).tolist() == x.tolist()
    assert unpack_any(pack_any(x[::-1])).tolist() == x[::-1].tolist()
    assert len(unpack(pack(x[:0]))) == 0


def test_layout_keeps_messages_long():
    for size in (10**6, 10**9, 10**12, 10**14):
        layout = Layout.of(size)
        windows = size / 6
        assert layout.blocks * layout.slices == 1 or windows / (layout.blocks * layout.slices) > 100


# -- language model ----------------------------------------------------------


def brute_scores(rows, folds=10):
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    fold = lambda d: -1 if d is None else zlib.crc32(str(d).encode()) % folds
    uni, bi, after, kinds = Counter(), Counter(), Counter(), Counter()
    for d, words in tokens:
        if fold(d) > 0:
            for p, w in zip(["start", *words], words):
                uni[w] += 1
                bi[p, w] += 1
                after[p] += 1
    for p, _ in bi:
        kinds[p] += 1
    n, v = sum(uni.values()), len(uni)
    once = lambda c, k: sum(x == k for x in c.values())
    d1 = ngram_lm.discount(once(uni, 1), once(uni, 2))
    d2 = ngram_lm.discount(once(bi, 1), once(bi, 2))
    alone = lambda w: ((uni[w] - d1) / n if uni[w] else d1 * v / n) if n else 1.0
    prob = lambda p, w: (
        (max(bi[p, w] - d2, 0) + d2 * kinds[p] * alone(w)) / after[p] if after[p] else alone(w)
    )
    for p in list(after)[:10]:
        assert abs(sum(prob(p, w) for w in [*uni, "never seen at all"]) - 1) < 1e-9
    out = []
    for d, words in tokens:
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        score = sum(math.log10(prob(p, w)) for p, w in zip(["start", *words], words))
        out.append((d, fold(d) == 0, len(words), sum(uni[w] > 0 for w in words), n, base, score))
    return sorted(out, key=repr)


def same_scores(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_scores_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_scores(rows)
    same_scores(of(ngram_lm.scores(docs, layout=SPREAD)), want)
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_scores_cases(awkward, awkward_rows, nothing):
    same_scores(of(ngram_lm.scores(awkward, layout=SPREAD)), brute_scores(awkward_rows))
    same_scores(of(ngram_lm.scores(awkward.where("doc_id IS NULL"))), brute_scores([r for r in awkward_rows if r[0] is None]))
    assert ngram_lm.scores(nothing).count() == 0
