"""Exact dedup, near dedup, decontamination, quality and chat on small tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from askloom.llm import chat, decontaminate, exact_dedup, near_dedup, quality
from askloom.llm import queries as llm
from askloom.llm.graphs import connected_components, labels


def by_key(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r[0]].append(tuple(r[1:]))
    return {k: sorted(v, key=repr) for k, v in out.items()}


# -- exact dedup ------------------------------------------------------------


def test_exact_dedup_cases(spark, awkward, nothing):
    got = by_key(exact_dedup.exact_dedup(awkward, llm.fresh_index(spark)))
    keep = {k: v[0][:3] for k, v in got.items() if k is not None}
    assert keep[1] == (2, 4, False)
    assert got[2] == [got[2][0]] * 2 and keep[2] == (2, 4, True)  # repeated rows agree
    assert keep[3] == (4, 3, False) and keep[4] == (4, 3, True)  # null is empty, ids beat null
    assert keep[8] == (8, 1, True)  # no change of case
    assert keep[10] == (10, 2, True)
    alone = [r for r in got[None] if r[0] is None]
    assert len(got[None]) == 3 and len(alone) == 1 and alone[0][2]
    assert got[9][0][3] == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.exact_dedup(nothing, llm.fresh_index(spark)).count() == 0


def test_exact_dedup_appends(spark):
    index = llm.fresh_index(spark)
    first = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "x"), (4, "z"), (5, "z")], "doc_id long, text string")
    assert {k for k, v in by_key(exact_dedup.exact_dedup(first, index)).items() if v[0][2]} == {1, 2}
    found = by_key(exact_dedup.exact_dedup(second, index))
    assert [found[k][0][:3] for k in (3, 4, 5)] == [(1, 1, False), (5, 2, False), (5, 2, True)]
    again = exact_dedup.DigestIndex(spark, index.path, index.name + "_again")
    assert again.rows().count() == 3
    plan = again.absent(second.selectExpr("cast(text as binary) digest", "doc_id"))
    assert "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_keeps_columns(spark, awkward):
    kept = exact_dedup.keep_one_row(awkward, llm.fresh_index(spark))
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 4, 5, 6, 7, 8, 10, 11, 12]


@pytest.mark.parametrize("batches", [2, 3, 7])
def test_exact_dedup_in_batches(spark, awkward, nothing, batches):
    """Later batches meet a filled index; the rows are those of one batch."""
    more = [(20 + i, t) for i, t in enumerate(["a b", "", "Y", "new"] * 2)]
    docs = awkward.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = sorted(map(repr, exact_dedup.exact_dedup(docs, llm.fresh_index(spark)).collect()))
    index = llm.fresh_index(spark)
    met, plain = [], exact_dedup.DigestIndex.append

    class Watched(exact_dedup.DigestIndex):
        def append(self, groups):
            met.append(self.rows().join(groups.select("digest"), "digest", "left_semi").count())
            plain(self, groups)

    watched = Watched(spark, index.path, index.name)
    assert sorted(map(repr, exact_dedup.exact_dedup(docs, watched, batches).collect())) == want
    assert len(met) == batches and met[0] == 0 and sum(met) > 0
    assert exact_dedup.exact_dedup(nothing, llm.fresh_index(spark), batches).count() == 0


# -- near dedup -------------------------------------------------------------


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(rows, percent):
    sets = [(d, shingles(t)) for d, t in rows]
    n = len(sets)
    u, v = [], []
    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u.append(i)
                v.append(j)
    low = labels(n, np.array(u, int), np.array(v, int))
    least = {k: min(sets[i][0] for i in range(n) if low[i] == k) for k in set(low.tolist())}
    return {d: (len(s), least[low[i]], least[low[i]] == d) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_equals_brute_force(spark, rows, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {k: v[0] for k, v in by_key(near_dedup.near_dedup(docs, percent)).items()}
    assert got == brute_components(rows, percent)


def test_near_dedup_blocks_of_a_large_group(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    made = []
    for i in range(40):
        words = list(base)
        for k in range(i % 5):
            words[(7 * i + 13 * k) % 60] = f"x{i}-{k}"
        made.append((100 + i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {k: v[0] for k, v in by_key(near_dedup.near_dedup(docs, 80)).items()}
    assert got == brute_components(made, 80)


def test_near_dedup_cases(awkward, nothing):
    got = by_key(near_dedup.near_dedup(awkward, 80))
    assert got[1][0][1] == 1 and got[2] == [(11, 1, False)] * 2 and got[8] == [(11, 1, False)]
    assert got[3] == [(0, 3, True)] and got[5] == [(0, 5, True)]
    # three shingles and a fourth: 0.75 is below the threshold
    assert got[7] == [(4, 7, True)] and got[10] == [(1, 9, False)]
    assert len(got[None]) == 3 and all(r[1] is None and r[2] for r in got[None])
    assert near_dedup.near_dedup(nothing).count() == 0
    assert near_dedup.keep_one(awkward).columns == awkward.columns


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.5, 0.9):
        other = np.concatenate([base[: int(4000 * share)], rng.integers(0, 1 << 63, 4000, dtype=np.uint64)])
        truth = int(4000 * share) / (4000 + 4000)
        sign = [near_dedup.low_bits(near_dedup.minima(np.unique(x))) for x in (base, other)]
        assert abs(float(near_dedup.estimate(*sign)) - truth) < 0.2
    rows, bands = near_dedup.banding(85)
    assert (1 - 0.85**rows) ** bands <= near_dedup.MISS


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


# -- decontamination --------------------------------------------------------


def test_contained_items_equal_brute_force(spark, sf, rows):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    for d, text in rows:
        own = shingles(text)
        for r in items.collect():
            q = shingles(r.text)
            if 100 * len(own & q) >= 80 * len(q):
                want.add((d, r.item_id, len(q), len(own & q)))
    got = {tuple(r) for r in llm.op7_decontaminate(spark, sf).collect()}
    assert got == want and want


def test_contained_items_cases(spark, awkward, nothing, monkeypatch):
    items = spark.createDataFrame(
        [(1, "THREE four five six seven eight nine"), (2, "a"), (3, None), (4, ""), (None, "x y z v w q"),
         (5, "three four five six seven eight nine ten eleven zwölf")],
        "item_id long, text string",
    )
    got = sorted((tuple(r) for r in decontaminate.contained_items(awkward, items).collect()), key=repr)
    hits = [(1, 1), (2, 1), (2, 1), (8, 1), (12, 1), (None, 1), (9, 2), (10, 2)]
    want = [(d, 1, 3, 3) if i == 1 else (d, 2, 1, 1) for d, i in hits]
    want += [(d, 5, 6, 5) for d, i in hits if i == 1]
    assert got == sorted(want, key=repr)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 20)
    blocks = sorted((tuple(r) for r in decontaminate.contained_items(awkward, items).collect()), key=repr)
    assert blocks == got
    assert decontaminate.contained_items(nothing, items).count() == 0
    copies = items.union(items.selectExpr("item_id + 1000 AS item_id", "text")).union(items)
    more = decontaminate.contained_items(awkward, copies).collect()
    assert sorted((tuple(r) for r in more), key=repr) == sorted(
        [h for d, i, *n in got for h in [(d, i, *n)] * 2 + [(d, i if i is None else i + 1000, *n)]], key=repr
    )
    assert sum(len(b) for b in decontaminate._item_blocks(decontaminate._distinct(decontaminate._asked(copies)))) == len(
        {r.text or "" for r in items.collect()}
    )
    assert decontaminate.contained_items(awkward, items.where("false")).count() == 0
    left = [r.doc_id for r in decontaminate.clean_rows(awkward, items).collect()]
    assert sorted(d for d in left if d) == [3, 4, 5, 6, 7, 11]


def test_minima_suffice():
    for n in range(1, 400):
        assert decontaminate.size_class(n) >= n
        assert decontaminate.minima_kept(n, 80) >= min(n, n * 20 // 100 + 1)


# -- quality ----------------------------------------------------------------


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in llm.op6_quality_classifier(spark, sf).collect()]
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    good = np.array([r.score for r in held if truth[r.doc_id]])
    bad = np.array([r.score for r in held if not truth[r.doc_id]])
    assert (good[:, None] > bad).mean() > 0.97


def test_quality_cases(spark, awkward, nothing):
    some = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None), (7, 0), (9, 1), (9, 1)], "doc_id long, quality int")
    got = by_key(quality.classify(awkward, some))
    assert sum(map(len, got.values())) == awkward.count()
    assert all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.3) for v in got.values() for r in v)
    assert got[2][0] == got[2][1] and not any(r[0] for r in got[None])
    unknown = by_key(quality.classify(awkward, some.where("false")))
    assert {r[1] for v in unknown.values() for r in v} == {0.5}
    assert quality.classify(nothing, some).count() == 0
    assert quality.keep_good(awkward, some).columns == awkward.columns


def test_bounded_risk_is_least():
    """With few positives the unbounded minimum has a negative part; by the bounded
    risk, which is what counts, the weights returned are better."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((400, 1)), rng.integers(0, 2, (400, 60))], axis=1)
    u, p = x.T @ x / 400, x[:4].T @ x[:4] / 4

    def parts(w):
        loss = lambda m, y: w @ m @ w - 2 * y * w @ m[0] + 1
        return 0.9 * loss(p, 1), loss(u, -1) - 0.9 * loss(p, -1)

    unbounded = np.linalg.lstsq(u + 1e-4 * np.eye(61), 1.8 * p[0] - u[0], rcond=None)[0]
    assert parts(unbounded)[1] < 0
    found = parts(quality.minimise(400 * u, 4 * p, 0.9))
    assert found[0] + max(0, found[1]) <= parts(unbounded)[0] + 1e-9


# -- chat -------------------------------------------------------------------


def test_chat_cases(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", "<|end|>yo", 9), (1, 3, None, None, 9),
         (1, 70, "ann", "later", 9), (1, 70, "ann", "later", 9), (2, 0, "system", "alone", 9), (None, 1, "cy", "x", 9),
         (1, None, "ann", "loose", 9)],
        "conv_id long, turn long, role string, text string, part long",
    )
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate_perspectives(turns).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (None, "cy")}
    ann = got[1, "ann", 0]
    assert ann.text == (
        "<|system|>be kind<|end|>\n<|assistant|>hi<|end|>\n<|user|>bob: < |end|>yo<|end|>\n<|user|>unknown: <|end|>\n"
    )
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi<|end|>"]
    bob = got[1, "bob", 0]
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["< |end|>yo<|end|>"]
    assert "<|user|>ann: hi" in bob.text
    late = got[1, "ann", 1]
    assert late.n_turns == 2 and [late.text[m.start : m.end] for m in late.masks] == ["later<|end|>"] * 2
    assert sum(k[2] < 0 for k in got if k[:2] == (1, "ann")) == 1
    assert chat.rotate_perspectives(turns.where("false")).count() == 0


def test_chat_is_native(spark, sf):
    plan = llm.op1_chat_perspectives(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_hot_conversation_is_cut(spark):
    """A third of all rows in one part, turn numbers repeated, no ids, equal rows, an
    empty and a very long text: every row is rendered once, in order, in bounded pieces."""
    rows = [(None, i % 7, "ab"[i % 2], f"text {i % 400}", 1) for i in range(3000)]
    rows += [(None, 3, "a", "", 1), (None, 3, "a", None, 1), (None, 3, "b", "long " * 50_000, 1), (None, 3, "a", "same", 1)]
    rows += [(None, 3, "a", "same", 1)] * 900 + [(None, None, "b", "loose", 1)] * 700
    rows += [(1, t, "ab"[t % 2], f"turn {t}", 1) for t in range(130)]
    schema = "conv_id long, turn int, role string, text string"
    turns = spark.createDataFrame(rows, schema + ", piece int").selectExpr("*", "1 AS part", "2 AS said", "3 AS lines", "4 AS speaker", "5 AS _rows")
    made = chat.rotate_perspectives(turns, piece_rows=200).collect()
    hot = [r for r in made if r.conv_id is None]
    assert max(r.n_turns for r in hot) < 600 and len({(r.part, r.piece, r.speaker) for r in hot}) == len(hot)
    plain = chat.rotate_perspectives(turns).collect()

    def whole(found):
        out = defaultdict(list)
        for r in sorted(found, key=lambda r: (r.part, r.piece)):
            out[r.conv_id, r.speaker, r.part].append(r.text)
            assert "".join(r.text[m.start : m.end] for m in r.masks).count("<|end|>") == r.text.count("<|assistant|>")
        return {k: "".join(v) for k, v in out.items()}

    assert whole(made) == whole(plain)
    assert {r.piece for r in plain} == {0} and {r.piece for r in made if r.conv_id == 1} == {0}
    plan = chat.rotate_perspectives(turns, piece_rows=200)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
