"""Term indexes: places of terms, segments that follow inserts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from askloom.operators import blockmax as bm
from askloom.operators import lexical as lx
from askloom.operators import segments
from askloom.operators.segments import SegmentedIndex
from askloom.session import scratch_folder


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    words = ["the"] * 20 + ["of"] * 8 + [f"w{i}" for i in range(12)]
    chunks = [(f"c{i:03d}", " ".join(rnd.choices(words, k=rnd.randint(2, 30)))) for i in range(90)]
    chunks += [("empty", ""), ("none", None), ("near", "w1 w2 the w2 w1 w1"), ("twice", "the the of the")]
    asked = [(f"q{i:02d}", " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(20)]
    asked += [("blank", "?"), ("unknown", "zebra")]
    return chunks, spark.createDataFrame(asked, "query_id string, text string"), asked


def frame(spark, chunks):
    return spark.createDataFrame(chunks, "chunk_id string, chunk_text string")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_covers(tokens, terms):
    """Runs that hold all terms and no smaller such run, by trying all."""
    n = len(tokens)
    runs = [(a, b) for a in range(n) for b in range(a, n) if terms <= set(tokens[a : b + 1])]
    return [
        (a, b) for a, b in runs
        if not any(c >= a and d <= b and (c, d) != (a, b) for c, d in runs)
    ]


@pytest.mark.parametrize("share", [1.0, 0.5])
@pytest.mark.parametrize("stored", [False, True])
def test_proximity_against_all_runs(spark, corpus, share, stored):
    chunks, queries, asked = corpus
    rows = frame(spark, chunks)
    index = (
        lx.write_index(rows, scratch_folder(spark, "places"), buckets=4, positions=True)
        if stored else lx.lexical_index(rows, positions=True)
    )
    got = lx.proximity_topk(index, queries, 7, min_share=share)
    want = []
    for q, text in asked:
        terms = set(re.findall(r"\w+", text))
        scored = []
        for c, chunk in chunks:
            tokens = (chunk or "").split()
            held = terms & set(tokens)
            if terms and len(held) >= max(1, -(-len(terms) * share // 1)):
                covers = brute_covers(tokens, held)
                scored.append((-round(sum(len(held) / (b - a + 1) for a, b in covers), 9), c, len(covers)))
        want += [(q, c, n, -s, i) for i, (s, c, n) in enumerate(sorted(scored)[:7], 1)]
    assert found(got) == sorted(want, key=repr)


@pytest.mark.parametrize("stored", [False, True])
def test_thinning_changes_no_row(spark, corpus, monkeypatch, stored):
    """The second rarest term is only looked at where the rarest is common."""
    chunks, queries, _ = corpus
    rows = frame(spark, chunks)
    index = lx.write_index(rows, scratch_folder(spark, "thin"), buckets=4) if stored else lx.lexical_index(rows)
    made = []
    for bound in (lx.THIN_FROM, 5):
        monkeypatch.setattr(lx, "THIN_FROM", bound)
        made.append(found(lx.all_terms_match(index, queries)))
    assert made[0] == made[1] and len(made[0]) > 20


def test_proximity_needs_positions(spark, corpus):
    with pytest.raises(ValueError, match="positions"):
        lx.proximity_topk(lx.lexical_index(frame(spark, corpus[0])), corpus[1], 3)


def test_blockmax_leaves_blocks_out(spark):
    """The rows of the plain search; of common terms only a part of the postings is read."""
    rnd = random.Random(4)
    words = ["the"] * 3 + ["of"] * 2 + [f"w{i}" for i in range(30)]
    # Few chunks are rich in the common terms, so most blocks can't reach the best.
    chunks = [(f"c{i:04d}", " ".join(rnd.choices(words, k=rnd.randint(40, 60)))) for i in range(1500)]
    chunks += [(f"r{i:04d}", "the of " * rnd.randint(10, 15)) for i in range(12)] + [("empty", ""), ("none", None)]
    rows = frame(spark, chunks)
    asked = spark.createDataFrame(
        [(1, "the of"), (2, "the"), (3, "of the w1"), (4, "zebra the"), (5, "?"), (6, "w2 w3 w4")], "query_id int, text string"
    )
    index = bm.write_blocks(rows, scratch_folder(spark, "blocks"), buckets=4, block_chunks=16)
    plain = lx.lexical_index(rows)
    for share in (1.0, 0.5):
        want = found(lx.any_term_topk(plain, asked, 5, min_share=share))
        assert found(bm.blockmax_topk(index, asked, 5, min_share=share)) == want
        assert found(bm.blockmax_topk(index, asked, 5, min_share=share, lead=1)) == want
    seen = []
    common = asked.where("query_id < 3")
    got = bm.blockmax_topk(index, common, 5, watch=seen.append)
    assert found(got) == found(lx.any_term_topk(plain, common, 5))
    blocks = index.maxima.where("term IN ('the', 'of')").groupBy("block").count().count()
    assert blocks > 90 and seen[0].count() + 2 * bm.LEAD_BLOCKS < 0.5 * 2 * blocks
    assert bm.blockmax_topk(bm.write_blocks(rows.where("false"), scratch_folder(spark, "blocks"), buckets=2), asked, 5).count() == 0


def same_index(spark, index, chunks, queries, search=False):
    """The segments hold what an index of the chunks does."""
    plain, read = lx.lexical_index(frame(spark, chunks)), index.read()
    columns = ("term", "chunk_id", "tf", "dl")
    assert found(read.postings.select(*columns)) == found(plain.postings.select(*columns))
    assert found(read.terms.select("term", "df")) == found(plain.terms.select("term", "df"))
    a, b = read.totals.first(), plain.totals.first()
    assert a["n_chunks"] == b["n_chunks"] and a["avg_dl"] == pytest.approx(b["avg_dl"])
    if search:
        got, want = (found(lx.lexical_topk(x, queries, 5, min_share=0.5)) for x in (read, plain))
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]


def test_appends_equal_a_rebuild(spark, corpus):
    chunks, queries, _ = corpus
    index = SegmentedIndex(spark, scratch_folder(spark, "segments"), buckets=4)
    assert found(lx.lexical_topk(index.read(), queries, 5)) == []
    first = [("c000", "w1 of an older text"), ("none", "w3 now"), *chunks[5:60]]
    index.append(frame(spark, first))
    same_index(spark, index, first, queries)
    index.append(frame(spark, [*chunks[:10], *chunks[60:]]))
    same_index(spark, index, chunks, queries)
    index.append(frame(spark, chunks[3:4]))  # the third version of a chunk
    index.append(frame(spark, []))
    same_index(spark, index, chunks, queries, search=True)
    index.delete(frame(spark, chunks[20:30] + [("not there", "")]))
    left = chunks[:20] + chunks[30:]
    same_index(spark, index, left, queries)
    assert len(index.segments()) == 5
    index.compact()
    assert len(index.segments()) == 1
    same_index(spark, index, left, queries)
    index.append(frame(spark, chunks[20:25] + [("c000", "again")]))
    same_index(spark, index, [("c000", "again"), *left[1:], *chunks[20:25]], queries)
    index.delete(frame(spark, chunks))
    assert index.read().totals.first()["n_chunks"] == 0


def test_append_reads_no_older_text(spark, corpus, monkeypatch):
    """A second append reads the older chunk lists, neither postings nor texts, and
    one that fails before its end is not seen."""
    chunks, queries, _ = corpus
    index = SegmentedIndex(spark, scratch_folder(spark, "segments"), buckets=4)
    index.append(frame(spark, chunks[:50]))
    read, plain = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **o: read.extend(p) or plain(self, *p, **o))
    index.append(frame(spark, chunks[50:]))
    older = [p for p in read if index.path in p]
    assert older and not any("/postings/" in p for p in older)
    monkeypatch.setattr(SegmentedIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.append(frame(spark, [("c001", "never seen")]))
    monkeypatch.undo()
    same_index(spark, index, chunks, queries)
    plan = lx.all_terms_match(index.read(), queries)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "/postings/" in x and "query_id#" not in x]
    assert all("bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)


@pytest.mark.parametrize("positions", [False, True])
def test_postings_shuffle_no_tokens(spark, positions):
    """Tokens are counted in the rows; rows that share an id count as one chunk."""
    once = [("a", "x y x"), ("b", None), ("c", "")]
    plan = lx.postings(frame(spark, once), positions=positions)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    more = [*once, ("d", "x z"), ("d", "z x"), ("d", "z"), (None, "x"), (None, "x")]
    columns = ["term", "chunk_id", "tf", "dl", *(["positions"] if positions else [])]
    want = [
        ("x", "a", 2, 3, [0, 2]), ("y", "a", 1, 3, [1]), ("x", "d", 2, 2, [0, 1]), ("z", "d", 2, 2, [0, 1]),
        ("z", "d", 1, 1, [0]), ("x", None, 2, 1, [0, 0]),
    ]
    want = sorted((r[: len(columns)] for r in want), key=repr)
    rows = frame(spark, more)
    assert found(lx.postings(rows, positions=positions).select(*columns)) == want
    stored = lx.write_index(rows, scratch_folder(spark, "repeated"), buckets=3, positions=positions)
    assert found(stored.postings.select(*columns)) == want


def test_index_is_dealt_without_a_sample(spark, corpus):
    """One shuffle of a row per chunk and bucket; ranges would make the postings twice."""
    lists = lx.term_lists(frame(spark, corpus[0]))
    dealt = lx.by_bucket(lists, 4, 90)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    want = lx.postings(frame(spark, corpus[0]))
    assert found(dealt.select("term", "chunk_id", "tf", "dl")) == found(want)


def test_superseded_chunks_shuffle_no_postings(spark, corpus, monkeypatch):
    """They are a bit each: postings and lists are filtered where they are read, and no
    terms of theirs are moved or stored again."""
    chunks, queries, _ = corpus
    plain = segments.broadcast_if_small
    monkeypatch.setattr(segments, "broadcast_if_small", lambda df, **b: plain(df, max_rows=8))
    index = SegmentedIndex(spark, scratch_folder(spark, "segments"), buckets=2)
    index.append(frame(spark, [(i, f"{t} older" if t else t) for i, t in chunks]))
    index.append(frame(spark, chunks[:60]))
    index.delete(frame(spark, chunks[85:]))
    assert "terms" not in spark.read.parquet(f"{index.path}/superseded").columns
    postings = index.read().postings
    assert "Exchange hashpartitioning" not in postings._jdf.queryExecution().executedPlan().toString()
    left = chunks[:60] + [(i, f"{t} older") for i, t in chunks[60:85]]
    same_index(spark, index, left, queries)


def test_rows_that_share_an_id_go_together(spark):
    """Each counts in the statistics, their postings are one by length."""
    index = SegmentedIndex(spark, scratch_folder(spark, "segments"), buckets=2)
    index.append(frame(spark, [("a", "x y x"), ("a", "x z z"), ("a", "x"), ("b", "x"), (None, "y")]))
    read, columns = index.read(), ("term", "chunk_id", "tf", "dl")
    assert found(read.postings.select(*columns)) == sorted([
        ("x", "a", 3, 3), ("y", "a", 1, 3), ("z", "a", 2, 3), ("x", "a", 1, 1), ("x", "b", 1, 1), ("y", None, 1, 1),
    ], key=repr)
    assert found(read.terms) == [("x", 4), ("y", 2), ("z", 1)]
    assert tuple(read.totals.first()) == (5, 9 / 5)
    index.append(frame(spark, [("a", "w")]))
    read = index.read()
    assert found(read.terms) == [("w", 1), ("x", 1), ("y", 1)] and read.totals.first()["n_chunks"] == 3
    index.compact()
    assert found(index.read().postings.select(*columns)) == sorted([("w", "a", 1, 1), ("x", "b", 1, 1), ("y", None, 1, 1)], key=repr)


def test_many_candidates_are_sent_as_bits(spark, corpus, monkeypatch):
    """Beyond what is sent as lookups, postings are kept by bits, and no ids are sent."""
    chunks, queries, _ = corpus
    index = lx.write_index(frame(spark, chunks), scratch_folder(spark, "bits"), buckets=4)
    want = found(lx.lexical_topk(index, queries, 5, min_share=0.5))
    seen, plain = [], lx.fits_broadcast
    monkeypatch.setattr(lx, "fits_broadcast", lambda df, **b: seen.append(df.columns) or "_words" in df.columns and plain(df, **b))
    assert found(lx.lexical_topk(index, queries, 5, min_share=0.5)) == want
    assert seen[1:] == [["_map", "_words"]]


def test_attach_scores_searches_once(spark, sf, monkeypatch):
    """The lists that are merged are those that are fused."""
    from askloom.catalog import prepared, search

    made = []
    lists = tuple(
        spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.7, 2)], f"query_id long, chunk_id string, {value} double, rank int")
        for value in ("distance", "score")
    )
    monkeypatch.setattr(prepared, "ranked_lists", lambda *a: made.append(a) or lists)
    assert search.attach_scores(spark, sf).count() == 2 and len(made) == 1


def test_queries_beyond_shipping_score_the_same(spark, corpus, monkeypatch):
    """Blocks as products and blocks as joins; queries that share an id count twice in both."""
    chunks, queries, asked = corpus
    index = bm.write_blocks(frame(spark, chunks), scratch_folder(spark, "blocks"), buckets=2, block_chunks=8)
    twice = queries.unionByName(queries.limit(3))
    got = found(bm.blockmax_topk(index, twice, 5, lead=1))
    monkeypatch.setattr(bm, "MAX_SHIPPED_TERMS", 0)
    assert found(bm.blockmax_topk(index, twice, 5, lead=1)) == got and len(got) > 40


def test_blocks_are_grouped_and_scored_without_spilled_rows(spark, corpus):
    """No row per posting is grouped, and no row per query and chunk is shuffled."""
    index = bm.write_blocks(frame(spark, corpus[0]), scratch_folder(spark, "blocks"), buckets=2, block_chunks=8)
    plan = bm.blockmax_topk(index, corpus[1], 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(query_id#" not in plan.split("MapInArrow", 1)[1]
    rows = index.lists.select("term", "block", F.size("posted").alias("n"))
    assert found(rows) == found(index.maxima.select("term", "block", "n")) != []
