import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.catalog.search import ANN_PROBES
from askloom.operators import lexical as lx
from askloom.operators import quantized as qz
from askloom.operators import vectors as vc
from askloom.session import scratch_folder


def vectors_of(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, embedding array<float>")


def brute_topk(chunks, queries, k):
    out = {}
    for q, qv in queries:
        scored = []
        for c, cv in chunks:
            a, b = np.array(qv, dtype=float), np.array(cv if cv is not None else [0] * len(qv), dtype=float)
            norm = math.sqrt(a @ a) * math.sqrt(b @ b)
            dist = round(1 - (a @ b) / norm, 9) if norm else math.inf
            scored.append((dist, c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for row in df.orderBy("query_id", "rank").collect():
        out[row["query_id"]].append(row["chunk_id"])
    return dict(out)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    base = [(f"c{i:03d}", rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    # A third of all rows are copies of one vector, and some have no direction.
    copies = [(f"k{i:03d}", base[0][1]) for i in range(80)]
    blank = [("z0", [0.0] * 6), ("z1", None)]
    queries = [(f"q{i}", rng.normal(size=6).astype(np.float32).tolist()) for i in range(9)]
    queries.append(("same", base[0][1]))
    return base + copies + blank, queries


def test_vector_topk_is_exact(spark, clouds):
    chunks, queries = clouds
    got = vc.vector_topk(vectors_of(spark, chunks, "chunk_id"), vectors_of(spark, queries, "query_id"), 7)
    assert found(got) == brute_topk(chunks, queries, 7)


def test_vector_topk_in_a_grid_of_blocks(spark, clouds):
    chunks, queries = clouds
    got = vc.vector_topk(
        vectors_of(spark, chunks, "chunk_id"), vectors_of(spark, queries, "query_id"), 7,
        max_shipped=4, grid_chunks=50,
    )
    assert found(got) == brute_topk(chunks, queries, 7)


def test_shipping_is_bounded_in_bytes(spark, clouds, monkeypatch):
    """Wide queries take the way of many queries: chunks are shuffled once."""
    chunks, queries = clouds
    monkeypatch.setattr(vc, "MAX_SHIPPED_BYTES", 100)
    c, q = vectors_of(spark, chunks, "chunk_id"), vectors_of(spark, queries, "query_id")
    got = vc.vector_topk(c, q, 7, grid_chunks=50)
    assert found(got) == brute_topk(chunks, queries, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    missing = vectors_of(spark, [("a", None), ("b", None)], "chunk_id")
    assert [r["distance"] for r in vc.vector_topk(missing, q.limit(1), 2).collect()] == [None, None]


def test_vectors_without_direction_come_last(spark, clouds):
    chunks, queries = clouds
    got = vc.vector_topk(
        vectors_of(spark, chunks, "chunk_id"), vectors_of(spark, queries[:1], "query_id"), len(chunks)
    ).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got][-2:] == ["z0", "z1"]
    assert [r["distance"] for r in got][-2:] == [None, None]


def test_mixed_widths_are_refused(spark):
    chunks = vectors_of(spark, [("a", [1.0, 0.0]), ("b", [1.0])], "chunk_id")
    with pytest.raises(Exception, match="width"):
        vc.vector_topk(chunks, vectors_of(spark, [("q", [1.0, 0.0])], "query_id"), 1).collect()


def test_no_queries(spark):
    chunks = vectors_of(spark, [("a", [1.0, 0.0])], "chunk_id")
    assert vc.vector_topk(chunks, vectors_of(spark, [], "query_id"), 3).count() == 0


def test_ann_with_all_cells_equals_exact(spark, clouds):
    chunks, queries = clouds
    c, q = vectors_of(spark, chunks, "chunk_id"), vectors_of(spark, queries, "query_id")
    index = vc.fit_cells(c, 5)
    celled = vc.assign_cells(c, index)
    exact = brute_topk(chunks, queries, 7)
    assert found(vc.ann_topk(celled, q, 7, index, nprobe=5)) == exact
    assert found(vc.ann_topk(celled, q, 7, index, nprobe=5, max_shipped=4, grid_chunks=60)) == exact


def test_ann_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    c = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    index = vc.fit_cells(c, 16)
    exact = vc.vector_topk(c, q, 10)
    # Probes of the label cells as in the catalog query.
    for index, probes in ((index, 12), (vc.mean_cells(rows, "label"), ANN_PROBES)):
        near = vc.ann_topk(vc.assign_cells(c, index), q, 10, index, nprobe=probes)
        shared = near.join(exact, ["query_id", "chunk_id"]).count()
        assert shared / exact.count() >= 0.9


def test_quantized_recall(spark):
    """0.9 of the nearest ten, with at most a twentieth of the vectors compared."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    c = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    books = qz.fit_code_books(c, sample_rows=1000)
    coded = qz.encode_vectors(c, books)
    exact = vc.vector_topk(c, q, 10)
    lists = qz.short_lists(coded, q, books, 100)
    assert lists.count() == 100 * q.count() <= 0.05 * c.count() * q.count()
    near = qz.quantized_topk(c, coded, q, 10, books, shortlist=100)
    shared = near.join(exact, ["query_id", "chunk_id", "distance"]).count()
    assert shared / exact.count() >= 0.9
    # In rounds of few queries the lists are the same.
    few = qz.short_lists(coded, q, books, 5, max_shipped=7)
    assert found(few) == found(qz.short_lists(coded, q, books, 5))


def test_quantized_cases(spark, clouds):
    chunks, queries = clouds
    c, q = vectors_of(spark, chunks, "chunk_id"), vectors_of(spark, queries, "query_id")
    books = qz.fit_code_books(c, parts=4, codes=200)  # of two places each, the last empty
    coded = qz.encode_vectors(c, books)
    codes = {r["chunk_id"]: r["codes"] for r in coded.collect()}
    assert codes["z0"] is None and codes["z1"] is None and len(codes["c000"]) == len(books.codes)
    known = [r for r in chunks if not r[0].startswith("z")]
    assert found(qz.quantized_topk(c, coded, q, 7, books, shortlist=len(known))) == brute_topk(known, queries, 7)
    assert qz.quantized_topk(c, coded, q.where("false"), 7, books).count() == 0
    with pytest.raises(ValueError):
        qz.fit_code_books(c, parts=7)
    with pytest.raises(ValueError):
        qz.fit_code_books(c, codes=257)
    with pytest.raises(ValueError):
        qz.fit_code_books(c.where("false"))


def test_embed_text_plug_in(spark):
    import pyarrow as pa

    def lengths(batches):
        for batch in batches:
            sizes = [[float(len(t)), 1.0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, type=pa.list_(pa.float32()))],
                names=[*batch.schema.names, "embedding"],
            )

    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert vc.embed_text(df, encoder=lengths).first()["embedding"] == [3.0, 1.0]


# --------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_bm25(chunks, queries, share, k, k1=1.2, b=0.75):
    docs = {c: Counter(tokens(t)) for c, t in chunks}
    sizes = {c: sum(d.values()) for c, d in docs.items()}
    mean = sum(sizes.values()) / len(sizes)
    df = Counter(t for d in docs.values() for t in d)
    out = {}
    for q, text in queries:
        asked = set(tokens(text))
        need = max(1, math.ceil(round(len(asked) * share, 9)))
        scored = []
        for c, d in docs.items():
            held = asked & set(d)
            if not asked or len(held) < need:
                continue
            score = sum(
                math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * (k1 + 1)
                / (d[t] + k1 * (1 - b + b * sizes[c] / mean))
                for t in held
            )
            scored.append((-round(score, 9), c))
        if scored:
            out[q] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    vocabulary = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(25)]
    chunks = [(f"c{i:03d}", " ".join(rnd.choices(vocabulary, k=rnd.randint(3, 14)))) for i in range(120)]
    chunks += [("empty", ""), ("none", None)]
    queries = [(f"q{i:02d}", " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 5)))) for i in range(25)]
    queries += [("hot", "the"), ("unknown", "the zebra"), ("blank", "?!")]
    frame = spark.createDataFrame(chunks, "chunk_id string, chunk_text string")
    return [(c, t or "") for c, t in chunks], queries, frame


@pytest.mark.parametrize("share", [1.0, 0.7, 0.4])
@pytest.mark.parametrize("stored", [False, True])
def test_lexical_topk_against_counting(spark, corpus, share, stored):
    chunks, queries, frame = corpus
    if stored:
        index = lx.write_index(frame, scratch_folder(spark, "index"), buckets=4)
    else:
        index = lx.lexical_index(frame)
    asked = spark.createDataFrame(queries, "query_id string, text string")
    got = lx.lexical_topk(index, asked, 6, min_share=share)
    assert found(got) == brute_bm25(chunks, queries, share, 6)


def test_all_terms_match(spark, corpus):
    chunks, queries, frame = corpus
    asked = spark.createDataFrame(queries, "query_id string, text string")
    rows = lx.all_terms_match(lx.lexical_index(frame), asked).collect()
    want = {
        (q, c) for q, text in queries for c, chunk in chunks
        if tokens(text) and set(tokens(text)) <= set(tokens(chunk))
    }
    assert {(r["query_id"], r["chunk_id"]) for r in rows} == want
    assert all(r["n_terms"] == r["n_matched"] for r in rows)


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_every_postings_scan_is_pruned(spark, tmp_path, share):
    words = ["red", "blue", "green", "tall", "old", "new"]
    texts = [(str(i), " ".join(w for k, w in enumerate(words) if (i >> k) & 1) + f" w{i}") for i in range(64)]
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_text string")
    index = lx.write_index(chunks, str(tmp_path / "index"), buckets=64)
    # Common terms only: every word is in half of the chunks.
    queries = spark.createDataFrame([(1, "red tall new"), (2, "blue"), (3, "none")], "query_id int, text string")
    matched = lx.all_terms_match(index, queries, share)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "term#" in x and "query_id#" not in x]
    assert scans and all("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    got = {(r.query_id, r.chunk_id) for r in matched.collect()}
    asked = {1: {"red", "tall", "new"}, 2: {"blue"}}
    want = {
        (q, c) for q, terms in asked.items() for c, t in texts if len(terms & set(t.split())) >= max(1, -(-len(terms) * share // 1))
    }
    assert got == want


def test_hot_terms_are_cut(spark, monkeypatch):
    from askloom.operators import skew

    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    chunks = spark.createDataFrame([(str(i), "red " + "blue " * (i % 2)) for i in range(50)], "chunk_id string, chunk_text string")
    queries = spark.createDataFrame([(1, "red blue"), (2, "red")], "query_id int, text string")
    got = lx.all_terms_match(lx.lexical_index(chunks), queries)
    assert {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()} == {1: 25, 2: 50}


def test_from_query_to_prompt(spark, tmp_path):
    """Rejected queries are never embedded; cells serve the vector side."""
    import pyarrow as pa

    from askloom.plans import answering

    chunks = spark.createDataFrame(
        [(f"c{i}", i, f"red dog number {i}") for i in range(6)], "chunk_id string, chunk_index int, chunk_text string"
    )
    chunks = vc.embed_text(chunks, "chunk_text", dim=32)
    index = lx.write_index(chunks, str(tmp_path / "terms"), buckets=4)
    queries = spark.createDataFrame(
        [(1, "red dog"), (2, "drop table now"), (3, "zebra")], "query_id int, text string"
    )

    def encoder(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if any("drop table" in t for t in texts):
                raise ValueError("a rejected query was embedded")
            yield batch.append_column("embedding", pa.array([[1.0] * 32] * len(texts), pa.list_(pa.float32())))

    prompt = answering.Prompt("S", ("Q ", " C ", " A"), "no", "nothing")
    made = answering.answer_queries(queries, chunks, index, 3, top=2, prompt=prompt, dim=32, encoder=encoder)
    got = {r.query_id: r for r in made.collect()}
    assert got[2].route == "reject" and got[2].prompt is None and got[2].canned_answer == "unsafe"
    assert got[1].route == "answer" and got[1].prompt.startswith("S\nQ red dog C [Source 1]")
    cells = vc.fit_cells(chunks, 2)
    celled = vc.assign_cells(chunks, cells)
    asked = vc.embed_text(queries.where("query_id = 1"), "text", dim=32)
    every = answering.hybrid_search(celled, index, asked, 3, cells=cells, nprobe=2)
    plain = answering.hybrid_search(chunks, index, asked, 3)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, plain.collect()))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(SimpleNamespace(conf=conf, sparkContext=context), "x")
