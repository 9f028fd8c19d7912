"""Vector, lexical and hybrid search over the chunked documents, with gates,
reranking and prompts. The benchmark passages are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import prepared, tables
from askloom.catalog.prepared import ANY_SHARE, TOP
from askloom.catalog.registry import query
from askloom.catalog.tables import SQL_CHUNKS, SQL_QUERIES, sql_tokens, sql_vectors
from askloom.operators import blockmax, context, fusion, gates, lexical, quantized, rerank, segments, vectors
from askloom.plans import answering
from askloom.session import scratch_folder

RERANK_TOP = 5
#: Of ten cells; the recall of 0.9 that a test asks for needs so many, as the vectors
#: of the test tables hardly cluster.
ANN_PROBES = 8
PROMPT = answering.Prompt(
    system="Use only the numbered sources.",
    human=("Query: ", " Context: ", " Reply: "),
    rejection="Not accepted.",
    fallback="No source fits.",
)

# --------------------------------------------------------------------------
# SQL of the whole chain, one step per fragment

_VECTOR = f"""
{SQL_CHUNKS}, {SQL_QUERIES},
{sql_vectors('chunks', 'chunk_id', 'chunk_text', 'cv')},
{sql_vectors('queries', 'query_id', 'text', 'qv')},
dots AS (
  SELECT query_id, chunk_id, sum(qv.w * cv.w) AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
distances AS (
  SELECT q.query_id, c.chunk_id,
         round(1 - coalesce(dot, 0) / (qn.norm * cn.norm), 9) AS distance
  FROM queries q CROSS JOIN chunks c
  LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id
  LEFT JOIN qv_norm qn ON qn.query_id = q.query_id
  LEFT JOIN cv_norm cn ON cn.chunk_id = c.chunk_id),
nearest AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY distance NULLS LAST, chunk_id) AS INTEGER) AS rank FROM distances)
  WHERE rank <= {TOP})"""


def _sql_lexical(min_share: float, prefix: str = "") -> str:
    """BM25 by plain counting, without the rarest-terms shortcut."""
    return f"""
{prefix}
chunk_tokens AS (SELECT chunk_id, {sql_tokens('chunk_text')} AS ts FROM chunks),
totals AS (SELECT count(*) AS n_chunks, avg(len(ts)) AS avg_dl FROM chunk_tokens),
posted AS (
  SELECT term, chunk_id, dl, count(*) AS tf
  FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM chunk_tokens) GROUP BY ALL),
freqs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (
  SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term
  FROM (SELECT query_id, list_distinct({sql_tokens('text')}) AS ts FROM queries)),
matched AS (
  SELECT query_id, chunk_id, n_terms, count(*) AS n_matched,
         round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
  FROM asked JOIN posted USING (term) JOIN freqs USING (term) CROSS JOIN totals
  GROUP BY query_id, chunk_id, n_terms
  HAVING count(*) >= greatest(1, ceil(round(n_terms * {min_share}, 9)))),
best_terms AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM matched)
  WHERE rank <= {TOP})"""


_LISTS = f"{_VECTOR}, {_sql_lexical(1.0)}"
_FUSED = f"""{_LISTS},
fused AS (
  SELECT query_id, chunk_id, distance, score AS bm25_score,
         v.rank IS NOT NULL AS in_vector, l.rank IS NOT NULL AS in_bm25,
         coalesce(1.0::DOUBLE / (10 + v.rank), 0) + coalesce(1.0::DOUBLE / (10 + l.rank), 0)
           AS rrf_score, v.rank AS v_rank, l.rank AS l_rank
  FROM nearest v FULL JOIN best_terms l USING (query_id, chunk_id)),
ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC,
              CASE WHEN v_rank IS NULL THEN 1 ELSE 0 END, coalesce(v_rank, l_rank), chunk_id)
            AS INTEGER) AS rrf_rank FROM fused)"""
_PAIRS = f"""{_FUSED},
pairs AS (
  SELECT o.*, c.chunk_index, c.chunk_text, q.text FROM ordered o
  JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)),
covered AS (
  SELECT *, coalesce(CAST(len(list_intersect(asked_terms, pair_terms)) AS DOUBLE)
                     / nullif(len(asked_terms), 0), 0) AS rerank_score
  FROM (SELECT *, list_distinct({sql_tokens('text')}) AS asked_terms,
               {sql_tokens("chunk_index || ' ' || chunk_text")} AS pair_terms FROM pairs)),
reranked AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY rerank_score DESC, rrf_rank) AS INTEGER) AS rerank_rank FROM covered)
  WHERE rerank_rank <= {RERANK_TOP})"""
# A threshold between 1/11 and 2/11: the gate passes queries with a chunk found
# by both searches or with the same chunk on top of both.
_STRICT = 0.1
_GATE = f"""{_PAIRS},
hits AS (
  SELECT query_id, count(*) AS n_chunks, max(rrf_score) AS best_rrf,
         count(*) FILTER (in_vector AND in_bm25) AS hybrid_hits FROM ordered GROUP BY query_id),
gated AS (
  SELECT q.query_id, q.text, CASE WHEN n_chunks IS NULL THEN 'no_chunks'
           WHEN best_rrf < {_STRICT} AND hybrid_hits = 0 THEN 'low_retrieval_confidence' END
           AS fallback_reason
  FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id)"""


# --------------------------------------------------------------------------
# vector search over the embeddings table: vectors whose id is divisible by 50 are
# the queries, all vectors are searched


def _neighbours(spark, sf):
    rows = tables.table(spark, sf, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.where(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), "embedding"
    )
    return chunks, queries


SQL_NEIGHBOURS = """
units AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings),
cosines AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS q_label, c.label AS c_label,
         round(list_cosine_distance(q.e, c.e), 9) AS distance
  FROM units q CROSS JOIN units c WHERE q.vec_id % 50 = 0),
neighbours AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, chunk_id)
                 AS INTEGER) AS rank FROM cosines)"""


@query(
    "vector_topk",
    f"""WITH {SQL_NEIGHBOURS}
    SELECT query_id, chunk_id, round(distance, 6) AS distance, rank
    FROM neighbours WHERE rank <= 10""",
)
def vector_topk(spark, sf):
    found = vectors.vector_topk(*_neighbours(spark, sf), 10)
    return found.withColumn("distance", F.round("distance", 6))


# Cells by the mean vector of each label; a vector belongs to the nearest.
_SQL_CELLS = f"""{SQL_NEIGHBOURS},
lengths AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u
  FROM units WHERE list_dot_product(e, e) > 0),
placed AS (
  SELECT label, u[i] AS x, i FROM (SELECT label, u, unnest(range(1, len(u) + 1)) AS i FROM lengths)
  WHERE label IS NOT NULL),
centroids AS (
  SELECT label AS cell, list(x ORDER BY i) AS c FROM (
    SELECT label, i, avg(x) AS x FROM placed GROUP BY label, i) GROUP BY label),
nearness AS (
  SELECT vec_id, cell, row_number() OVER (
    PARTITION BY vec_id ORDER BY list_cosine_distance(e, c), cell) AS place
  FROM units CROSS JOIN centroids)"""


@query(
    "ann_topk",
    f"""WITH {_SQL_CELLS},
    found AS (
      SELECT query_id, chunk_id, distance, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY distance NULLS LAST, chunk_id) AS INTEGER) AS rank
      FROM cosines JOIN nearness c ON c.vec_id = chunk_id AND c.place = 1
      JOIN nearness q ON q.vec_id = query_id AND q.place <= {ANN_PROBES} AND q.cell = c.cell)
    SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM found WHERE rank <= 10""",
)
def ann_topk(spark, sf):
    celled, index = prepared.cell_index(spark, sf)
    return vectors.ann_topk(celled, _neighbours(spark, sf)[1], 10, index, nprobe=ANN_PROBES).withColumn(
        "distance", F.round("distance", 6)
    )


@query(
    "quantized_topk",
    f"""WITH {SQL_NEIGHBOURS}
    SELECT query_id, chunk_id, round(distance, 6) AS distance, rank
    FROM neighbours WHERE rank <= 10""",
)
def quantized_topk(spark, sf):
    """Codes first, then the exact distances of a short list. The SQL is the exact
    search: on small tables a list of 100 holds all of its answers."""
    coded, books = prepared.code_index(spark, sf)
    found = quantized.quantized_topk(_neighbours(spark, sf)[0], coded, _neighbours(spark, sf)[1], 10, books)
    return found.withColumn("distance", F.round("distance", 6))


# --------------------------------------------------------------------------
# lexical search


@query(
    "all_terms_match",
    f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {_sql_lexical(1.0)}
    SELECT query_id, chunk_id, CAST(n_terms AS INTEGER) AS n_terms,
           CAST(n_matched AS INTEGER) AS n_matched FROM matched""",
)
def all_terms_match(spark, sf):
    t = prepared.search_tables(spark, sf)
    return lexical.all_terms_match(t.index, t.queries)


@query(
    "lexical_topk",
    f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {_sql_lexical(1.0)}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best_terms""",
)
def lexical_topk(spark, sf):
    t = prepared.search_tables(spark, sf)
    return lexical.lexical_topk(t.index, t.queries, TOP).withColumn("score", F.round("score", 6))


@query(
    "any_term_topk",
    f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {_sql_lexical(ANY_SHARE)}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best_terms""",
)
def any_term_topk(spark, sf):
    t = prepared.search_tables(spark, sf)
    return lexical.any_term_topk(t.index, t.queries, TOP, min_share=ANY_SHARE).withColumn(
        "score", F.round("score", 6)
    )


@query(
    "blockmax_topk",
    f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {_sql_lexical(ANY_SHARE)}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best_terms""",
)
def blockmax_topk(spark, sf):
    t, index = prepared.search_tables(spark, sf), prepared.block_index(spark, sf)
    return blockmax.blockmax_topk(index, t.queries, TOP, min_share=ANY_SHARE).withColumn(
        "score", F.round("score", 6)
    )


@query(
    "index_appends",
    f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {_sql_lexical(ANY_SHARE)}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best_terms""",
)
def index_appends(spark, sf):
    """The search over an index that was built by two appends and a delete: a fourth
    of the chunks come with other texts first, and some that are no chunks go again."""
    t = prepared.search_tables(spark, sf)
    chunks = t.texts
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(4))
    other = chunks.where(part == 0).select("chunk_id", F.reverse("chunk_text").alias("chunk_text"))
    extra = chunks.where(part == 1).select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), "chunk_text")
    index = segments.SegmentedIndex(spark, scratch_folder(spark, "segments"), buckets=8)
    index.append(chunks.where(part >= 2).select("chunk_id", "chunk_text").unionByName(other).unionByName(extra))
    index.append(chunks.where(part < 2).select("chunk_id", "chunk_text"))
    index.delete(extra.select("chunk_id"))
    return lexical.any_term_topk(index.read(), t.queries, TOP, min_share=ANY_SHARE).withColumn(
        "score", F.round("score", 6)
    )


def _sql_covers(min_share: float) -> str:
    """Covers by comparing all places of a query's terms in a chunk with each other."""
    return f"""
tokens AS (SELECT chunk_id, {sql_tokens('chunk_text')} AS ts FROM chunks),
placed AS (
  SELECT chunk_id, ts[i] AS term, i FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM tokens)),
asked AS (
  SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term
  FROM (SELECT query_id, list_distinct({sql_tokens('text')}) AS ts FROM queries)),
spots AS (SELECT query_id, chunk_id, n_terms, term, i FROM asked JOIN placed USING (term)),
held AS (
  SELECT query_id, chunk_id, count(DISTINCT term) AS n FROM spots GROUP BY query_id, chunk_id, n_terms
  HAVING count(DISTINCT term) >= greatest(1, ceil(round(n_terms * {min_share}, 9)))),
lasts AS (
  SELECT a.query_id, a.chunk_id, n, a.i AS stop, b.term, max(b.i) AS last
  FROM held JOIN spots a USING (query_id, chunk_id) JOIN spots b
    ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.i <= a.i GROUP BY ALL),
runs AS (
  SELECT query_id, chunk_id, n, stop, min(last) AS start FROM lasts
  GROUP BY ALL HAVING count(*) = n),
covers AS (
  SELECT query_id, chunk_id, n, start, min(stop) AS stop FROM runs GROUP BY query_id, chunk_id, n, start),
dense AS (
  SELECT query_id, chunk_id, CAST(count(*) AS INTEGER) AS n_covers,
         round(sum(n::DOUBLE / (stop - start + 1)), 9) AS score FROM covers GROUP BY query_id, chunk_id),
nearest_terms AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER)
              AS rank FROM dense)"""


@query(
    "proximity_topk",
    f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {_sql_covers(ANY_SHARE)}
    SELECT query_id, chunk_id, n_covers, round(score, 6) AS score, rank
    FROM nearest_terms WHERE rank <= {TOP}""",
)
def proximity_topk(spark, sf):
    t, index = prepared.search_tables(spark, sf), prepared.positional_index(spark, sf)
    return lexical.proximity_topk(index, t.queries, TOP, min_share=ANY_SHARE).withColumn(
        "score", F.round("score", 6)
    )


# --------------------------------------------------------------------------
# fusion


@query(
    "list_rank",
    f"""WITH {_VECTOR}
    SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY distance DESC NULLS LAST, chunk_id) AS INTEGER) AS place FROM nearest""",
)
def list_rank(spark, sf):
    nearest, _ = prepared.ranked_lists(spark, sf)
    return fusion.list_rank(nearest, F.col("distance").desc_nulls_last(), rank="place").select(
        "query_id", "chunk_id", "place"
    )


@query(
    "topk_per_query",
    f"""WITH {_LISTS} SELECT query_id, chunk_id FROM best_terms WHERE rank <= 3""",
)
def topk_per_query(spark, sf):
    _, best_terms = prepared.ranked_lists(spark, sf)
    return fusion.topk_per_query(best_terms, 3, F.col("score").desc()).select(
        "query_id", "chunk_id"
    )


@query(
    "union_lists",
    f"""WITH {_LISTS}
    SELECT query_id, chunk_id, rank, 'vector' AS source, 1 AS list_no FROM nearest UNION ALL
    SELECT query_id, chunk_id, rank, 'bm25' AS source, 2 AS list_no FROM best_terms""",
)
def union_lists(spark, sf):
    nearest, best_terms = prepared.ranked_lists(spark, sf)
    return fusion.union_lists(vector=nearest, bm25=best_terms)


@query(
    "rrf",
    f"""WITH {_FUSED}
    SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, rrf_rank AS rank FROM ordered""",
)
def rrf(spark, sf):
    return fusion.rrf(union_lists(spark, sf)).withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "merge_ranked",
    f"""WITH {_FUSED}
    SELECT query_id, chunk_id, round(distance, 6) AS distance, round(bm25_score, 6) AS bm25_score,
           in_vector, in_bm25, coalesce(v_rank, l_rank) AS rank FROM ordered""",
)
def merge_ranked(spark, sf):
    nearest, best_terms = prepared.ranked_lists(spark, sf)
    merged = fusion.merge_ranked(
        nearest, best_terms.withColumnRenamed("score", "bm25_score")
    )
    return merged.withColumns(
        {"distance": F.round("distance", 6), "bm25_score": F.round("bm25_score", 6)}
    )


_SQL_ORDERED = """query_id, chunk_id, round(distance, 6) AS distance,
  round(bm25_score, 6) AS bm25_score, in_vector, in_bm25, round(rrf_score, 9) AS rrf_score,
  rrf_rank"""


def _rounded(df):
    return df.withColumns(
        {
            "distance": F.round("distance", 6),
            "bm25_score": F.round("bm25_score", 6),
            "rrf_score": F.round("rrf_score", 9),
        }
    )


@query("attach_scores", f"WITH {_FUSED} SELECT {_SQL_ORDERED} FROM ordered")
def attach_scores(spark, sf):
    nearest, best_terms = prepared.ranked_lists(spark, sf)
    merged = fusion.merge_ranked(
        nearest.drop("rank"), best_terms.drop("rank").withColumnRenamed("score", "bm25_score")
    )
    lists = fusion.union_lists(vector=nearest, bm25=best_terms)
    return _rounded(fusion.attach_scores(merged, fusion.rrf(lists)))


@query("hybrid_search", f"WITH {_FUSED} SELECT {_SQL_ORDERED} FROM ordered")
def hybrid_search(spark, sf):
    t = prepared.search_tables(spark, sf)
    return _rounded(
        answering.hybrid_search(t.chunks, t.index, t.queries, TOP)
    )


@query(
    "dedupe_chunks",
    f"""WITH {_LISTS},
    both_lists AS (SELECT query_id, chunk_id, rank, 1 AS list_no FROM nearest UNION ALL
             SELECT query_id, chr(9) || chunk_id || chr(10) AS chunk_id, rank, 2 AS list_no FROM best_terms)
    SELECT query_id, chunk_id, list_no FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, trim(chunk_id, chr(9) || chr(10))
                                   ORDER BY list_no, rank) AS first FROM both_lists)
    WHERE first = 1""",
)
def dedupe_chunks(spark, sf):
    lists = union_lists(spark, sf)
    padded = lists.withColumn(
        "chunk_id",
        F.when(F.col("list_no") == 2, F.concat(F.lit("\t"), "chunk_id", F.lit("\n"))).otherwise(
            F.col("chunk_id")
        ),
    )
    return fusion.dedupe_chunks(padded, F.col("list_no"), F.col("rank")).select(
        "query_id", "chunk_id", "list_no"
    )


@query(
    "hybrid_hits",
    f"""WITH {_GATE}
    SELECT query_id, n_chunks, round(best_rrf, 9) AS best_rrf, hybrid_hits FROM hits""",
)
def hybrid_hits(spark, sf):
    return fusion.hybrid_hits(prepared.fused(spark, sf)).withColumn(
        "best_rrf", F.round("best_rrf", 9)
    )


# --------------------------------------------------------------------------
# gates


def _questions(spark, sf):
    """User turns as incoming queries. Those of the first turn ask for trouble,
    and system turns keep two characters only."""
    return tables.table(spark, sf, "conversations").select(
        F.concat(F.lit("v"), "conv_id", F.lit("_"), "turn").alias("query_id"),
        F.when(F.col("role") == "system", F.lit(" ?"))
        .when(
            (F.col("role") == "user") & (F.col("turn") == 0),
            F.concat(F.col("text"), F.lit(" Then DROP TABLE users!")),
        )
        .otherwise(F.col("text"))
        .alias("text"),
    )


@query(
    "moderation_gate",
    """WITH asked AS (
      SELECT 'v' || conv_id || '_' || turn AS query_id,
             CASE WHEN role = 'system' THEN ' ?'
                  WHEN role = 'user' AND turn = 0 THEN text || ' Then DROP TABLE users!'
                  ELSE text END AS text FROM conversations),
    judged AS (
      SELECT query_id, CASE WHEN length(text) < 3 THEN 'too short'
        WHEN contains(lower(text), 'drop table') OR contains(lower(text), 'system prompt')
          OR contains(lower(text), 'delete database')
          OR contains(lower(text), 'ignore previous instructions') THEN 'unsafe' END
        AS reject_reason FROM asked)
    SELECT query_id, reject_reason, reject_reason IS NULL AS is_allowed FROM judged""",
)
def moderation_gate(spark, sf):
    return gates.moderation_gate(_questions(spark, sf)).drop("text")


def _queries_and_lists(spark, sf):
    """Fused lists of benchmark queries as gates see them."""
    return prepared.search_tables(spark, sf).queries.select("query_id", "text"), prepared.fused(
        spark, sf
    )


@query(
    "retrieval_gate",
    f"""WITH {_GATE}
    SELECT query_id, fallback_reason, fallback_reason IS NULL AS retrieval_ok FROM gated""",
)
def retrieval_gate(spark, sf):
    return gates.retrieval_gate(*_queries_and_lists(spark, sf), _STRICT).drop("text")


@query(
    "top1_gate",
    f"""WITH {_GATE},
    tops AS (SELECT query_id, rrf_score AS top FROM ordered WHERE rrf_rank = 1),
    judged AS (
      SELECT q.query_id, CASE WHEN top IS NULL THEN 'no relevant documents'
          WHEN top < {_STRICT} THEN 'weakly related documents' END AS reject_reason
      FROM queries q LEFT JOIN tops t ON t.query_id = q.query_id)
    SELECT query_id, reject_reason, reject_reason IS NULL AS retrieval_passed FROM judged""",
)
def top1_gate(spark, sf):
    queries, fused = _queries_and_lists(spark, sf)
    ranked = fused.withColumnRenamed("rrf_rank", "rank")
    return gates.top1_gate(queries, ranked, min_score=_STRICT).drop("text")


_SQL_REJECT = """CASE WHEN length(text) < 100 THEN 'unsafe' END"""


@query(
    "route_outcome",
    f"""WITH {_GATE},
    routed AS (
      SELECT query_id, {_SQL_REJECT} AS reject_reason,
        CASE WHEN length(text) < 100 THEN 'reject' WHEN fallback_reason IS NOT NULL THEN 'fallback'
          ELSE 'answer' END AS route FROM gated)
    SELECT query_id, route, CASE route WHEN 'reject' THEN reject_reason
        WHEN 'fallback' THEN '{PROMPT.fallback}' END AS canned_answer FROM routed""",
)
def route_outcome(spark, sf):
    queries, fused = _queries_and_lists(spark, sf)
    # A short passage stands for an unsafe query.
    unsafe = queries.withColumn(
        "text",
        F.when(F.length("text") < 100, F.concat(F.col("text"), F.lit(" drop table"))).otherwise(
            F.col("text")
        ),
    )
    moderated = gates.moderation_gate(unsafe)
    gated = gates.route_outcome(
        gates.retrieval_gate(moderated, fused, _STRICT),
        rejection=PROMPT.rejection, fallback=PROMPT.fallback,
    )
    return gated.select("query_id", "route", "canned_answer")


# --------------------------------------------------------------------------
# reranking and prompts

_SQL_RERANKED = """SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, rerank_rank
    FROM reranked"""


@query("rerank", f"WITH {_PAIRS} {_SQL_RERANKED}")
def rerank_pairs(spark, sf):
    return rerank.rerank(prepared.pairs(spark, sf), RERANK_TOP).select(
        "query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank"
    )


@query(
    "rerank_topk",
    f"""WITH {_PAIRS}
    SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY score DESC, rrf_rank) AS INTEGER) AS rerank_rank
    FROM (SELECT *, length(chunk_text) // 100 AS score FROM pairs)
    QUALIFY rerank_rank <= 3""",
)
def rerank_topk(spark, sf):
    scored = prepared.pairs(spark, sf).withColumn(
        "rerank_score", F.floor(F.length("chunk_text") / 100)
    )
    return rerank.rerank_topk(scored, 3).select("query_id", "chunk_id", "rerank_rank")


@query(
    "search_tool",
    f"""WITH {_PAIRS},
    kept AS (SELECT * FROM reranked WHERE length(text) >= 100)
    SELECT query_id, chunk_id, rerank_rank FROM kept UNION ALL
    SELECT query_id, chunk_id, NULL AS rerank_rank FROM ordered
    WHERE query_id NOT IN (SELECT query_id FROM kept)""",
)
def search_tool(spark, sf):
    """Short passages have no reranked chunks and fall back to the fused ones."""
    pairs = prepared.pairs(spark, sf)
    reranked = rerank.rerank(pairs.where(F.length("text") >= 100), RERANK_TOP)
    return rerank.search_tool(
        reranked.select("query_id", "chunk_id", "rerank_rank"),
        prepared.fused(spark, sf).select("query_id", "chunk_id"),
    )


# --------------------------------------------------------------------------
# contexts: the reranked chunks of every query, the second one blanked


def _partly_blank(spark, sf):
    best = rerank.rerank(prepared.pairs(spark, sf), RERANK_TOP)
    return best.select(
        "query_id",
        F.col("rerank_rank").alias("rank"),
        "chunk_id",
        F.when(F.col("rerank_rank") != 3, F.col("chunk_index")).alias("rerank_score"),
        F.when(F.col("rerank_rank") == 2, F.lit("  ")).otherwise(F.col("chunk_text")).alias(
            "chunk_text"
        ),
    )


_BLANKED = f"""{_PAIRS},
shown AS (
  SELECT query_id, rerank_rank AS rank, chunk_id,
         CASE WHEN rerank_rank <> 3 THEN chunk_index END AS rerank_score,
         CASE WHEN rerank_rank = 2 THEN '  ' ELSE chunk_text END AS chunk_text
  FROM reranked),
contexts AS (
  SELECT query_id,
         coalesce(string_agg('[Source ' || rank || ']' || chr(10) || 'Text: ' || chunk_text,
                             chr(10) || chr(10) ORDER BY rank) FILTER (rank <> 2), '') AS context
  FROM shown GROUP BY query_id)"""


@query("build_context", f"WITH {_BLANKED} SELECT * FROM contexts")
def build_context(spark, sf):
    return context.build_context(_partly_blank(spark, sf))


@query(
    "agent_context",
    f"""WITH {_BLANKED}
    SELECT query_id, string_agg(
             '[Document ' || rank || ']' || chr(10) || 'chunk_id: ' || chunk_id || chr(10)
             || 'rerank_score: ' || coalesce(CAST(rerank_score AS VARCHAR), 'None') || chr(10)
             || 'text: ' || chunk_text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM shown GROUP BY query_id""",
)
def agent_context(spark, sf):
    return context.agent_context(_partly_blank(spark, sf))


def sql_prompt(query_text: str, context_text: str) -> str:
    before, between, after = PROMPT.human
    head = (PROMPT.system + "\n" + before).replace("'", "''")
    return f"'{head}' || {query_text} || '{between}' || coalesce({context_text}, '') || '{after}'"


@query(
    "build_prompt",
    f"""WITH {_BLANKED}
    SELECT query_id, {sql_prompt("text", 'context')} AS prompt
    FROM contexts JOIN queries USING (query_id)""",
)
def build_prompt(spark, sf):
    asked = prepared.search_tables(spark, sf).queries.select("query_id", "text")
    return build_context(spark, sf).join(asked, "query_id").select(
        "query_id",
        context.build_prompt(
            F.col("text"), F.col("context"), system=PROMPT.system, human=PROMPT.human
        ).alias("prompt"),
    )


@query(
    "rag_context",
    f"""WITH {_GATE},
    contexts AS (
      SELECT query_id, string_agg('[Source ' || rerank_rank || ']' || chr(10) || 'Text: '
               || chunk_text, chr(10) || chr(10) ORDER BY rerank_rank) AS context
      FROM reranked GROUP BY query_id),
    routed AS (
      SELECT *, CASE WHEN fallback_reason IS NULL THEN 'answer' ELSE 'fallback' END AS route
      FROM gated)
    SELECT r.query_id, route, CASE WHEN route = 'answer' THEN context END AS context,
           CASE WHEN route = 'answer' THEN {sql_prompt('r.text', 'context')} END AS prompt,
           CASE WHEN route = 'fallback' THEN '{PROMPT.fallback}' END AS canned_answer
    FROM routed r LEFT JOIN contexts c ON c.query_id = r.query_id""",
)
def rag_context(spark, sf):
    t = prepared.search_tables(spark, sf)
    return answering.answer_queries(
        tables.benchmark_queries(spark, sf), t.chunks, t.index, TOP,
        top=RERANK_TOP, prompt=PROMPT, dim=tables.DIM, min_rrf=_STRICT,
    )
