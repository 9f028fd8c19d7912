"""Text functions over pages, documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog.registry import query
from askloom.catalog.tables import sql_clean, sql_squeeze, sql_tokens, sql_words, table, texts
from askloom.functions import text as tx
from askloom.operators import analytics
from askloom.operators.lookups import lemmatize

STOP_WORDS = ("the", "of", "and", "la", "le", "der", "und", "de", "que")
LEMMAS = (
    ("thing", "thin"), ("ones", "one"), ("erer", "er"), ("oned", "one"), ("The", "the"),
    ("pas", "pa"), ("les", "le"), ("hand", "hand"),
)


@query("clean_html", f"SELECT page_id, {sql_clean('html')} AS cleaned FROM pages")
def clean_html(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", tx.clean_html(F.col("html")).alias("cleaned")
    )


@query("normalize_body", f"SELECT page_id, lower({sql_clean('html')}) AS body FROM pages")
def normalize_body(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", tx.normalize_body(F.col("html")).alias("body")
    )


@query("lower_text", "SELECT doc_id, lower(text) AS lowered FROM documents")
def lower_text(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", tx.lower_text(F.col("text")).alias("lowered")
    )


@query("squeeze_space", f"SELECT doc_id, {sql_squeeze('text')} AS squeezed FROM documents")
def squeeze_space(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", tx.squeeze_space(F.col("text")).alias("squeezed")
    )


@query(
    "drop_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter({sql_words('text')},
          lambda w: w NOT IN {STOP_WORDS!r}), ' ') AS kept FROM documents""",
)
def drop_stopwords(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", tx.drop_stopwords(F.col("text"), STOP_WORDS).alias("kept")
    )


@query(
    "lemmatize",
    f"""WITH lemmas(token, lemma) AS (VALUES {', '.join(map(repr, LEMMAS))}),
    placed AS (
      SELECT doc_id, unnest({sql_words('text')}) AS w,
             generate_subscripts({sql_words('text')}, 1) AS i FROM documents)
    SELECT d.doc_id, coalesce(string_agg(coalesce(lemma, w), ' ' ORDER BY i), '') AS text
    FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id
      LEFT JOIN lemmas ON token = w
    GROUP BY d.doc_id""",
)
def lemmatize_words(spark, sf):
    lemmas = spark.createDataFrame(LEMMAS, "token string, lemma string")
    return lemmatize(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", lemmas)


@query(
    "simple_tokens",
    f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents",
)
def simple_tokens(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.array_join(tx.simple_tokens(F.col("text")), " ").alias("tokens")
    )


@query("normalize_title", f"SELECT doc_id, lower({sql_squeeze('text')}) AS title FROM documents")
def normalize_title(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", tx.normalize_title(F.col("text")).alias("title")
    )


@query(
    "strip_leading_digit",
    """SELECT p_partkey, regexp_replace(p_size || ' ' || p_name, '^[0-9]', '') AS stripped
    FROM part""",
)
def strip_leading_digit(spark, sf):
    text = F.concat_ws(" ", "p_size", "p_name")
    return table(spark, sf, "part").select(
        "p_partkey", tx.strip_leading_digit(text).alias("stripped")
    )


@query(
    "anagram_groups",
    f"""WITH occurrences AS (SELECT unnest({sql_tokens('text')}) AS w FROM documents),
    counted AS (SELECT w, count(*) AS c FROM occurrences GROUP BY w)
    SELECT array_to_string(list_sort(string_split(w, '')), '') AS signature,
           w AS word, c AS n
    FROM counted""",
)
def anagram_groups(spark, sf):
    words = texts(spark, sf, "documents", "text").select(
        F.explode(tx.simple_tokens(F.col("text"))).alias("w")
    )
    return analytics.anagram_groups(words, "w")


@query(
    "quantity_parse",
    """WITH units(unit, factor) AS (VALUES ('стакан', 200.0), ('л', 1000.0), ('мл', 1.0)),
    lines AS (
      SELECT p_partkey, p_size, p_name,
             CASE p_partkey % 4 WHEN 0 THEN 'стакан' WHEN 1 THEN 'л' WHEN 2 THEN 'мл' ELSE 'шт' END
               AS unit
      FROM part)
    SELECT p_partkey, CAST(p_size * coalesce(factor, 1.0) AS DOUBLE) AS quantity,
           CASE WHEN factor IS NULL THEN lines.unit ELSE 'ml' END AS unit, p_name AS ingredient
    FROM lines LEFT JOIN units ON units.unit = lines.unit""",
)
def quantity_parse(spark, sf):
    kind = F.element_at(
        F.array(*map(F.lit, ("стакан", "л", "мл", "шт"))), (F.col("p_partkey") % 4 + 1).cast("int")
    )
    lines = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_size", kind, "p_name").alias("line")
    )
    units = spark.createDataFrame(
        list(analytics.UNIT_MILLILITRES.items()), "unit string, millilitres double"
    )
    return analytics.quantity_parse(lines, "line", units).select(
        "p_partkey", "quantity", "unit", "ingredient"
    )
