"""Dictionary-driven text operators on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import words
from askloom.session import fits_broadcast


def lemmatize(df: DataFrame, key: str, text: str, lemmas: DataFrame) -> DataFrame:
    """Replace every word found in ``lemmas(token, lemma)``; others stay. Words are
    split on white space and rejoined with one blank. Of several lemmas of a token
    the first in order counts. ``key`` may be null or repeat: rows that share one look
    their words up together.

    A dictionary measured to be small is one map that is applied in the row, without
    a shuffle. A larger one is joined to the distinct words of each text, and what
    was found is applied in the row.
    """
    known = (
        lemmas.where(F.col("token") != F.col("lemma"))
        .groupBy("token")
        .agg(F.min("lemma").alias("lemma"))
    )
    changes = F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_changes")
    if fits_broadcast(known):
        found = df.withColumn("_changes", known.agg(changes).scalar())
    else:
        words_of = df.select(
            F.col(key).alias("_key"), F.explode(F.array_distinct(words(F.col(text)))).alias("token")
        )
        per_key = words_of.join(known, "token").groupBy("_key").agg(changes)
        found = df.join(per_key, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    replaced = F.transform(
        words(F.col(text)),
        lambda word: F.coalesce(F.try_element_at(F.col("_changes"), word), word),
    )
    return found.withColumn(text, F.array_join(replaced, " ")).drop("_changes")
