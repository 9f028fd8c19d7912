"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askloom.llm import (
    bpe,
    chat,
    decontaminate,
    exact_dedup,
    fill_middle,
    hard_negatives,
    near_dedup,
    ngram_lm,
    pieces,
    quality,
    suffix_dedup,
    token_files,
    window_dedup,
)
from askloom.session import land, scratch_folder, spread

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_read(spark, sf, "documents").select("doc_id", "text"))


def fresh_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    path = scratch_folder(spark, "digest-index")
    name = "digests_" + path.rsplit("-", 1)[1]
    return exact_dedup.DigestIndex(spark, path, name)


def op1_chat_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    # A part's pieces are told apart by their turns.
    return chat.with_mask_text(chat.rotate_perspectives(_read(spark, sf, "conversations"))).drop("piece")


def op2_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf))


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf), fresh_index(spark), batches=2)


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_lm.scores(_documents(spark, sf))


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark, "tokens")
    token_files.write_corpus(_read(spark, sf, "documents"), path)
    return token_files.read_digests(spark, path)


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_documents(spark, sf), _read(spark, sf, "labels"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contained_items(_documents(spark, sf), _read(spark, sf, "benchmark"))


def op8_window_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return window_dedup.repeated_passages(_documents(spark, sf))


def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf), percent=85)


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.repeated_strings(_documents(spark, sf))


def op11_piece_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.mine(_read(spark, sf, "embeddings"), label=hard_negatives.changed_label())


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    stored = land(fill_middle.store(_documents(spark, sf)), "frames")
    return fill_middle.digests(fill_middle.fill_in_middle(stored))


QUERIES: dict[str, Query] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_files": op5_token_files,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontaminate": op7_decontaminate,
    "op8_window_dedup": op8_window_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_piece_round_trip": op11_piece_round_trip,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL: dict[str, str] = {
    "op1_chat_perspectives": chat.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_window_dedup": window_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
