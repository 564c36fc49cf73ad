"""The registered queries of this package, over whole tables with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from harborline.llm import archives, chat, collocations, html_text, mixing, near_dups, orc_ids, packing, repetition, sentence_pieces, toxicity, vantage, winnowing
from harborline.llm.common import read_table
from harborline.llm.sql import SQL
from harborline.session import fresh_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(read_table(spark, sf_dir, "embeddings"))


def op6_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.through_archives(read_table(spark, sf_dir, "pages"))


def op7_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(read_table(spark, sf_dir, "documents"))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_ids.through_files(read_table(spark, sf_dir, "documents"), fresh_path(spark, "token-ids"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.digests(read_table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(read_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_best_fit_packing, op3_chat_rotation, op4_source_mixing, op5_vantage_point_search, op6_warc_conversion,
        op7_probminhash_dedup, op8_page_differencing, op9_winnowing, op10_orc_token_ids, op11_word_runs, op12_sentence_pieces,
        op13_phrase_collocations,
    )
} | {"pipeline": corpus_pipeline.run}

__all__ = ["QUERIES", "SQL"]
