"""Queries over the llm operators (problems 2, 4, 7, 8 and 9) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import leakage, ocr, packing, transcripts, truncation
from strataframe.llm.sql import SQL as statements
from strataframe.sources.tables import spread, table


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(*columns))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.speaker_segments(table(spark, d, "document_items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.turns(p2_segments(spark, d)).select("document_key", "turn_no", "speaker", "start_ms", "n_words")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.page_noise(table(spark, d, "document_items"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr.page_paragraphs(table(spark, d, "document_items"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.token_lengths(_documents(spark, d, "doc_id", "text"), "doc_id", "text"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_documents(spark, d, "doc_id", "text"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("share").alias("most_of_it"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(_documents(spark, d, "doc_id", "source", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("cut_in is not null").select("doc_id").distinct()


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(_cut(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_segments, p4_found, p4_paragraphs, p7_containers, p7_fill, p8_found, p8_items, p9_found, p9_sources)
}

SQL: dict[str, str] = statements
