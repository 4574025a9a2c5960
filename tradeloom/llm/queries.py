"""Queries p8 to p10 over the documents, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import leakage, packing, sentences

#: Tokens of the small containers of p8_tight.
TIGHT = 512


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(read(spark, d, "documents"), "doc_id", "text")


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the share of space used, and how the packing stands to its lower bound and to best fit."""
    return packing.usage(packing.packed(read(spark, d, "documents"), "doc_id", "text"))


def p8_tight(spark: SparkSession, d: str) -> DataFrame:
    """The same in containers and cells so small that best fit leaves containers to win and the search decides."""
    return packing.usage(packing.packed(read(spark, d, "documents"), "doc_id", "text", capacity=TIGHT, cell_tokens=40 * TIGHT), TIGHT)


def _p9(spark: SparkSession, d: str, slots: str) -> DataFrame:
    return leakage.leaked(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text", slots=slots)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of what the template windows and their slots find, the documents that hold the item with its own names and numbers."""
    return _p9(spark, d, "agree").select("doc_id", "item_id")


def p9_reworded(spark: SparkSession, d: str) -> DataFrame:
    """Documents with half of an item, whatever its numbers, names and units as long as they map one to one."""
    return _p9(spark, d, "any").select("doc_id", "item_id", "share")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(read(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_containers, p8_usage, p8_tight, p9_found, p9_reworded, p10_found)}
#: None of these can be said in SQL; they are tested against brute force and held-out accuracy.
SQL: dict[str, str] = {}
