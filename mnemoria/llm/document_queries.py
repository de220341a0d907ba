"""Queries over documents: packing, leaked test items, spam pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load
from .leak import WINDOW_WORDS, find_leaks
from .packing import container_fill, pack
from .spam import score_pages, spam_pages


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(load(spark, folder, "documents"), "doc_id", "text", 2048)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return container_fill(p8_pack(spark, folder), 2048)


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).where(F.col("longest_run") >= WINDOW_WORDS).select("doc_id", "item_id").distinct()


P9_FOUND = """
WITH doc_words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, string_split(trim(regexp_replace(lower(passage), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items WHERE passage IS NOT NULL),
doc_grams AS (SELECT doc_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM doc_words)),
item_grams AS (SELECT item_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item_words))
SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (gram)
"""

def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(load(spark, folder, "documents"), "doc_id", "text")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_pages(load(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p8_pack, p8_fill, p9_found, p9_leaks, p10_found, p10_scores)}
ORACLE: dict[str, str] = {"p9_found": P9_FOUND}
