"""Queries over stored memories: copies, near copies, neighbours, the best per namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import full_key, load
from .format_dup import copy_counts, format_copies
from .near_dup import classes_with_links, expand_pairs, near_duplicates
from .neighbours import nearest_neighbours
from .topn import top_n_per_group

#: Letters and digits in lower case, and whether a value is a list of fields.
_SQL_FIELDS = """
parts AS (SELECT namespace || ':' || key AS id, value, memory_type,
  json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT' AS is_json,
  contains(value, '=') AND len(list_filter(string_split(value, ';'), lambda p: trim(p, E' \\t\\n\\r') <> '' AND NOT contains(p, '='))) = 0 AS is_list
  FROM entries WHERE value IS NOT NULL AND namespace || ':' || key IS NOT NULL)
"""
_SQL_CLASSES = (
    "WITH "
    + _SQL_FIELDS
    + """, listed AS (
  SELECT id, 't' || regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', '', 'g') AS form FROM parts WHERE NOT coalesce(is_json, false) AND NOT is_list
  UNION ALL
  SELECT id, 'f' || coalesce(string_agg(DISTINCT pair, '|' ORDER BY pair), '') AS form FROM (
    SELECT parts.id, regexp_replace(lower(e.key), '[^\\p{L}\\p{N}]+', '', 'g') || '=' || regexp_replace(lower(coalesce(e.value ->> '$', 'null')), '[^\\p{L}\\p{N}]+', '', 'g') AS pair
    FROM parts, json_each(CASE WHEN is_json THEN parts.value ELSE '{}' END) e WHERE is_json
    UNION ALL
    SELECT id, regexp_replace(lower(split_part(p, '=', 1)), '[^\\p{L}\\p{N}]+', '', 'g') || '=' || regexp_replace(lower(substr(p, instr(p, '=') + 1)), '[^\\p{L}\\p{N}]+', '', 'g') AS pair
    FROM (SELECT id, unnest(string_split(value, ';')) AS p FROM parts WHERE is_list AND NOT coalesce(is_json, false)) WHERE trim(p, E' \\t\\n\\r') <> ''
  ) WHERE pair <> '=' GROUP BY id),
classes AS (SELECT form, min(id) AS rep, count(*) AS copies FROM listed WHERE length(form) > 1 GROUP BY form HAVING count(*) > 1)
"""
)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "entries").withColumn("id", full_key())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies(_entries(spark, folder), "id", "value").select(F.col("rep").alias("key_a"), F.col("id").alias("key_b"))


P2_FOUND = _SQL_CLASSES + "SELECT rep AS key_a, id AS key_b FROM listed JOIN classes USING (form) WHERE id <> rep"


def p2_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copy_counts(_entries(spark, folder), "id", "value")


P2_COPY_COUNTS = _SQL_CLASSES + "SELECT rep, copies FROM classes"

def p7_top_five(spark: SparkSession, folder: str) -> DataFrame:
    return top_n_per_group(load(spark, folder, "trigger_entries"), "namespace", "relevance", "key", "fire_id", 5)


P7_TOP_FIVE = """
SELECT namespace, relevance, key, fire_id, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY relevance DESC, key, fire_id) AS place
  FROM (SELECT DISTINCT namespace, relevance, key, fire_id FROM trigger_entries
    WHERE namespace IS NOT NULL AND relevance IS NOT NULL AND CAST(relevance AS VARCHAR) <> 'nan'))
WHERE place <= 5
"""


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_top_five(spark, folder).select("namespace", "key", "fire_id").distinct()


P7_FOUND = f"SELECT DISTINCT namespace, key, fire_id FROM ({P7_TOP_FIVE})"

def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(_entries(spark, folder), "id", "embedding", k=5, least=0.8, dims=64)


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder).select("id", "neighbour")


_SQL_NEAR = """
WITH v AS (SELECT namespace || ':' || key AS id, CAST(embedding AS DOUBLE[]) AS e FROM entries WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR CAST(x AS VARCHAR) IN ('nan', 'inf', '-inf'))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.id <> b.id),
nearest AS (SELECT * FROM scored WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) <= 5)
"""
P3_FOUND = _SQL_NEAR + "SELECT DISTINCT least(id, neighbour) AS key_a, greatest(id, neighbour) AS key_b FROM nearest"


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _neighbours(spark, folder)
    return pairs.select(F.least("id", "neighbour").alias("key_a"), F.greatest("id", "neighbour").alias("key_b")).distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return expand_pairs(*near_duplicates(_entries(spark, folder), "id", "value", "memory_type", words_per_shingle=3, similarity=0.5))


P1_FOUND = (
    "WITH "
    + _SQL_FIELDS
    + """, worded AS (SELECT id, memory_type, string_split(trim(regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w
  FROM parts WHERE NOT coalesce(is_json, false) AND NOT is_list),
grams AS (SELECT DISTINCT id, memory_type, gram FROM (SELECT id, memory_type, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT id, memory_type, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 12))),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (SELECT a.id AS key_a, b.id AS key_b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.memory_type IS NOT DISTINCT FROM b.memory_type AND a.id < b.id GROUP BY a.id, b.id)
SELECT key_a, key_b FROM shared s JOIN sizes x ON x.id = key_a JOIN sizes y ON y.id = key_b WHERE 2 * s.n >= x.n + y.n - s.n
"""
)


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The usual form: five words, similarity 0.8, one row per record with its class and links."""
    return classes_with_links(*near_duplicates(_entries(spark, folder), "id", "value", "memory_type"))


P1_CLASSES = (
    "WITH "
    + _SQL_FIELDS
    + """, worded AS (SELECT id, memory_type, string_split(trim(regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w
  FROM parts WHERE NOT coalesce(is_json, false) AND NOT is_list),
grams AS (SELECT DISTINCT id, memory_type, gram FROM (SELECT id, memory_type, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT id, memory_type, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 12))),
sets AS (SELECT id, memory_type, string_agg(gram, '|' ORDER BY gram) AS form, count(*) AS n FROM grams GROUP BY id, memory_type),
classed AS (SELECT id, memory_type, n, min(id) OVER same AS rep, count(*) OVER same AS copies FROM sets WINDOW same AS (PARTITION BY memory_type, form)),
firsts AS (SELECT g.* FROM grams g JOIN classed c ON c.id = g.id AND c.id = c.rep),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM firsts a JOIN firsts b ON a.gram = b.gram AND a.memory_type IS NOT DISTINCT FROM b.memory_type AND a.id <> b.id GROUP BY a.id, b.id),
linked AS (SELECT s.a AS rep, count(*) AS links FROM shared s JOIN classed x ON x.id = s.a JOIN classed y ON y.id = s.b WHERE s.n >= 0.8 * (x.n + y.n - s.n) GROUP BY s.a)
SELECT id, classed.rep, copies, coalesce(links, 0) AS links FROM classed LEFT JOIN linked ON linked.rep = classed.rep
"""
)
P3_NEIGHBOURS = _SQL_NEAR + "SELECT id, neighbour FROM nearest"
QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_copy_counts, p3_found, p3_neighbours, p7_found, p7_top_five)}
ORACLE = {"p1_found": P1_FOUND, "p1_classes": P1_CLASSES, "p2_found": P2_FOUND, "p2_copy_counts": P2_COPY_COUNTS, "p3_found": P3_FOUND, "p3_neighbours": P3_NEIGHBOURS, "p7_found": P7_FOUND, "p7_top_five": P7_TOP_FIVE}
