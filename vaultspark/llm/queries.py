"""Queries of the text problems and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import bpe, lookalike, packing, pieces, records, scanned, subjects
from vaultspark.session import table


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "layout_candidates"), table(spark, d, "patch_queue"), table(spark, d, "books")


def _damage(spark: SparkSession, d: str) -> DataFrame:
    return scanned.find_damage(*_pages(spark, d))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(*_pages(spark, d))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return pieces.find_oversized(table(spark, d, "sections"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.all_pieces(table(spark, d, "sections"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return records.copies(table(spark, d, "vault_registry"))


def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    return records.collapsed(table(spark, d, "vault_registry"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_cases(table(spark, d, "vault_registry"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_values(table(spark, d, "vault_registry"), "note_id", ["title", "concept_key"]).withColumnRenamed("id", "note_id")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode_ids(_ids(spark, d)).select("doc_id", "text")


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")))


def _fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_containers(spark, d))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "doc_subjects"), table(spark, d, "subjects")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(*_tables(spark, d))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return subjects.topics(*_tables(spark, d))


def _composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _damage,
    "p1_repaired": _repaired,
    "p2_found": _oversized,
    "p2_pieces": _pieces,
    "p3_found": _copies,
    "p3_records": _collapsed,
    "p5_found": _cases,
    "p5_canonical": _canonical,
    "p7_ids": _ids,
    "p7_decoded": _round_trip,
    "p8_containers": _containers,
    "p8_fill": _fill,
    "p9_found": _subjects,
    "p9_topics": _topics,
    "p9_corpus": _composition,
}

_FORMS = r"""
WITH lines AS (
  SELECT note_id, unnest(string_split(replace(replace(frontmatter, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line
  FROM vault_registry WHERE frontmatter IS NOT NULL),
cut AS (SELECT note_id, split_part(line, ':', 1) AS name, substr(line, length(split_part(line, ':', 1)) + 1) AS val FROM lines),
bare AS (
  SELECT note_id, lower(upper(regexp_replace(name, '[^\p{L}\p{N}]+', '', 'g'))) || ':' || lower(upper(regexp_replace(val, '[^\p{L}\p{N}]+', '', 'g'))) AS field FROM cut),
forms AS (
  SELECT v.note_id, coalesce(string_agg(b.field, chr(10) ORDER BY b.field) FILTER (b.field <> ':'), '') AS form
  FROM vault_registry v LEFT JOIN bare b ON b.note_id = v.note_id WHERE v.frontmatter IS NOT NULL GROUP BY v.note_id),
firsts AS (SELECT form, min(note_id) AS first_id, count(*) AS n_copies FROM forms GROUP BY form)
"""

ORACLE: dict[str, str] = {
    "p2_found": r"""
SELECT section_id, CASE WHEN list_max(list_transform(regexp_extract_all(body, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]+'), lambda x: length(x))) > 4000
       THEN 'forced' ELSE 'natural' END AS boundary FROM sections WHERE length(body) > 4000""",
    "p3_found": _FORMS + "SELECT first_id, note_id AS copy_id FROM forms JOIN firsts USING (form) WHERE note_id <> first_id",
    "p3_records": _FORMS + "SELECT first_id, n_copies FROM firsts",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
