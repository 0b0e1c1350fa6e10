"""Queries that give new contents of pages, and the health report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.functions import sql as S
from vaultspark.operators import notes as N
from vaultspark.operators import render
from vaultspark.session import table


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Sections with links to their neighbours and parents; a page is named by source_file and stem."""
    sections = table(spark, d, "sections").filter("source_file is not null and stem is not null")
    name = lambda c: F.concat("source_file", F.lit("/"), c)
    pages = sections.groupBy(name("stem").alias("stem")).agg(F.min(F.coalesce("body", F.lit(""))).alias("content"))
    near = N.sibling_links(sections)
    stems = sections.select(F.col("source_file").alias("f"), F.col("stem").alias("s")).distinct()
    up = sections.join(stems, (F.col("source_file") == F.col("f")) & (F.col("parent") == F.col("s"))).select(name("stem").alias("src"), name("parent").alias("dst"), F.lit("parent").alias("kind"))
    edges = near.select(name("stem").alias("src"), name("previous").alias("dst"), F.lit("previous").alias("kind")).unionByName(near.select(name("stem").alias("src"), name("following").alias("dst"), F.lit("next").alias("kind"))).unionByName(up)
    return render.with_links(pages, edges)


def _summarised(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "documents").filter("text is not null").select("doc_id", render.with_summary(F.col("text"), md.summary(F.col("text"), 80), mode).alias("content"))

    return run


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", render.with_fields(F.col("text"), [("source_file", F.col("source")), ("path", F.col("path"))]).alias("content"))


def _distilled(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "vault_registry").filter("note_type = 'summary' and title is not null")
    return notes.select("note_id", render.distilled_note(F.col("title"), F.coalesce("source_file", F.lit("")), F.col("path"), F.col("summary"), F.coalesce("headings", F.array().cast("array<string>"))).alias("content"))


def _health(spark: SparkSession, d: str) -> DataFrame:
    notes, raws = table(spark, d, "vault_registry"), table(spark, d, "raw_sources")
    checks = {"missing metadata": N.missing_metadata(notes, F.col("frontmatter")), "orphan notes": N.orphan_notes(notes), "broken links": N.broken_links(notes), "weak notes": N.weak_notes(notes), "duplicate concepts": N.duplicate_concepts(notes), "uncovered sources": N.uncovered_sources(raws, notes), "sources without pages": N.sources_without_pages(raws, notes), "stale indexes": N.stale_indexes(notes)}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n") for name, rows in checks.items()]
    return reduce(DataFrame.unionByName, counts)


def _health_page(spark: SparkSession, d: str) -> DataFrame:
    return render.report(_health(spark, d), "Health")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "link_injection": _linked,
    "summary_injection": _summarised("callout"),
    "summary_field": _summarised("field"),
    "chapter_fields": _fields,
    "distilled_notes": _distilled,
    "health_counts": _health,
    "health_report": _health_page,
}

_FRONT = f"regexp_extract(text, $${S.FRONT}$$, 0)"
_REST = f"substr(text, length({_FRONT}) + 1)"

ORACLE: dict[str, str] = {
    "link_injection": """
WITH s AS (SELECT DISTINCT source_file, stem FROM sections WHERE source_file IS NOT NULL AND stem IS NOT NULL),
p AS (SELECT source_file || '/' || stem AS stem, min(coalesce(body, '')) AS content FROM sections WHERE source_file IS NOT NULL AND stem IS NOT NULL GROUP BY 1),
n AS (SELECT source_file, stem, lag(stem) OVER w AS prev, lead(stem) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY source_file ORDER BY stem)),
e AS (SELECT source_file || '/' || stem AS src, source_file || '/' || prev AS dst, 'previous' AS kind FROM n UNION ALL SELECT source_file || '/' || stem, source_file || '/' || nxt, 'next' FROM n
  UNION ALL SELECT c.source_file || '/' || c.stem, c.source_file || '/' || c.parent, 'parent' FROM sections c JOIN s ON s.source_file = c.source_file AND s.stem = c.parent),
o AS (SELECT src, dst, min(kind) AS kind FROM e WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
l AS (SELECT src, string_agg('- ' || CASE kind WHEN 'previous' THEN 'Previous' WHEN 'next' THEN 'Next' ELSE 'Up' END || ': [[' || dst || ']]', chr(10) ORDER BY CASE kind WHEN 'previous' THEN 'Previous' WHEN 'next' THEN 'Next' ELSE 'Up' END || ': [[' || dst) AS lines, count(*) AS n
  FROM o JOIN p ON p.stem = o.src WHERE NOT contains(content, '[[' || dst || ']]') GROUP BY src)
SELECT p.stem, CASE WHEN n IS NULL THEN content ELSE content || chr(10) || chr(10) || '## Navigation' || chr(10) || chr(10) || lines END AS content, CAST(coalesce(n, 0) AS INTEGER) AS n_added FROM p LEFT JOIN l ON l.src = p.stem""",
    "summary_injection": f"""
WITH s AS (SELECT doc_id, text, {S.summary('text', 80)} AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, s, CASE WHEN s = '' THEN text ELSE regexp_replace(text, '(?i)> \\[!tldr\\][^\\n]*\\n(?:>[^\\n]*\\n)*', '', 'g') END AS text FROM s),
d AS (SELECT *, {_FRONT} AS front, {_REST} AS rest FROM c)
SELECT doc_id, CASE WHEN s = '' THEN text ELSE front || '> [!tldr]' || chr(10) || '> ' || s || chr(10) || chr(10) || rest END AS content FROM d""",
    "summary_field": f"""
WITH d AS (SELECT doc_id, text, {S.summary('text', 80)} AS s, {_FRONT} AS front, {_REST} AS rest, regexp_extract(text, $${S.FRONT}$$, 1) AS inn FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN s = '' OR front = '' THEN text ELSE '---' || chr(10) || regexp_replace(regexp_replace(inn, '(?m)^summary:[^\\r\\n]*(?:\\r?\\n|\\z)', '', 'g'), '\\s+\\z', '') || chr(10) || 'summary: "' || replace(s, '"', '\\"') || '"' || chr(10) || '---' || chr(10) || rest END AS content FROM d""",
    "chapter_fields": f"""
WITH d AS (SELECT doc_id, text, source, path, {_FRONT} AS front, {_REST} AS rest, regexp_extract(text, $${S.FRONT}$$, 1) AS inn FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN front = '' THEN text ELSE array_to_string(['---', inn, 'source_file: "' || coalesce(source, '') || '"', 'path: "' || coalesce(path, '') || '"', '---', rest], chr(10)) END AS content FROM d""",
    "distilled_notes": """
SELECT note_id, array_to_string(['---', 'type: "distilled-note"', 'title: "' || replace(title, '"', '\\"') || '"', 'book_slug: "' || coalesce(source_file, '') || '"', 'source_page: "' || path || '"', '---', '', '# ' || title, '', coalesce(summary, '')], chr(10))
  || CASE WHEN len(headings) > 0 THEN chr(10) || chr(10) || '## Key headings' || chr(10) || chr(10) || '- ' || array_to_string(headings, chr(10) || '- ') ELSE '' END || chr(10) AS content FROM vault_registry WHERE note_type = 'summary' AND title IS NOT NULL""",
}


def _count(name: str, query: str) -> str:
    from vaultspark.plans.vault import ORACLE as VAULT

    return f"SELECT '{name}' AS check_name, (SELECT count(*) FROM ({VAULT[query]})) AS n"


_CHECKS = {"missing metadata": "health_missing_metadata", "orphan notes": "orphan_notes", "broken links": "broken_links", "weak notes": "weak_links", "duplicate concepts": "duplicate_concepts", "uncovered sources": "summary_gaps", "sources without pages": "coverage_gaps", "stale indexes": "stale_indexes"}
ORACLE["health_counts"] = " UNION ALL ".join(_count(n, q) for n, q in _CHECKS.items())
ORACLE["health_report"] = f"SELECT '# Health' || chr(10) || chr(10) || string_agg('- ' || check_name || ': ' || n, chr(10) ORDER BY check_name) || chr(10) AS content FROM ({ORACLE['health_counts']})"
