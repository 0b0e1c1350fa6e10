"""Queries over the states of books and sources, tombstones, indexes, histories and chapter pages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.functions import sql as S
from vaultspark.operators import compile as C
from vaultspark.operators import split, stages
from vaultspark.plans.pages import _BOUNDS, MIN_LINES
from vaultspark.session import table


def _existing(spark: SparkSession, d: str) -> DataFrame:
    """Root notes that exist: those of books that were promoted and aren't tombstoned."""
    return table(spark, d, "books").filter("stages.promoted and not coalesce(tombstoned, false)").select(F.explode("root_notes").alias("path"))


def _tombstones(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "vault_registry").filter("removed_at is null and note_type = 'index'").select("source_file")
    return stages.tombstones(table(spark, d, "books"), live)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "vault_registry").filter("question is not null")
    sources = F.coalesce("page_sources", F.array().cast("array<string>"))
    return stages.query_versions(notes.select(md.query_slug(F.col("question")).alias("slug"), "mtime", "note_id", md.content_hash(F.col("question"), sources, F.coalesce("summary", F.lit(""))).alias("content_hash")))


def _concepts_index(spark: SparkSession, d: str) -> DataFrame:
    rows = C.concepts(table(spark, d, "vault_registry")).withColumn("letter", F.upper(F.left("key", F.lit(1))))
    return stages.paged(rows, "letter", ["key"], F.concat(F.lit("- [[concept/"), "key", F.lit("|"), "title", F.lit("]]")))


def _sources_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_sources").filter("removed_at is null and path is not null").select("path").distinct()
    return stages.paged(rows.withColumn("folder", F.split_part("path", F.lit("/"), F.lit(3))), "folder", ["path"], F.concat(F.lit("- "), "path"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", md.summary_candidate(F.col("text"), 400).alias("candidate"), F.contains(F.lower("text"), F.lit("> [!tldr]")).alias("has_summary"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    kinds = [F.struct(F.lit(k).alias("quotes"), md.front_matter(F.col("text"), k).alias("fields")) for k in ("outer", "either", "double")]
    each = _texts(spark, d).filter("startswith(text, '---')").select("doc_id", F.explode(F.array(*kinds)).alias("v"))
    return each.select("doc_id", "v.quotes", F.explode("v.fields").alias("field", "value"))


def _registry_fields(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("---\n"), "frontmatter", F.lit("\n---\n"))
    fields = F.map_filter(md.front_matter(text), lambda k, v: k.isin(md.REGISTRY_FIELDS))
    return table(spark, d, "vault_registry").filter("frontmatter is not null").select("note_id", F.explode(fields).alias("field", "value"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "vault_registry").filter("title is not null")
    return notes.select("note_id", md.display_name(F.col("title")).alias("display_name"), md.section_name(F.col("title")).alias("section_name"), md.file_name(F.col("title")).alias("file_name"))


def _chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return split.chapter_pages(split.chapters(docs, "doc_id", "text", MIN_LINES), "doc_id")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Sections as pages; what is longer than a tenth of a page counts as its first word, so that some books are pictures."""
    pages = table(spark, d, "sections").select("source_file", "section_id", F.when(F.col("section_id") % 2 == 0, F.substring_index("body", " ", 1)).otherwise(F.left("body", F.lit(60))).alias("body"))
    return stages.scanned_books(pages, "source_file", ["section_id"], "body")


def _conversions(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("content").isNull(), "error").when(F.col("content") == "", "empty").otherwise("converted")
    return stages.conversion_tallies(table(spark, d, "raw_sources").select("path", status.alias("status")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "book_status": lambda spark, d: stages.book_status(table(spark, d, "books")),
    "base_status": lambda spark, d: stages.base_status(table(spark, d, "raw_sources"), table(spark, d, "vault_registry")),
    "split_tallies": lambda spark, d: stages.split_tallies(table(spark, d, "books"), table(spark, d, "sections")),
    "conversion_tallies": _conversions,
    "tombstones": _tombstones,
    "section_index": lambda spark, d: stages.section_index(table(spark, d, "books"), _existing(spark, d)),
    "root_index": lambda spark, d: stages.root_index(table(spark, d, "books"), _existing(spark, d)),
    "query_version_list": _versions,
    "query_history": lambda spark, d: stages.query_history(_versions(spark, d)),
    "concepts_index": _concepts_index,
    "sources_index": _sources_index,
    "summary_candidates": _candidates,
    "frontmatter_variants": _variants,
    "registry_fields": _registry_fields,
    "safe_names": _names,
    "chapter_pages": _chapter_pages,
    "scanned_books": _scanned,
}


def _paged(rows: str, group: str, order: str, item: str) -> str:
    return f"SELECT {group}, CAST(ceil(position / 500) AS INTEGER) AS page, count(*) AS n, string_agg({item}, chr(10) ORDER BY position) AS body FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS position FROM ({rows})) GROUP BY 1, 2"


_LIVE = "SELECT DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'uncategorized' END AS section, path FROM (SELECT unnest(root_notes) AS path FROM books) WHERE path IN (SELECT unnest(root_notes) FROM books WHERE stages.promoted AND NOT coalesce(tombstoned, false))"
_VERSIONED = f"SELECT {S.query_slug('question')} AS slug, row_number() OVER (PARTITION BY {S.query_slug('question')} ORDER BY mtime, note_id) AS version, note_id, left(sha1(concat(question, chr(10), array_to_string(coalesce(page_sources, []), chr(10)), chr(10), {S.body("coalesce(summary, '')")})), 12) AS content_hash FROM vault_registry WHERE question IS NOT NULL"
_FIELD = S.strip("split_part(line, ':', 1)")
_BARE = S.strip("substr(line, instr(line, ':') + 1)")
_FRONTS = f"SELECT doc_id, unnest({S.front_lines('text')}) AS line FROM documents WHERE text IS NOT NULL"
_SEPARATED = r'[\\/:*?"<>|]+'

ORACLE: dict[str, str] = {
    "book_status": "SELECT CASE WHEN coalesce(tombstoned, false) THEN 'tombstoned' WHEN coalesce(review_needed, false) THEN 'review' WHEN coalesce(promotion_blocked, false) THEN 'blocked' ELSE 'ready' END AS state, count(*) AS n_books, CAST(coalesce(sum(qa_candidate_count), 0) AS BIGINT) AS n_candidates FROM books GROUP BY 1",
    "base_status": """
SELECT count(*) AS n_sources, count(source_hash) AS n_tracked, count(*) FILTER (source_hash <> raw_hash) AS n_dirty, (SELECT count(*) FROM vault_registry WHERE removed_at IS NULL) AS n_notes,
       (SELECT count(*) FROM vault_registry WHERE removed_at IS NULL AND note_type = 'query-note') AS n_query_notes, (SELECT count(*) FROM vault_registry WHERE removed_at IS NULL AND note_type = 'index') AS n_indexes FROM raw_sources WHERE removed_at IS NULL""",
    "split_tallies": """
WITH n AS (SELECT source_file, count(*) AS n FROM sections GROUP BY 1)
SELECT count(*) AS n_books, count(*) FILTER (coalesce(stages.split, false) AND coalesce(n, 0) > 0) AS n_ok, count(*) FILTER (NOT (coalesce(stages.split, false) AND coalesce(n, 0) > 0)) AS n_failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_sections FROM books b LEFT JOIN n ON n.source_file = b.source_file""",
    "conversion_tallies": "SELECT CASE WHEN content IS NULL THEN 'error' WHEN content = '' THEN 'empty' ELSE 'converted' END AS status, count(*) AS n, (SELECT coalesce(bool_or(content <> ''), false) OR count(*) = 0 FROM raw_sources) AS batch_ok FROM raw_sources GROUP BY 1",
    "tombstones": """
SELECT book_slug, coalesce(book_title, book_slug) AS book_title, coalesce(len(root_notes), 0) AS n_root_notes FROM books WHERE coalesce(source_file, '') <> '' AND NOT coalesce(tombstoned, false)
  AND source_file NOT IN (SELECT source_file FROM vault_registry WHERE removed_at IS NULL AND note_type = 'index' AND source_file IS NOT NULL)""",
    "section_index": _paged(_LIVE, "section", "path", "'- [[' || regexp_replace(path, '\\.md$', '') || ']]'"),
    "root_index": f"SELECT section, count(*) AS n_notes FROM ({_LIVE}) GROUP BY section",
    "query_version_list": _VERSIONED,
    "query_history": _paged(_VERSIONED, "slug", "version DESC", "'- [[' || slug || '--v' || version || '|Version ' || version || ']]'"),
    "concepts_index": _paged(
        f"SELECT upper(left(key, 1)) AS letter, key, arg_min(candidate, note_id * 100 + place) AS title FROM (SELECT *, {S.slug('candidate')} AS key FROM (SELECT note_id, generate_subscripts(c, 1) AS place, unnest(c) AS candidate FROM (SELECT note_id, {S.concept_candidates('title', 'coalesce(headings, [])')} AS c FROM vault_registry WHERE title IS NOT NULL))) GROUP BY key",
        "letter", "key", "'- [[concept/' || key || '|' || title || ']]'",
    ),
    "sources_index": _paged("SELECT DISTINCT split_part(path, '/', 3) AS folder, path FROM raw_sources WHERE removed_at IS NULL AND path IS NOT NULL", "folder", "path", "'- ' || path"),
    "summary_candidates": f"""
WITH b AS (SELECT doc_id, contains(lower(text), '> [!tldr]') AS has_summary, regexp_replace({S.body('text')}, '^(?:\\s*> \\[![^\\n]*(?:\\n>[^\\n]*)*)+', '') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, has_summary, {S.prose('t', '#|' + chr(92) + '|')} AS l FROM b)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR list_sum(list_transform(list_slice(l, 1, i - 1), lambda y: length(y))) < 400), chr(10)) AS candidate, has_summary FROM l""",
    "frontmatter_variants": f"""
WITH f AS (SELECT doc_id, line, {_FIELD} AS field, {_BARE} AS bare FROM ({_FRONTS} AND starts_with(text, '---')))
SELECT doc_id, 'outer' AS quotes, field, {S.strip(S.strip('bare', '"'), "'")} AS value FROM f UNION ALL SELECT doc_id, 'either', field, {S.strip('bare', chr(34) + "'")} FROM f UNION ALL SELECT doc_id, 'double', field, {S.strip('bare', '"')} FROM f""",
    "registry_fields": f"SELECT note_id, {_FIELD} AS field, {S.strip(S.strip(_BARE, '"'), "'")} AS value FROM (SELECT note_id, unnest({S.front_lines("('---' || chr(10) || frontmatter || chr(10) || '---' || chr(10))")}) AS line FROM vault_registry WHERE frontmatter IS NOT NULL) WHERE field IN ({', '.join(repr(f) for f in md.REGISTRY_FIELDS)})",
    "safe_names": f"""
WITH n AS (SELECT note_id, title, {S.strip(f"regexp_replace(regexp_replace({S.strip('title')}, '{_SEPARATED}', '-', 'g'), '[{S.SPACE}]+', ' ', 'g')")} AS d,
  {S.strip(f"regexp_replace(regexp_replace(regexp_replace({S.strip(f"regexp_replace({S.strip('title')}, '{_SEPARATED}', ' ', 'g')")}, '^[0-9]+[{S.SPACE}]*', ''), '^[^\\p{{L}}\\p{{N}}]+', ''), '[{S.SPACE}]+', ' ', 'g')")} AS s FROM vault_registry WHERE title IS NOT NULL)
SELECT note_id, coalesce(nullif(d, ''), 'untitled') AS display_name, coalesce(nullif(s, ''), 'Notes') AS section_name, {S.file_name('title')} AS file_name FROM n""",
    "chapter_pages": f"""
WITH RECURSIVE {_BOUNDS} SELECT doc_id, seq || '-' || {S.file_name('title')} || '.md' AS path, array_to_string(['---', 'title: "' || replace(title, '"', '\\"') || '"', 'type: "' || type || '"', 'seq: "' || seq || '"', 'first_line: "' || first_line || '"', '---', '', array_to_string(list_slice(l, first_line + 1, end_line), chr(10)), ''], chr(10)) AS content FROM secs""",
    "scanned_books": f"""
WITH p AS (SELECT source_file, CASE WHEN section_id % 2 = 0 THEN split_part(body, ' ', 1) ELSE left(body, 60) END AS body, row_number() OVER (PARTITION BY source_file ORDER BY section_id) AS k FROM sections WHERE source_file IS NOT NULL)
SELECT source_file, round(avg(length({S.strip("coalesce(body, '')")})), 3) AS mean_chars FROM p WHERE k <= 3 GROUP BY source_file HAVING mean_chars < 30""",
}
