"""Queries over the vault's notes, sections and raw sources: scans, links, registry, checks, compile, promotion, views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.functions import sql as S
from vaultspark.operators import compile as C
from vaultspark.operators import hierarchy as H
from vaultspark.operators import notes as N
from vaultspark.operators import scan, views
from vaultspark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _notes(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "vault_registry"))


def _both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "raw_sources"), table(spark, d, "vault_registry"))


def _files(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(scan.files(table(spark, d, "raw_sources").select("path", F.col("byte_size").alias("size"))))


def _deliveries(f: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = F.concat(F.regexp_replace("path", r"\.md$", "."), F.coalesce("file_format", F.lit("md")))
        return f(scan.files(table(spark, d, "vault_registry").select(path.alias("path"), F.col("line_count").cast("bigint").alias("size"))))

    return run


def _section_names(spark: SparkSession, d: str) -> DataFrame:
    coded = F.when(F.pmod(F.col("section_id"), F.lit(3)) == 0, F.concat(F.element_at(F.split("stem", "-"), -1), F.lit("-"), F.col("seq"))).otherwise(F.substring_index("path", "/", -1))
    return scan.name_groups(table(spark, d, "sections").select(coded.alias("name")))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("stem", md.stem(F.col("path")))
    return N.title_mentions(docs, "doc_id", "text", docs.select(F.col("stem").alias("title")), "stem")


def _xref(spark: SparkSession, d: str) -> DataFrame:
    """The sections' bodies name no other page, so each has a line added that names its own chapter in two ways."""
    sections = table(spark, d, "sections")
    referring = sections.select("section_id", "stem", F.concat_ws("\n", "body", F.concat(F.lit("For this see "), F.col("chapter")), F.concat(F.lit("見"), F.col("chapter"))).alias("text"))
    return N.reference_links(referring, "section_id", "text", "stem", sections.select(F.col("stem").alias("title")))


def _contract(spark: SparkSession, d: str) -> DataFrame:
    """The documents' texts keep the contract, so every fifth has an open link and every seventh a link in Markdown added."""
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, "\n[[open]").otherwise(""), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\n[x]("), "path", F.lit(")"))).otherwise(""))
    return N.contract_violations(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


def _query_contract(spark: SparkSession, d: str) -> DataFrame:
    """Pages of answers; every third is taken as a version, every other one of those with the fields of one, every fifth page as an index."""
    notes = table(spark, d, "vault_registry").filter("startswith(path, 'queries/')")
    k = F.col("note_id")
    path = F.when(k % 3 == 0, F.regexp_replace("path", r"\.md$", "--v1.md")).otherwise(F.col("path"))
    more = F.when(k % 6 == 0, "\nsources: []\nderived_from_query_output: \"x\"\nversion: 1\nversion_group: \"g\"").when(k % 5 == 0, "\ntype: index\nindex_kind: \"query-history\"").otherwise("")
    return N.query_page_violations(notes.select("note_id", path.alias("path"), F.concat("frontmatter", more).alias("frontmatter")))


def _stale(spark: SparkSession, d: str) -> DataFrame:
    """Summary notes hold the hash that their source had when they were written; it is compared with the raw hash there now."""
    raws, notes = table(spark, d, "raw_sources"), table(spark, d, "vault_registry").filter("note_type = 'summary' and source_path is not null")
    then = raws.select(F.col("path").alias("r_path"), "source_hash", "ingested_at")
    pages = notes.join(then, (F.col("source_path") == F.col("r_path")) & (F.col("ingested_at") <= F.col("mtime")), "left").groupBy(F.col("note_id").alias("page_id"), "path", "source_path").agg(F.max("source_hash").alias("source_hash"))
    return N.stale_summaries(pages, raws.filter("removed_at is null").select(F.col("path").alias("source_path"), F.col("raw_hash").alias("hash")))


def _delta(spark: SparkSession, d: str) -> DataFrame:
    raws = table(spark, d, "raw_sources")
    before = raws.filter("ingested_at < timestamp_ntz'2024-07-01 00:00:00'").select("path", F.col("raw_hash").alias("hash"))
    after = raws.filter("removed_at is null").select("path", F.col("source_hash").alias("hash"))
    return C.ingest_delta(before, after)


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    raws, notes = table(spark, d, "raw_sources"), table(spark, d, "vault_registry")
    named = notes.filter("note_type = 'summary'").select(F.col("source_path").alias("path")).distinct().withColumn("has_summary", F.lit(True))
    tracked = raws.select("path", F.col("source_hash").alias("hash")).join(named, "path", "left").select("path", "hash", F.coalesce("has_summary", F.lit(False)).alias("has_summary"))
    return C.dirty(raws.filter("removed_at is null").groupBy("path").agg(F.max("raw_hash").alias("hash")), tracked)


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return C.summary_pages(docs.select("path", "text", F.sha2("text", 256).alias("hash")))


def _books(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "books"))


def _stale_targets(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "vault_registry").select(F.concat("path").alias("target")).distinct()
    old = table(spark, d, "books").select("book_slug", F.explode("root_notes").alias("target"))
    return C.stale_targets(old, old.join(notes, "target", "left_semi").select("book_slug", "target"))


def _promotion(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "vault_registry")
    proposals = notes.filter("note_type = 'summary'").select(md.slug(F.col("title")).alias("target"), F.col("source_file").alias("owner"), F.col("summary").alias("content"), "note_id")
    existing = notes.filter("note_type = 'distilled-note'").select(md.slug(F.col("title")).alias("target"), F.col("source_file").alias("owner"), F.col("summary").alias("content"))
    return C.promotion_plan(proposals, existing).groupBy("action").agg(F.count("*").alias("n"))


def _guard(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "vault_registry").select("note_id", F.explode("outbound_links").alias("link")).filter("link is not null")
    return links.select("note_id", "link", C.inside_root(F.col("link")).alias("inside")).distinct()


def _log(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    kind = F.pmod(F.col("event_id"), F.lit(3))
    text = F.when(kind == 0, F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("event_type"), F.lit(" | user "), F.col("user_id").cast("string"))).when(F.pmod(F.col("event_id"), F.lit(7)) == 1, "## [broken").otherwise(F.concat(F.lit("- value of "), F.col("event_type")))
    lines = events.select(F.pmod(F.col("user_id"), F.lit(50)).cast("string").alias("log"), F.col("event_id").alias("line_no"), text.alias("text"))
    return C.log_entries(lines)


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """Questions, titles and categories of all notes, with the words of the subjects' descriptions as aliases of their codes."""
    notes = table(spark, d, "vault_registry").select(F.col("note_id").alias("question_id"), F.concat_ws(" ", "question", "title", "category").alias("question"))
    aliases = table(spark, d, "subjects").select(F.col("subject_code").alias("topic"), F.explode(F.concat(F.array("subject_code"), md.tokens(F.col("description")))).alias("alias"))
    return N.expanded_aliases(notes, aliases)


def _file_progress(spark: SparkSession, d: str) -> DataFrame:
    raws = table(spark, d, "raw_sources")
    status = F.when(F.col("content").isNull(), "error").when(F.col("removed_at").isNotNull(), "removed").when(F.col("source_hash").isNull(), "pending").otherwise("converted")
    return raws.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return H.parent_pairs(table(spark, d, "sections")).filter("parent_id is not null").select("section_id", "parent_id")


_VIEW = {
    "filter": {"and": [{"field": "note_type", "operator": "in", "value": ["summary", "concept"]}, {"or": [{"field": "title", "operator": "contains", "value": "Ledger"}, {"field": "status", "operator": "is", "value": "draft"}]}, {"field": "category", "operator": "is-not-empty"}, {"field": "line_count", "operator": "is-greater-than", "value": 100}, {"field": "path", "operator": "does-not-contain", "value": "quarry"}]},
    "formulas": {"n_links": "size(outbound_links)", "age": "if(status = 'draft', 'open', 'done')"},
    "columns": ["note_id", "title", "n_links", "age"],
}

QUERIES: dict[str, Query] = {
    "scan_format_stats": _files(scan.format_stats),
    "scan_skipped": _deliveries(scan.skipped),
    "scan_directory_groups": _files(scan.directory_groups),
    "scan_filename_groups": _section_names,
    "scan_language_bias": _files(scan.language_bias),
    "large_files": _files(scan.large_files),
    "inbound_links": _notes(N.inbound),
    "broken_links": _notes(N.broken_links),
    "orphan_notes": _notes(N.orphan_notes),
    "weak_links": _notes(N.weak_notes),
    "stem_index": _notes(N.one_per_stem),
    "sibling_links": lambda spark, d: N.sibling_links(table(spark, d, "sections")),
    "category_index": _notes(N.category_index),
    "semantic_links": _mentions,
    "xref_links": _xref,
    "homepage": _notes(N.homepage),
    "parent_links": _parents,
    "registry_children": _notes(N.children),
    "alias_expand": _aliases,
    "file_progress": _file_progress,
    "registry_notes": _notes(N.registry_notes),
    "registry_sources": _notes(N.page_sources),
    "registry_stats": _notes(N.registry_stats),
    "health_missing_metadata": _notes(lambda notes: N.missing_metadata(notes, F.col("frontmatter"))),
    "duplicate_concepts": _notes(N.duplicate_concepts),
    "summary_gaps": _both(N.uncovered_sources),
    "coverage_gaps": _both(N.sources_without_pages),
    "stale_summaries": _stale,
    "stale_indexes": _notes(N.stale_indexes),
    "lint_missing_concepts": _notes(N.missing_concepts),
    "lint_conflicts": _notes(lambda notes: N.concept_conflicts(C.concepts(notes))),
    "lint_source_hashes": _both(lambda raws, notes: N.conflicting_sources(raws)),
    "lint_cold": _notes(lambda notes: N.cold_notes(notes, "2024-01-01 00:00:00")),
    "lint_contract": _contract,
    "lint_query_pages": _query_contract,
    "ingest_delta": _delta,
    "compile_dirty": _dirty,
    "concept_pages": _notes(C.concepts),
    "concept_sources": _notes(C.concept_sources),
    "summary_pages": _summaries,
    "book_progress": _books(C.book_progress),
    "promotion_targets": _notes(C.promotion_targets),
    "promotion_plan": _promotion,
    "promotion_stale": _stale_targets,
    "path_escape_guard": _guard,
    "log_entries": _log,
    "base_view": _notes(lambda notes: views.view(notes, _VIEW)),
    "base_view_groups": _notes(lambda notes: views.groups(notes, "status", ["draft", "active"])),
    "progress_matrix": _notes(lambda notes: views.progress(notes.withColumn("category", F.lower("category")), "category", "status", ["draft", "active", "reviewed"])),
}

_FILES = r"""
WITH files AS (
  SELECT path, byte_size AS size, regexp_replace(path, '^.*/', '') AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory,
         lower(regexp_extract(regexp_replace(path, '^.*/', ''), '(\.[^.]+)$', 1)) AS extension FROM raw_sources
  WHERE len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda p: starts_with(p, '.') AND p NOT IN ('.', '..') OR p IN (IGNORED))) = 0)
""".replace("IGNORED", ", ".join(f"'{name}'" for name in scan.IGNORED))
_FORMATS = ", ".join(f"'{f}'" for f in scan.FORMATS)
_LINKS = f"""
WITH occ AS (
  SELECT note_id, {S.strip("regexp_replace(" + S.strip("split_part(split_part(link, '|', 1), '#', 1)") + ", '^.*/', '')")} AS target
  FROM (SELECT note_id, unnest(outbound_links) AS link FROM vault_registry) WHERE link IS NOT NULL),
stems AS (SELECT *, {S.stem('path')} AS stem FROM vault_registry),
inb AS (SELECT s.stem, count(o.target) AS n_links, count(DISTINCT o.note_id) AS n_sources FROM (SELECT DISTINCT stem FROM stems) s LEFT JOIN occ o ON o.target = s.stem GROUP BY s.stem)
"""
_SOURCES = "pages AS (SELECT DISTINCT source, path FROM (SELECT unnest(list_concat(coalesce(page_sources, []), [source_path])) AS source, path FROM vault_registry) WHERE source IS NOT NULL AND source <> '')"
_CONCEPTS = f"""
WITH each AS (SELECT note_id, generate_subscripts(c, 1) AS place, unnest(c) AS candidate FROM (SELECT note_id, {S.concept_candidates('title', 'coalesce(headings, [])')} AS c FROM vault_registry WHERE title IS NOT NULL)),
keyed AS (SELECT *, {S.slug('candidate')} AS key FROM each)
"""

ORACLE: dict[str, str] = {
    "scan_format_stats": _FILES + f"SELECT extension, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM files WHERE extension IN ({_FORMATS}) GROUP BY ROLLUP (extension)",
    "scan_skipped": f"WITH files AS (SELECT lower('.' || coalesce(file_format, 'md')) AS extension FROM vault_registry) SELECT extension, count(*) AS n_files FROM files WHERE extension NOT IN ({_FORMATS}) GROUP BY extension",
    "scan_directory_groups": _FILES + "SELECT directory, count(*) AS n_files FROM files GROUP BY directory HAVING count(*) >= 2 AND directory <> '.'",
    "scan_filename_groups": rf"""
WITH files AS (SELECT CASE WHEN section_id % 3 = 0 THEN list_extract(string_split(stem, '-'), -1) || '-' || seq ELSE regexp_replace(path, '^.*/', '') END AS name FROM sections),
numbered AS (SELECT upper(regexp_extract(name, '^([A-Za-z]+)[_\-](\d+)', 1)) AS label, count(*) AS n FROM files GROUP BY 1 HAVING label <> '' AND n >= 2),
words AS (SELECT regexp_extract({S.stem('name')}, '^([^\s_\-.]{{2,}})', 1) AS label, count(*) AS n FROM files GROUP BY 1 HAVING label <> '' AND n >= 3)
SELECT 'numbered_pattern' AS kind, label || '-NNN' AS label, n FROM numbered UNION ALL SELECT 'common_prefix', label, n FROM words WHERE upper(label) NOT IN (SELECT label FROM numbered)""",
    "scan_language_bias": _FILES + r"""
, first AS (SELECT path, name FROM files ORDER BY path LIMIT 1024), sample AS (SELECT left(string_agg(name, '' ORDER BY path, name), 1024) AS s FROM first),
ratio AS (SELECT len(regexp_extract_all(s, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')) / nullif(len(regexp_extract_all(s, '\p{L}')), 0) AS r FROM sample)
SELECT CASE WHEN r IS NULL THEN 'unknown' WHEN r > 0.5 THEN 'cjk' WHEN r > 0.1 THEN 'mixed' ELSE 'latin' END AS bias FROM ratio""",
    "large_files": _FILES + f"SELECT path, size, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576) ELSE printf('%.1f KB', size / 1024) END AS shown FROM files WHERE size > 51200 AND extension IN ({_FORMATS})",
    "inbound_links": _LINKS + "SELECT stem, n_links, n_sources FROM inb",
    "broken_links": _LINKS + "SELECT note_id, target, count(*) AS n FROM occ WHERE target NOT IN (SELECT stem FROM stems) GROUP BY ALL",
    "orphan_notes": _LINKS + "SELECT note_id, path FROM stems WHERE coalesce(note_type, '') <> 'index' AND stem NOT IN (SELECT target FROM occ) AND note_id NOT IN (SELECT note_id FROM occ)",
    "weak_links": _LINKS + """
, outs AS (SELECT note_id, count(*) AS n_out FROM occ GROUP BY note_id)
SELECT s.note_id, coalesce(n_out, 0) + n_sources AS degree FROM stems s JOIN inb USING (stem) LEFT JOIN outs o ON o.note_id = s.note_id WHERE coalesce(note_type, '') <> 'index' AND coalesce(n_out, 0) + n_sources < 2""",
    "stem_index": _LINKS + "SELECT stem, path, min(note_id) AS note_id FROM stems s WHERE path = (SELECT max(path) FROM stems t WHERE t.stem = s.stem) GROUP BY stem, path",
    "sibling_links": """
SELECT * FROM (SELECT source_file, stem, lag(stem) OVER w AS previous, lead(stem) OVER w AS following FROM (SELECT DISTINCT source_file, stem FROM sections WHERE source_file IS NOT NULL AND stem IS NOT NULL)
  WINDOW w AS (PARTITION BY source_file ORDER BY stem)) WHERE previous IS NOT NULL OR following IS NOT NULL""",
    "category_index": _LINKS + """
, placed AS (SELECT category, stem, row_number() OVER (PARTITION BY category ORDER BY stem, note_id) AS position, count(*) OVER (PARTITION BY category) AS c FROM stems WHERE coalesce(category, '') <> '')
SELECT category, CAST(ceil(position / 500) AS INTEGER) AS page, count(*) AS n, string_agg('- [[' || stem || ']]', chr(10) ORDER BY position) AS body FROM placed WHERE c >= 2 GROUP BY 1, 2""",
    "semantic_links": f"""
WITH d AS (SELECT doc_id, text, {S.stem('path')} AS stem FROM documents), t AS (SELECT DISTINCT stem AS title FROM d WHERE length(stem) >= 3)
SELECT DISTINCT doc_id, title FROM d, t WHERE text IS NOT NULL AND contains(text, title) AND NOT contains(text, '[[' || title || ']]') AND title IS DISTINCT FROM stem""",
    "xref_links": "WITH r AS (SELECT DISTINCT section_id, stem, "
    + S.strip("reference")
    + " AS reference FROM (SELECT section_id, stem, unnest(list_concat("
    + ", ".join(f"regexp_extract_all(body, '{p}', 1)" for p in N.XREF)
    + ")) AS reference FROM (SELECT section_id, stem, concat_ws(chr(10), body, 'For this see ' || chapter, '見' || chapter) AS body FROM sections))), t AS (SELECT DISTINCT stem AS title FROM sections WHERE stem <> '') "
    + "SELECT DISTINCT section_id, (SELECT min(title) FROM t WHERE title IS DISTINCT FROM r.stem AND (contains(title, reference) OR contains(reference, title))) AS target FROM r WHERE reference <> '' AND target IS NOT NULL",
    "registry_notes": _LINKS + "SELECT note_id, path, coalesce(title, s.stem) AS title, coalesce(note_type, '') AS note_type, coalesce(len(headings), 0) AS n_headings, coalesce(len(outbound_links), 0) AS n_outbound, n_links, n_sources FROM stems s JOIN inb USING (stem)",
    "registry_sources": f"WITH {_SOURCES} SELECT source, path FROM pages",
    "registry_stats": f"WITH {_SOURCES} SELECT count(*) AS n_notes, CAST(coalesce(sum(len(outbound_links)), 0) AS BIGINT) AS n_links, count(DISTINCT nullif(category, '')) AS n_categories, (SELECT count(DISTINCT source) FROM pages) AS n_sources FROM vault_registry",
    "health_missing_metadata": f"SELECT note_id, 'type' AS missing FROM vault_registry WHERE NOT list_contains(list_transform(string_split(coalesce(frontmatter, ''), chr(10)), lambda x: {S.strip("split_part(x, ':', 1)")}), 'type')",
    "duplicate_concepts": "SELECT lower(concept_key) AS concept, count(*) AS n, min(note_id) AS first_id FROM vault_registry WHERE note_type = 'concept' AND coalesce(concept_key, '') <> '' GROUP BY 1 HAVING count(*) > 1",
    "summary_gaps": "SELECT DISTINCT path FROM raw_sources WHERE removed_at IS NULL AND path IS NOT NULL AND path NOT IN (SELECT source_path FROM vault_registry WHERE source_path IS NOT NULL)",
    "coverage_gaps": "SELECT DISTINCT path FROM raw_sources WHERE removed_at IS NULL AND path IS NOT NULL AND path NOT IN (SELECT s FROM (SELECT unnest(page_sources) AS s FROM vault_registry) WHERE s IS NOT NULL)",
    "stale_summaries": """
WITH pages AS (SELECT v.note_id AS page_id, v.path, v.source_path, max(r.source_hash) AS source_hash FROM vault_registry v LEFT JOIN raw_sources r ON r.path = v.source_path AND r.ingested_at <= v.mtime WHERE v.note_type = 'summary' AND v.source_path IS NOT NULL GROUP BY ALL),
now AS (SELECT path, max(raw_hash) AS hash FROM raw_sources WHERE removed_at IS NULL AND coalesce(raw_hash, '') <> '' GROUP BY path)
SELECT page_id, p.path FROM pages p JOIN now n ON n.path = p.source_path WHERE NOT coalesce(source_hash = hash, false)""",
    "stale_indexes": "SELECT note_id, path FROM vault_registry WHERE note_type = 'index' AND mtime < (SELECT max(mtime) FROM vault_registry)",
    "lint_missing_concepts": _LINKS + """
SELECT replace(lower(h), ' ', '-') AS heading, count(*) AS n FROM (SELECT note_id, unnest(list_distinct(headings)) AS h FROM vault_registry) GROUP BY 1
HAVING count(*) >= 2 AND heading NOT IN (SELECT stem FROM stems WHERE note_type = 'concept')""",
    "lint_conflicts": _CONCEPTS + "SELECT 'concept-pages-with-' || n || '-sources' AS conflict_group, n AS n_sources, key FROM (SELECT key, count(DISTINCT note_id) AS n FROM keyed GROUP BY key) WHERE n >= 2",
    "lint_source_hashes": "SELECT raw_id, path FROM raw_sources WHERE source_hash IS NOT NULL AND raw_hash <> source_hash",
    "lint_cold": _LINKS + """
SELECT path, note_id FROM stems WHERE mtime < TIMESTAMP '2024-01-01' AND coalesce(note_type, '') <> 'index'
AND stem NOT IN (SELECT target FROM occ JOIN vault_registry USING (note_id) WHERE mtime >= TIMESTAMP '2024-01-01')""",
    "lint_query_pages": rf"""
WITH p AS (SELECT note_id, CASE WHEN note_id % 3 = 0 THEN regexp_replace(path, '\.md$', '--v1.md') ELSE path END AS path,
  list_transform(string_split(coalesce(frontmatter || CASE WHEN note_id % 6 = 0 THEN chr(10) || 'sources: []' || chr(10) || 'derived_from_query_output: "x"' || chr(10) || 'version: 1' || chr(10) || 'version_group: "g"' WHEN note_id % 5 = 0 THEN chr(10) || 'type: index' || chr(10) || 'index_kind: "query-history"' ELSE '' END, ''), chr(10)), lambda x: {S.strip('x')}) AS f
  FROM vault_registry WHERE starts_with(path, 'queries/')),
v AS (SELECT note_id, contains(regexp_replace(path, '^.*/', ''), '--v') AS ver, list_filter(['question', 'sources', 'derived_from_query_output', 'version', 'version_group'], lambda n: NOT list_contains(list_transform(f, lambda x: {S.strip("split_part(x, ':', 1)")}), n)) AS m,
  coalesce(trim(regexp_replace(list_extract(list_filter(f, lambda x: starts_with(x, 'type:')), -1), '^.*:', '')), '') AS t, coalesce(trim(trim(regexp_replace(list_extract(list_filter(f, lambda x: starts_with(x, 'index_kind:')), -1), '^.*:', '')), '"'), '') AS k FROM p)
SELECT note_id, CASE WHEN ver THEN 'version' ELSE 'history' END AS violation, CASE WHEN ver THEN array_to_string(m, ',') ELSE '' END AS missing FROM v
WHERE ver AND (t <> 'query-note' OR len(m) > 0) OR NOT ver AND (t <> 'index' OR k <> 'query-history')""",
    "lint_contract": r"""
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '[[open]' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '[x](' || path || ')' ELSE '' END AS text FROM documents)
SELECT * FROM (
  SELECT doc_id, 'unbalanced_wikilink' AS violation, CAST(len(string_split(text, '[[')) <> len(string_split(text, ']]')) AS INTEGER) AS n FROM t WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'markdown_link', len(list_filter(regexp_extract_all(text, '\[[^\]]+\]\(([^)]+)\)', 1), lambda x: ends_with(x, '.md') AND NOT contains(x, '://'))) FROM t WHERE text IS NOT NULL) WHERE n > 0""",
    "homepage": f"""
WITH i AS (SELECT {S.category('path')} AS section, path, note_id, '- [[' || regexp_replace(path, '\\.md$', '') || ']]' || CASE WHEN coalesce(summary, '') <> '' THEN ': ' || left(summary, 180) ELSE '' END AS item FROM vault_registry),
p AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY path, note_id) AS position FROM i)
SELECT section, CAST(ceil(position / 500) AS INTEGER) AS page, count(*) AS n, string_agg(item, chr(10) ORDER BY position) AS body FROM p GROUP BY 1, 2""",
    "parent_links": "SELECT s.section_id, min(t.section_id) AS parent_id FROM sections s JOIN sections t ON t.source_file = s.source_file AND t.stem = s.parent WHERE s.parent <> '' GROUP BY s.section_id",
    "registry_children": "SELECT parent, count(*) AS n_children FROM vault_registry WHERE coalesce(parent, '') <> '' GROUP BY parent",
    "alias_expand": f"""
WITH q AS (SELECT note_id AS question_id, concat_ws(' ', question, title, category) AS question FROM vault_registry),
t AS (SELECT DISTINCT question_id, unnest({S.tokens('question')}) AS token FROM q),
a AS (SELECT DISTINCT subject_code AS topic, lower(unnest(list_concat([subject_code], {S.tokens('description')}))) AS alias FROM subjects)
SELECT DISTINCT question_id, token, o.alias AS term FROM t JOIN a k ON k.alias = token JOIN a o ON o.topic = k.topic UNION SELECT question_id, token, token FROM t""",
    "file_progress": "SELECT CASE WHEN content IS NULL THEN 'error' WHEN removed_at IS NOT NULL THEN 'removed' WHEN source_hash IS NULL THEN 'pending' ELSE 'converted' END AS status, count(*) AS n FROM raw_sources GROUP BY 1",
    "ingest_delta": """
WITH b AS (SELECT path, max(raw_hash) AS old FROM raw_sources WHERE ingested_at < TIMESTAMP '2024-07-01' GROUP BY path), a AS (SELECT path, max(source_hash) AS new FROM raw_sources WHERE removed_at IS NULL GROUP BY path)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' WHEN old = new THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path""",
    "compile_dirty": """
WITH s AS (SELECT path, max(raw_hash) AS hash FROM raw_sources WHERE removed_at IS NULL GROUP BY path), t AS (SELECT path, max(source_hash) AS h FROM raw_sources GROUP BY path)
SELECT s.path FROM s LEFT JOIN t ON t.path = s.path WHERE NOT coalesce(s.hash = t.h AND s.path IN (SELECT source_path FROM vault_registry WHERE note_type = 'summary' AND source_path IS NOT NULL), false)""",
    "concept_pages": _CONCEPTS + "SELECT key, arg_min(candidate, note_id * 100 + place) AS title, count(DISTINCT candidate) AS n_aliases, count(DISTINCT note_id) AS n_sources FROM keyed GROUP BY key",
    "concept_sources": _CONCEPTS + "SELECT DISTINCT key, note_id FROM keyed",
    "summary_pages": f"""
WITH d AS (SELECT path, {S.title('text', S.stem('path'))} AS title, sha256(text) AS hash, {S.first_paragraphs('text')} AS p FROM documents WHERE text IS NOT NULL)
SELECT 'wiki/summaries/' || {S.path_slug('path')} || '.md' AS path, array_to_string(['---', 'type: "summary"', 'title: "' || replace(title, '"', '\\"') || '"', 'source_path: "' || path || '"', 'source_hash: "' || hash || '"', '---', '', '# ' || title, '', p, ''], chr(10)) AS content FROM d""",
    "book_progress": " UNION ALL ".join(f"SELECT '{s}' AS stage, CAST(count(*) FILTER (stages.{s}) AS BIGINT) AS n_books FROM books" for s in ("detected", "converted", "split", "layout_checked", "patched", "compiled", "promoted")),
    "promotion_targets": f"""
WITH e AS (SELECT note_id, {S.stem('path')} AS stem, 'distilled/' || {S.slug("coalesce(category, 'notes')")} || '/' || {S.file_name("coalesce(title, 'untitled')")} AS target FROM vault_registry WHERE note_type = 'summary')
SELECT note_id, CASE WHEN note_id = min(note_id) OVER (PARTITION BY target) THEN target ELSE target || '-' || stem END || '.md' AS target_path FROM e""",
    "promotion_plan": f"""
WITH p AS (SELECT {S.slug('title')} AS target, source_file AS owner, summary AS content FROM vault_registry WHERE note_type = 'summary'),
x AS (SELECT target, max(struct_pack(o := owner, c := content)) AS e FROM (SELECT {S.slug('title')} AS target, source_file AS owner, summary AS content FROM vault_registry WHERE note_type = 'distilled-note') GROUP BY target)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN x.target IS NULL THEN 'write' WHEN NOT coalesce(e.o = owner, false) THEN 'conflict' WHEN e.c = content THEN 'identical' ELSE 'update' END AS action FROM p LEFT JOIN x ON x.target = p.target) GROUP BY action""",
    "promotion_stale": "SELECT DISTINCT book_slug, target FROM (SELECT book_slug, unnest(root_notes) AS target FROM books) WHERE target NOT IN (SELECT path FROM vault_registry)",
    "path_escape_guard": "SELECT DISTINCT note_id, link, NOT (starts_with(link, '/') OR starts_with(link, '..')) AS inside FROM (SELECT note_id, unnest(outbound_links) AS link FROM vault_registry) WHERE link IS NOT NULL",
    "log_entries": r"""
WITH l AS (SELECT CAST(user_id % 50 AS VARCHAR) AS log, event_id AS no, CASE WHEN event_id % 3 = 0 THEN '## [' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || ' | user ' || user_id WHEN event_id % 7 = 1 THEN '## [broken' ELSE '- value of ' || event_type END AS text FROM events),
h AS (SELECT log, no, text, row_number() OVER w AS seq, lead(no) OVER w AS nx FROM l WHERE starts_with(text, '## [') WINDOW w AS (PARTITION BY log ORDER BY no)), e AS (SELECT log, max(no) AS last FROM l GROUP BY log)
SELECT log, seq, regexp_extract(text, '^## \[(.+?)\] ', 1) AS stamp, trim(regexp_extract(text, '\] ([^|]+)\|', 1)) AS operation, CASE WHEN contains(text, '|') THEN trim(split_part(text, '|', 2)) ELSE trim(substr(text, 4)) END AS title,
       CAST(coalesce(nx, last + 1) - no - 1 AS INTEGER) AS n_lines FROM h JOIN e USING (log)""",
    "base_view": """
SELECT note_id, title, len(outbound_links) AS n_links, CASE WHEN status = 'draft' THEN 'open' ELSE 'done' END AS age FROM vault_registry
WHERE note_type IN ('summary', 'concept') AND (contains(title, 'Ledger') OR status = 'draft') AND coalesce(category, '') <> '' AND line_count > 100 AND NOT contains(path, 'quarry')""",
    "base_view_groups": "SELECT status, count(*) AS n, CASE status WHEN 'draft' THEN 1 WHEN 'active' THEN 2 ELSE 3 END AS place FROM vault_registry GROUP BY status",
    "progress_matrix": """
SELECT CASE WHEN grouping(c) = 1 THEN 'Total' ELSE coalesce(c, 'none') END AS category, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) AS n,
       round(100 * count(*) FILTER (status = 'reviewed') / count(*), 1) AS percent FROM (SELECT lower(category) AS c, status FROM vault_registry) GROUP BY ROLLUP (c)""",
}
