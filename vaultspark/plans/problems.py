"""Queries of the general problems (p4, p6) and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.operators import hierarchy as H
from vaultspark.operators import references as R
from vaultspark.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return R.find_orphans(table(spark, d, "vault_registry"), table(spark, d, "raw_sources"))


def _orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(table(spark, d, "vault_registry"), table(spark, d, "raw_sources"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "sections"), paths=False).select("section_id", "root_id", "depth")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "sections")).select("section_id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "n_descendants", "is_back_edge")


def _descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, d, "sections")), loops=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": _orphans,
    "p4_report": _orphan_report,
    "p6_found": _roots,
    "p6_paths": _paths,
    "p6_descendants": _descendants,
}

_REFS = r"""
refs AS (
  SELECT DISTINCT note_id, mtime AS moment, field_name, target_ref,
         CASE WHEN field_name = 'outbound_links'
              THEN trim(list_extract(string_split(split_part(split_part(target_ref, '|', 1), '#', 1), '/'), -1)) ELSE target_ref END AS ref_key,
         CASE WHEN field_name = 'outbound_links' THEN 'note' ELSE 'raw' END AS kind
  FROM (SELECT note_id, mtime, 'outbound_links' AS field_name, unnest(outbound_links) AS target_ref FROM vault_registry
        UNION ALL SELECT note_id, mtime, 'page_sources', unnest(page_sources) FROM vault_registry
        UNION ALL SELECT note_id, mtime, 'source_path', source_path FROM vault_registry)
  WHERE target_ref IS NOT NULL),
periods AS (
  SELECT 'note' AS kind, regexp_replace(regexp_replace(path, '^.*/', ''), '\.md$', '') AS ref_key, mtime AS begins, removed_at AS ends FROM vault_registry
  UNION ALL SELECT 'raw', path, ingested_at, removed_at FROM raw_sources),
judged AS (
  SELECT r.note_id, r.moment, r.field_name, r.target_ref,
         count(p.ref_key) AS n, count(*) FILTER (p.begins <= r.moment) AS begun,
         count(*) FILTER (p.begins <= r.moment AND (p.ends IS NULL OR p.ends > r.moment)) AS there
  FROM refs r LEFT JOIN periods p ON p.kind = r.kind AND p.ref_key = r.ref_key GROUP BY ALL),
orphans AS (
  SELECT note_id, field_name, target_ref, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason,
         strftime(moment, '%Y-%m') AS period FROM judged WHERE there = 0)
"""

_WALK = """
nodes AS (
  SELECT s.section_id, (SELECT min(t.section_id) FROM sections t WHERE t.source_file = s.source_file AND t.stem = s.parent AND s.parent <> '') AS parent_id FROM sections s),
up AS (
  SELECT section_id, section_id AS cur, 0 AS steps, [section_id] AS seen, false AS again FROM nodes
  UNION ALL
  SELECT u.section_id, n.parent_id, u.steps + 1, list_append(u.seen, n.parent_id), list_contains(u.seen, n.parent_id)
  FROM up u JOIN nodes n ON n.section_id = u.cur WHERE n.parent_id IS NOT NULL AND NOT u.again),
ends AS (SELECT section_id, cur, seen, again FROM up u WHERE again OR (SELECT parent_id FROM nodes n WHERE n.section_id = u.cur) IS NULL),
found AS (
  SELECT section_id, CASE WHEN again THEN list_min(list_slice(seen, list_position(seen, cur), -1)) ELSE cur END AS root_id,
         CASE WHEN NOT again THEN len(seen) - 1 WHEN cur = section_id THEN -1 ELSE -2 END AS depth, again, seen FROM ends)
"""

ORACLE: dict[str, str] = {
    "p4_found": f"WITH {_REFS} SELECT note_id, field_name, target_ref, reason, period FROM orphans",
    "p4_report": f"""WITH {_REFS}
SELECT t.field_name, t.period, t.n_refs, count(*) FILTER (o.reason = 'missing') AS n_missing, count(*) FILTER (o.reason = 'late') AS n_late,
       count(*) FILTER (o.reason = 'deleted') AS n_deleted
FROM (SELECT field_name, strftime(moment, '%Y-%m') AS period, count(*) AS n_refs FROM refs GROUP BY ALL) t
LEFT JOIN orphans o ON o.field_name = t.field_name AND o.period = t.period GROUP BY ALL""",
    "p6_found": f"WITH RECURSIVE {_WALK} SELECT section_id, root_id, CAST(depth AS INTEGER) AS depth FROM found",
    "p6_paths": f"""WITH RECURSIVE {_WALK},
below AS (SELECT cur, count(DISTINCT section_id) AS n FROM up WHERE cur <> section_id GROUP BY cur)
SELECT f.section_id, root_id, CAST(depth AS INTEGER) AS depth, array_to_string(list_reverse(list_slice(seen, 1, list_position(seen, root_id))), '/') AS path,
       coalesce(b.n, 0) AS n_descendants, depth = -1 AND root_id = f.section_id AS is_back_edge FROM found f LEFT JOIN below b ON b.cur = f.section_id""",
    "p6_descendants": f"""WITH RECURSIVE {_WALK}
SELECT cur AS section_id, section_id AS descendant_id, CAST(min(steps) AS INTEGER) AS distance FROM up WHERE cur <> section_id GROUP BY cur, section_id""",
}
