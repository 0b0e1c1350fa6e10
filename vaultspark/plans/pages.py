"""Queries over page texts: chapters, layout damage, patches, ranking and answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.functions import sql as S
from vaultspark.operators import layout, patch, rank, split, workset
from vaultspark.operators import notes as N
from vaultspark.session import table

MIN_LINES = 4


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _boundaries(spark: SparkSession, d: str) -> DataFrame:
    return split.boundaries(_docs(spark, d), "doc_id", "text")


def _absorbed(spark: SparkSession, d: str) -> DataFrame:
    kept = split.with_boundaries(_docs(spark, d), "doc_id", "text").withColumn("kept", split.absorb(F.col("boundaries"), MIN_LINES))
    return kept.select("doc_id", F.explode("kept").alias("b")).select("doc_id", "b.line", "b.type")


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return split.chapters(_docs(spark, d), "doc_id", "text", MIN_LINES)


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return _chapters(spark, d).filter("end_line - first_line > 15").select("doc_id", "seq", (F.col("end_line") - F.col("first_line")).alias("n_lines"))


def _pattern_set(spark: SparkSession, d: str) -> DataFrame:
    return split.pattern_set(_docs(spark, d), "doc_id", "text")


def _by_set(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of every text by each of the pattern sets."""
    parts = [split.boundaries(_docs(spark, d), "doc_id", "text", patterns).select("doc_id", F.lit(name).alias("pattern_set"), "line", "type") for name, patterns in split.PATTERN_SETS.items()]
    return reduce(DataFrame.unionByName, parts)


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return split.fitted(_docs(spark, d), "doc_id", "text")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return patch.batches(_validated(spark, d), F.date_format("queued_at", "yyyy-MM-dd"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.candidates(table(spark, d, "layout_candidates"), "candidate_id", "source_excerpt")


#: Excerpts with damage of three kinds added, which the tables don't have; one expression for both engines.
PLANTED = """coalesce(source_excerpt, '') || CASE start_line % 4 WHEN 0 THEN chr(10) || '甲合乙' || chr(10) || 'ab' || chr(10) || '丙冲丁' || chr(10) || 'cd'
  WHEN 1 THEN chr(10) || '## ' || coalesce(heading, 'x') || chr(10) || 'a' || chr(10) || 'bc' || chr(10) || '- no' || chr(10) || 'de' || chr(10) || 'f'
  WHEN 2 THEN chr(10) || '- one item here' || chr(10) || 'ab' || chr(10) || 'cd' ELSE '' END"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    return layout.candidates(table(spark, d, "layout_candidates").select("candidate_id", F.expr(PLANTED).alias("text")), "candidate_id", "text")


def _risk(risk: str, planted: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: (_planted if planted else _layout)(spark, d).filter(F.col("risk_type") == risk).select("candidate_id", "start_line", "end_line")


def _context(spark: SparkSession, d: str) -> DataFrame:
    listed = [F.array_join(c, "\n").alias(c) for c in ("context_before", "context_after")]
    return _planted(spark, d).select("candidate_id", "risk_type", "start_line", "page_hint", *listed)


def _page_hints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "layout_candidates").select("candidate_id", layout.page_hint(md.lines(F.col("source_excerpt"))).alias("hint")).filter("hint is not null")


def _top(spark: SparkSession, d: str) -> DataFrame:
    return layout.top(table(spark, d, "layout_candidates")).select("candidate_id", "confidence")


def _layout_documents(spark: SparkSession, d: str) -> DataFrame:
    return layout.candidates(_docs(spark, d), "doc_id", "text").select("doc_id", "risk_type", "start_line", "end_line")


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "layout_candidates").withColumn("plain", layout.normalised(F.col("source_excerpt")))
    return layout.deduplicated(found, ["chapter_path", "risk_type", "plain"]).select("candidate_id")


def _risk_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "layout_candidates").groupingSets([["risk_type"], ["chapter_path"]], "risk_type", "chapter_path").agg(F.count("*").alias("n"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return patch.validated(table(spark, d, "patch_queue"), table(spark, d, "layout_candidates"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("queue_pos", F.array_join("errors", "; ").alias("errors")).filter("errors <> ''")


def _approved(spark: SparkSession, d: str) -> DataFrame:
    return patch.approved(_validated(spark, d), min_confidence=0.8).select("queue_pos")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return patch.latest(table(spark, d, "patch_queue")).select("key", "queue_pos")


def _ready(spark: SparkSession, d: str) -> DataFrame:
    valid = patch.approved(_validated(spark, d), min_confidence=0.8).drop("errors")
    found = table(spark, d, "layout_candidates").select("candidate_id", "chapter_path", F.col("source_excerpt").alias("target_excerpt"), "start_line").dropDuplicates(["candidate_id"])
    return patch.latest(valid).join(found, "candidate_id").withColumn("replacement", patch.rendered())


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    return _ready(spark, d).select("queue_pos", "replacement")


def _applied(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "layout_candidates").groupBy("chapter_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "candidate_id", "source_excerpt"))), lambda x: x["source_excerpt"]), "\n\n").alias("content"))
    return patch.applied(own, _ready(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth note's question, its title where it has none."""
    asked = table(spark, d, "vault_registry").filter("note_id % 100 = 0")
    return asked.select(F.col("note_id").alias("question_id"), F.coalesce("question", "title").alias("question"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(_questions(spark, d), rank.corpus(_docs(spark, d)))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """The sources of a workset: every hundredth raw source that is there."""
    return table(spark, d, "raw_sources").filter("raw_id % 100 = 0 and removed_at is null and content is not null").groupBy(F.col("path").alias("source_path")).agg(F.max_by("content", "raw_id").alias("text"))


def _review(spark: SparkSession, d: str) -> DataFrame:
    return workset.pages_to_review(_changed(spark, d), _docs(spark, d), ["wiki/index.md"])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    raws = table(spark, d, "raw_sources").filter("removed_at is null and content is not null").groupBy(F.col("path").alias("source_path")).agg(F.max_by("content", "raw_id").alias("text"))
    return workset.entries(raws).select("source_path", "summary_page", F.array_join("concept_pages", ",").alias("concept_pages"), "evidence")


def _hints(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, bonus, entry: two points for pages of the workset, one for those the index mentions, and the registry's entry."""
    docs, notes = _docs(spark, d), table(spark, d, "vault_registry")
    pages = docs.select("doc_id", F.col("path").alias("page"), F.replace(F.regexp_replace("path", "^wiki/", ""), F.lit(".md"), F.lit("")).alias("name"))
    named_by = workset.pages_of(_changed(spark, d), docs, ["wiki/index.md"]).withColumn("asked", F.lit(2))
    pages = pages.join(named_by, "page", "left")
    named = rank.mentioned(pages.filter("page <> 'wiki/index.md'"), notes.select(N.homepage_item().alias("text"))).withColumn("named", F.lit(1))
    known = pages.join(named, "name", "left").join(rank.registry_entries(notes), "page", "left")
    return known.select("doc_id", (F.coalesce("asked", F.lit(0)) + F.coalesce("named", F.lit(0))).alias("bonus"), "entry").filter("bonus > 0 or entry is not null")


def _hinted(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(_questions(spark, d), rank.corpus(_docs(spark, d)), hints=_hints(spark, d))


def _answers(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rank.answers(_questions(spark, d), _ranked(spark, d), _docs(spark, d).filter("text is not null"), mode).select("question_id", "body")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "vault_registry").filter("question is not null")
    keyed = notes.select(md.query_slug(F.col("question")).alias("slug"), F.left(F.sha1(F.coalesce("summary", F.lit(""))), F.lit(12)).alias("hash"), "note_id", "mtime")
    filed = keyed.groupBy("slug").agg(F.max_by("hash", "note_id").alias("hash"))
    latest = keyed.filter("mtime < timestamp_ntz'2024-07-01 00:00:00'").groupBy("slug").agg(F.count("*").cast("int").alias("version"), F.max_by("hash", F.struct("mtime", "note_id")).alias("hash"))
    return rank.versioned(filed, latest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rank_notes": _ranked,
    "rank_notes_hinted": _hinted,
    "workset": _review,
    "workset_entries": _entries,
    "answer_scaffold": _answers("scaffold"),
    "answer_synthesis": _answers("synthesize"),
    "query_versions": _versions,
    "boundaries": _boundaries,
    "absorb_sections": _absorbed,
    "split_chapters": _chapters,
    "oversized_sections": _oversized,
    "pattern_set_select": _pattern_set,
    "boundaries_by_set": _by_set,
    "fitted_pieces": _fitted,
    "patch_batches": _batches,
    "layout_table_runs": _risk("table_fragment"),
    "layout_chart_runs": _risk("chart_block"),
    "layout_short_runs": _risk("short_column_relation", True),
    "layout_noise": _risk("running_header_noise"),
    "layout_heading_break": _risk("heading_break", True),
    "layout_list_runs": _risk("list_fragment", True),
    "layout_documents": _layout_documents,
    "layout_context": _context,
    "page_hints": _page_hints,
    "layout_top": _top,
    "layout_dedupe": _deduplicated,
    "layout_counts": _risk_counts,
    "patch_validate": _errors,
    "patch_approve": _approved,
    "patch_merge": _merged,
    "patch_render": _rendered,
    "patch_apply": _applied,
}

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(x, '{r}') THEN '{t}'" for r, t in split.PATTERNS) + " END"
_BOUNDS = f"""
lined AS (SELECT doc_id, {S.lines('text')} AS l FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS x FROM lined),
bounds AS (SELECT doc_id, CAST(line AS INTEGER) AS line, {_KIND} AS type, {S.strip("regexp_replace(x, '^#+[ " + chr(92) + "t]*', '')")} AS title FROM each WHERE {_KIND} IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM bounds),
fold AS (SELECT doc_id, k, line, type, title, line AS anchor, true AS kept FROM numbered WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, n.line, n.type, n.title, CASE WHEN n.line - f.anchor >= {MIN_LINES} THEN n.line ELSE f.anchor END, n.line - f.anchor >= {MIN_LINES} FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.k = f.k + 1),
starts AS (SELECT doc_id, line, type, title FROM fold WHERE kept UNION ALL SELECT doc_id, 0, 'preamble', 'preamble' FROM fold WHERE k = 1 AND line > 0),
secs AS (SELECT s.doc_id, lpad(CAST(row_number() OVER w AS VARCHAR), 2, '0') AS seq, s.line AS first_line, CAST(coalesce(lead(s.line) OVER w, len(l)) AS INTEGER) AS end_line, type, title, l FROM starts s JOIN lined USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.line))
"""
# RE2 has no lookahead; after `# ` another # can only be told by what follows
_SQL_SETS = {name: [(r.replace("(?!#)", "([^#]|$)"), t) for r, t in patterns] for name, patterns in split.PATTERN_SETS.items()}
_ANY = {name: "(" + " OR ".join(f"regexp_matches(x, '{r}')" for r, _ in patterns) + ")" for name, patterns in _SQL_SETS.items()}
_TYPED = {name: "CASE " + " ".join(f"WHEN regexp_matches(x, '{r}') THEN '{t}'" for r, t in patterns) + " END" for name, patterns in _SQL_SETS.items()}
_HEADING, _ITEM = r"^\s{0,3}#{1,6}\s+", r"^\s*(?:[-*•]\s+|\d+[.)、]\s+|[一二三四五六七八九十]+[、.)])"
_NOISE = r"^\s*(?:\d+|Page\s+\d+|第\s*\d+\s*页|[-_=]{2,}|[·•])\s*$"
_CHART = ", ".join(f"'{c}'" for c in sorted(layout.CHART))
_CELLS = r"list_filter(regexp_split_to_array(t, '\s{2,}|\t+'), lambda c: c <> '')"


def _lines(key: str, text: str, source: str) -> str:
    return f"""
WITH split_ AS (SELECT {key} AS candidate_id, {S.lines('t_')} AS l FROM (SELECT {key}, {text} AS t_ FROM {source}) WHERE t_ IS NOT NULL),
raw AS (SELECT candidate_id, generate_subscripts(l, 1) AS no, unnest(l) AS r FROM split_),
lines AS (SELECT *, {S.strip('r')} AS t, regexp_matches(r, '{_HEADING}') AS head FROM raw),
marked AS (SELECT *, t <> '' AND NOT head AS fit, regexp_matches(t, '{_ITEM}') AS item FROM lines)
"""


_LINES = _lines("candidate_id", "source_excerpt", "layout_candidates")
_PLANTED = _lines("candidate_id", PLANTED, "layout_candidates")


def _islands(condition: str, more: str = "") -> str:
    return f"""
, island AS (SELECT *, no - row_number() OVER (PARTITION BY candidate_id ORDER BY no) AS g FROM (SELECT *{more} FROM marked) WHERE {condition})
"""


_CORPUS = r"""NOT coalesce(path IN ('wiki/index.md', 'wiki/log.md') OR page_type = 'query-note' OR page_type = 'index' AND regexp_matches(text, '\A---[^\n]*\n(?:[^\n]*\n)*?index_kind:[ \t]*"?query-history'), false)"""
_CONTENT = f"d AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL AND {_CORPUS})"
_RANK = f"""
WITH q AS (SELECT note_id AS question_id, coalesce(question, title) AS question FROM vault_registry WHERE note_id % 100 = 0),
tok AS (SELECT DISTINCT question_id, unnest({S.tokens('question')}) AS token FROM q), {_CONTENT},
hit AS (SELECT question_id, doc_id, CAST(sum((length(text) - length(replace(text, token, ''))) / length(token)) AS BIGINT) AS score FROM tok, d GROUP BY ALL HAVING score > 0),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM hit) WHERE place <= 5)
"""
_LISTED = f"""
, full_ AS (SELECT question_id, place, doc_id, score, {S.summary('text', 320)} AS preview, {S.title('text', chr(39) + 'untitled' + chr(39))} AS title FROM top JOIN documents USING (doc_id))
"""
_DISTINCT_CONCEPTS = S.concept_candidates("title", "headings")
_CONCEPT_PAGES = f"list_transform({_DISTINCT_CONCEPTS}, lambda c: 'wiki/concept/' || {S.slug('c')} || '.md')"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda p, i: list_position({x}, p) = i)"


_DESCRIBED = f"""
one AS (SELECT path AS source_path, arg_max(content, raw_id) AS text FROM raw_sources WHERE removed_at IS NULL AND content IS NOT NULL {{where}} GROUP BY path),
src AS (SELECT source_path, text, {S.title('text', S.stem('source_path'))} AS title, {S.headings('text')} AS headings, {S.category("regexp_replace(source_path, '^raw/sources/', '')")} AS category,
  'wiki/summary/' || ({S.category("regexp_replace(source_path, '^raw/sources/', '')")}) || '/' || {S.path_slug(S.stem('source_path'))} || '.md' AS summary_page FROM one)"""
_WORKSET = _DESCRIBED.replace("{where}", "AND raw_id % 100 = 0") + f""",
terms AS (SELECT DISTINCT source_path, summary_page, lower(unnest(list_concat([title], list_slice(headings, 1, 4)))) AS term FROM src),
review AS (SELECT source_path, path AS page, 0 AS r FROM src JOIN documents ON starts_with(path, 'wiki/summary/' || category || '/') WHERE path <> summary_page
  UNION ALL SELECT source_path, page, 1 FROM (SELECT source_path, unnest({_CONCEPT_PAGES}) AS page FROM src) WHERE page IN (SELECT path FROM documents)
  UNION ALL SELECT source_path, path, 2 FROM terms JOIN documents ON term <> '' AND (contains(lower(coalesce(text, '')), term) OR contains(lower({S.stem('path')}), term)) WHERE path <> summary_page AND path <> 'wiki/index.md'
  UNION ALL SELECT source_path, 'wiki/index.md', 3 FROM src)"""
_ENTRY = ", ".join(f"'{name}:' || {'array_to_string(' + c + ', chr(10))' if c in ('headings', 'outbound_links', 'tags') else c}" for c, name in rank.ENTRY_FIELDS.items())
_PATCH = """
WITH known AS (SELECT DISTINCT candidate_id FROM layout_candidates),
v AS (SELECT p.*, concat_ws('; ',
  CASE WHEN coalesce(p.candidate_id, '') = '' THEN 'no candidate is named' END,
  CASE WHEN NOT coalesce(operation IN ('replace_block', 'wrap_code_block', 'replace_with_table', 'join_lines', 'drop_noise_lines'), false) THEN 'unknown operation ' || coalesce(operation, 'null') END,
  CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence is not within 0 and 1' END,
  CASE WHEN payload IS NULL THEN 'no payload' END,
  CASE WHEN coalesce(p.candidate_id, '') <> '' AND k.candidate_id IS NULL THEN 'candidate is unknown' END,
  CASE WHEN operation = 'replace_block' AND payload.replacement IS NULL THEN 'replacement is missing' END,
  CASE WHEN operation = 'wrap_code_block' AND payload.content IS NULL THEN 'content is missing' END,
  CASE WHEN operation = 'replace_with_table' AND (coalesce(len(payload.header), 0) < 1 OR len(list_filter(payload.header, lambda x: x IS NULL)) > 0) THEN 'header is missing or has a null cell' END,
  CASE WHEN operation = 'replace_with_table' AND (payload.cell_rows IS NULL OR len(list_filter(payload.cell_rows, lambda x: x IS NULL)) > 0) THEN 'rows are missing or one is null' END,
  CASE WHEN operation = 'drop_noise_lines' AND len(list_filter(payload.noise_lines, lambda x: x IS NULL)) > 0 THEN 'a noise line is null' END) AS errors
  FROM patch_queue p LEFT JOIN known k ON k.candidate_id = p.candidate_id)
"""
_KEY = "coalesce(nullif(patch_id, ''), concat_ws(':', candidate_id, operation))"

LAYOUT = {"layout_table_runs": "table_fragment", "layout_chart_runs": "chart_block", "layout_short_runs": "short_column_relation", "layout_noise": "running_header_noise", "layout_heading_break": "heading_break", "layout_list_runs": "list_fragment"}
PLANTED_RISKS = {"short_column_relation", "heading_break", "list_fragment"}
_DETECT = {
    "table_fragment": _islands("n >= 3 AND list_max(list_transform(c, lambda x: length(x))) <= 12 AND fit", f", {_CELLS} AS c, len({_CELLS}) AS n") + """
, ends AS (SELECT *, last_value(n) OVER w AS last_n, max(no) OVER w AS last FROM island WINDOW w AS (PARTITION BY candidate_id, g ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tail AS (SELECT candidate_id, g, last, coalesce(max(no) FILTER (n <> last_n), min(no) - 1) + 1 AS first FROM ends GROUP BY candidate_id, g, last)
SELECT candidate_id, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line FROM tail WHERE last - first >= 2""",
    "chart_block": _islands("fit AND length(t) <= 24 AND n <= 8 AND known >= greatest(2, n // 2)", f", len(regexp_extract_all(t, '[^ ]+')) AS n, len(list_filter(regexp_extract_all(t, '[^ ]+'), lambda x: x IN ({_CHART}))) AS known") + "SELECT candidate_id, CAST(min(no) AS INTEGER) AS start_line, CAST(max(no) AS INTEGER) AS end_line FROM island GROUP BY candidate_id, g HAVING count(*) >= 4",
    "short_column_relation": _islands("fit AND length(t) <= 8 AND NOT item") + "SELECT candidate_id, CAST(min(no) AS INTEGER) AS start_line, CAST(max(no) AS INTEGER) AS end_line FROM island GROUP BY candidate_id, g HAVING count(*) >= 4 AND count(*) FILTER (regexp_matches(t, '[刑冲破害合克生]')) >= 2",
    "running_header_noise": f"""
, prev AS (SELECT *, last_value(CASE WHEN t <> '' THEN head END IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_head FROM marked)
SELECT candidate_id, CAST(no AS INTEGER) AS start_line, CAST(no AS INTEGER) AS end_line FROM prev WHERE after_head AND regexp_matches(r, '{_NOISE}')""",
    "heading_break": """
, probe AS (SELECT h.candidate_id, h.no, p.no AS p_no, p.t, p.item, min(CASE WHEN length(p.t) > 12 THEN p.no END) OVER (PARTITION BY h.candidate_id, h.no) AS stop FROM marked h JOIN marked p ON p.candidate_id = h.candidate_id AND p.no BETWEEN h.no + 1 AND h.no + 5 WHERE h.head)
SELECT candidate_id, CAST(no AS INTEGER) AS start_line, CAST(max(p_no) FILTER (t <> '') AS INTEGER) AS end_line FROM probe WHERE stop IS NULL OR p_no < stop GROUP BY candidate_id, no HAVING count(*) FILTER (t <> '' AND length(t) <= 4 AND NOT item) >= 3""",
    "list_fragment": _islands("fit AND (length(t) <= 4 OR item)") + """
, begun AS (SELECT *, min(CASE WHEN item THEN no END) OVER (PARTITION BY candidate_id, g) AS first FROM island)
SELECT candidate_id, CAST(first AS INTEGER) AS start_line, CAST(max(no) AS INTEGER) AS end_line FROM begun WHERE first IS NOT NULL GROUP BY candidate_id, g, first HAVING count(*) FILTER (no > first AND length(t) <= 4) >= 2""",
}

ORACLE: dict[str, str] = {
    "rank_notes": _RANK + "SELECT question_id, doc_id, score, place FROM top",
    "workset": f"WITH {_WORKSET} SELECT source_path, page, CASE min(r) WHEN 0 THEN 'category' WHEN 1 THEN 'concept' WHEN 2 THEN 'term' ELSE 'recent' END AS reason FROM review GROUP BY source_path, page",
    "workset_entries": f"""
WITH {_DESCRIBED.replace(chr(123) + "where" + chr(125), "")}
SELECT source_path, summary_page, array_to_string({_distinct(_CONCEPT_PAGES)}, ',') AS concept_pages, array_to_string(list_concat(['title: ' || title, 'excerpt: ' || CASE WHEN e = '' THEN 'none' ELSE e END], list_transform(list_slice(headings, 1, 4), lambda h: 'heading: ' || h)), chr(10)) AS evidence
FROM (SELECT *, left({S.first_paragraphs('text')}, 280) AS e FROM src)""",
    "rank_notes_hinted": f"""
WITH {_WORKSET}, q AS (SELECT note_id AS question_id, coalesce(question, title) AS question FROM vault_registry WHERE note_id % 100 = 0),
tok AS (SELECT DISTINCT question_id, unnest({S.tokens('question')}) AS token FROM q),
asked AS (SELECT DISTINCT page FROM review UNION SELECT summary_page FROM src UNION SELECT unnest({_CONCEPT_PAGES}) FROM src),
home AS (SELECT '- [[' || regexp_replace(path, '\\.md$', '') || ']]' || CASE WHEN coalesce(summary, '') <> '' THEN ': ' || left(summary, 180) ELSE '' END AS item FROM vault_registry),
index_ AS (SELECT string_agg(item, chr(10)) AS t FROM home),
reg AS (SELECT 'wiki/' || path AS page, arg_max(lower(concat_ws(chr(10), {_ENTRY})), note_id) AS entry FROM vault_registry WHERE path IS NOT NULL GROUP BY path),
pages AS (SELECT doc_id, lower(text) AS text, entry, CASE WHEN d.path IN (SELECT page FROM asked) THEN 2 ELSE 0 END + CASE WHEN d.path <> 'wiki/index.md' AND contains(t, replace(regexp_replace(d.path, '^wiki/', ''), '.md', '')) THEN 1 ELSE 0 END AS bonus
  FROM documents d CROSS JOIN index_ LEFT JOIN reg ON reg.page = d.path WHERE d.text IS NOT NULL AND {_CORPUS}),
hit AS (SELECT question_id, doc_id, CAST(coalesce(sum((length(text) - length(replace(text, token, ''))) / length(token) + CASE WHEN contains(entry, token) THEN 1 ELSE 0 END), 0) + max(bonus) AS BIGINT) AS score
  FROM q JOIN pages ON question IS NOT NULL LEFT JOIN tok USING (question_id) GROUP BY ALL HAVING score > 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM hit) WHERE place <= 5""",
    "answer_scaffold": _RANK + _LISTED + r"""
SELECT q.question_id, CASE WHEN max(place) IS NULL THEN '# ' || question || chr(10) || 'No matching pages.' ELSE '# ' || question || chr(10) || '## Sources' || chr(10) ||
  string_agg('- [[' || doc_id || ']] (score: ' || score || ')' || chr(10) || '  - ' || preview, chr(10) ORDER BY place) END AS body
FROM q LEFT JOIN full_ f USING (question_id) WHERE question IS NOT NULL GROUP BY q.question_id, question""",
    "answer_synthesis": _RANK + _LISTED + r"""
, first3 AS (SELECT question_id, string_agg('- ' || preview, chr(10) ORDER BY place) AS c FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS k FROM full_ WHERE preview <> '') WHERE k <= 3 GROUP BY question_id)
SELECT q.question_id, CASE WHEN max(place) IS NULL THEN '# ' || question || chr(10) || 'No matching pages.' ELSE '# ' || question || chr(10) || '## Conclusion' || chr(10) || coalesce(max(c), '') || chr(10) || '## Evidence' || chr(10) ||
  string_agg('### [[' || doc_id || ']] ' || title, chr(10) ORDER BY place) || chr(10) || '## Cited' || chr(10) || string_agg('- [[' || doc_id || ']]', chr(10) ORDER BY place) END AS body
FROM q LEFT JOIN full_ f USING (question_id) LEFT JOIN first3 USING (question_id) WHERE question IS NOT NULL GROUP BY q.question_id, question""",
    "query_versions": f"""
WITH keyed AS (SELECT {S.query_slug('question')} AS slug, left(sha1(coalesce(summary, '')), 12) AS hash, note_id, mtime FROM vault_registry WHERE question IS NOT NULL),
f AS (SELECT slug, arg_max(hash, note_id) AS hash FROM keyed GROUP BY slug), l AS (SELECT slug, count(*) AS version, arg_max(hash, {{'m': mtime, 'n': note_id}}) AS hash FROM keyed WHERE mtime < TIMESTAMP '2024-07-01' GROUP BY slug)
SELECT f.slug, CAST(coalesce(version, 0) + CASE WHEN l.hash = f.hash THEN 0 ELSE 1 END AS INTEGER) AS version, CASE WHEN l.slug IS NULL THEN 'created' WHEN l.hash = f.hash THEN 'merged' ELSE 'versioned' END AS action FROM f LEFT JOIN l ON l.slug = f.slug""",
    "boundaries": f"WITH RECURSIVE {_BOUNDS} SELECT doc_id, line, type, title FROM bounds",
    "absorb_sections": f"WITH RECURSIVE {_BOUNDS} SELECT doc_id, line, type FROM fold WHERE kept",
    "split_chapters": f"WITH RECURSIVE {_BOUNDS} SELECT doc_id, seq, first_line, end_line, type, title, array_to_string(list_slice(l, first_line + 1, end_line), chr(10)) AS body FROM secs",
    "oversized_sections": f"WITH RECURSIVE {_BOUNDS} SELECT doc_id, seq, end_line - first_line AS n_lines FROM secs WHERE end_line - first_line > 15",
    "pattern_set_select": f"""
WITH lined AS (SELECT doc_id, list_slice({S.lines('text')}, 1, 100) AS l FROM documents WHERE text IS NOT NULL),
votes AS (SELECT doc_id, {', '.join(f"len(list_filter(l, lambda x: {_ANY[name]})) AS {name}" for name in split.PATTERN_SETS)} FROM lined)
SELECT doc_id, CASE WHEN greatest(academic, regulatory, technical) > 0 THEN CASE WHEN academic >= greatest(regulatory, technical) THEN 'academic' WHEN regulatory >= technical THEN 'regulatory' ELSE 'technical' END
       WHEN markdown > 0 THEN 'markdown' ELSE 'lines' END AS pattern_set FROM votes""",
    "boundaries_by_set": f"""
WITH raw AS (SELECT doc_id, {S.lines('text')} AS l FROM documents WHERE text IS NOT NULL), each AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line, unnest(l) AS x FROM raw)
{" UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern_set, line, {_TYPED[name]} AS type FROM each WHERE {_ANY[name]}" for name in split.PATTERN_SETS)}""",
    "patch_batches": _PATCH + "SELECT strftime(queued_at, '%Y-%m-%d') AS batch, count(*) AS n_patches, count(*) FILTER (errors <> '') AS n_invalid, count(*) FILTER (errors <> '') = 0 AS accepted FROM v GROUP BY 1",
    **{query: (_PLANTED if risk in PLANTED_RISKS else _LINES) + _DETECT[risk] for query, risk in LAYOUT.items()},
    "layout_documents": " UNION ALL ".join(f"SELECT candidate_id AS doc_id, '{risk}' AS risk_type, start_line, end_line FROM ({_lines('doc_id', 'text', 'documents')} {sql})" for risk, sql in _DETECT.items()),
    "page_hints": f"""
WITH l AS (SELECT candidate_id, list_filter(list_transform(list_slice(l, greatest(len(l) - 7, 1), len(l)), lambda x: {S.strip('x')}), lambda x: regexp_matches(x, '^(?:第\\s*)?\\d+(?:\\s*页)?$')) AS m FROM (SELECT candidate_id, {S.lines('source_excerpt')} AS l FROM layout_candidates WHERE source_excerpt IS NOT NULL))
SELECT candidate_id, m[-1] AS hint FROM l WHERE len(m) > 0""",
    "layout_top": "SELECT candidate_id, confidence FROM layout_candidates ORDER BY confidence DESC, chapter_path, start_line, candidate_id LIMIT 10",
    "patch_render": _PATCH + f""", f AS (SELECT * FROM v WHERE errors = '' AND (approved OR confidence >= 0.8)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY queued_at DESC, queue_pos DESC) AS k FROM f) WHERE k = 1),
x AS (SELECT m.*, {S.lines('c.source_excerpt')} AS l, {S.strip('payload.replacement', chr(92) + 'n')} AS rep, {S.strip('payload.content', chr(92) + 'n')} AS con, len(payload.header) AS n FROM m JOIN layout_candidates c USING (candidate_id))
SELECT queue_pos, CASE operation WHEN 'replace_block' THEN rep WHEN 'wrap_code_block' THEN '```' || coalesce(payload.code_language, 'text') || chr(10) || con || chr(10) || '```'
  WHEN 'replace_with_table' THEN array_to_string(list_concat(['| ' || array_to_string(payload.header, ' | ') || ' |', '| ' || array_to_string(list_transform(payload.header, lambda h: '---'), ' | ') || ' |'],
    list_transform(payload.cell_rows, lambda r: '| ' || array_to_string(list_transform(range(1, n + 1), lambda i: coalesce(r[i], '')), ' | ') || ' |')), chr(10))
  WHEN 'join_lines' THEN coalesce(rep, list_reduce(list_concat([''], list_filter(list_transform(l, lambda z: {S.strip('z')}), lambda z: z <> '')), lambda a, b, i: CASE WHEN i = 2 THEN b ELSE a || coalesce(payload.separator, ' ') || b END))
  ELSE array_to_string(list_filter(list_transform(l, lambda z: regexp_replace(z, '[{S.SPACE}]+$', '')), lambda z: {S.strip('z')} <> '' AND NOT coalesce(list_contains(list_transform(payload.noise_lines, lambda y: {S.strip('y')}), {S.strip('z')}), false)), chr(10)) END AS replacement FROM x""",
    "layout_dedupe": f"""
SELECT candidate_id FROM (SELECT candidate_id, row_number() OVER (PARTITION BY chapter_path, risk_type, array_to_string(list_filter(list_transform({S.stripped_lines('source_excerpt')}, lambda x: regexp_replace(x, '[{S.SPACE}]+', ' ', 'g')), lambda x: x <> ''), chr(10)) ORDER BY confidence DESC, start_line, candidate_id) AS k FROM layout_candidates) WHERE k = 1""",
    "layout_counts": "SELECT risk_type, chapter_path, count(*) AS n FROM layout_candidates GROUP BY GROUPING SETS ((risk_type), (chapter_path))",
    "patch_validate": _PATCH + "SELECT queue_pos, errors FROM v WHERE errors <> ''",
    "patch_approve": _PATCH + "SELECT queue_pos FROM v WHERE errors = '' AND (approved OR confidence >= 0.8)",
    "patch_merge": f"SELECT key, queue_pos FROM (SELECT {_KEY} AS key, queue_pos, row_number() OVER (PARTITION BY {_KEY} ORDER BY queued_at DESC, queue_pos DESC) AS k FROM patch_queue) WHERE k = 1",
}
