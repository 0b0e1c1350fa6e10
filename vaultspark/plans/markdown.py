"""Queries over Markdown texts: headings, links, front matter, summaries, slugs, tokens, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.functions import sql as S
from vaultspark.session import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).filter("text is not null")


def _column(**columns: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _texts(spark, d).select("doc_id", *[make().alias(name) for name, make in columns.items()])


T = lambda: F.col("text")


def _joined(c: Column) -> Column:
    return F.array_join(c, "\n")


def _front(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.explode(md.front_matter(T())).alias("field", "value"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(md.wikilinks(T())).alias("place", "target"))


def _token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select(F.explode(md.tokens(T())).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.left(F.sha1("text"), F.lit(12)).alias("short_hash"))


def _slugs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "vault_registry")
    return t.select("note_id", md.slug(F.col("title")).alias("slug"), md.query_slug(F.col("title")).alias("query_slug"), md.path_slug(F.col("path")).alias("path_slug"), md.stem(F.col("path")).alias("stem"), md.category(F.col("path")).alias("category"))


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    heads = F.coalesce("headings", F.array().cast("array<string>"))
    return spread(table(spark, d, "vault_registry").select("note_id", "title", "headings")).filter("title is not null").select("note_id", F.array_join(md.concept_candidates(F.col("title"), heads), "\n").alias("candidates"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Each text against its source; every seventh source is taken as ten times its text, every eleventh text as one of another encoding."""
    n_lines = F.size(md.lines(T()))
    checks = F.array_compact(
        F.array(
            F.when(n_lines == 0, "empty"),
            F.when(T().rlike("\ufffd{3,}"), "garbled"),
            F.when((n_lines < 3) & (F.col("size") > 10_000), "few_lines"),
            F.when(~F.is_valid_utf8(F.col("raw")), "other_encoding"),
        )
    )
    size = F.octet_length("text") * F.when(F.col("doc_id") % 7 == 0, 10).otherwise(1)
    raw = F.when(F.col("doc_id") % 11 == 0, F.concat(F.unhex(F.lit("E9")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    read = _texts(spark, d).withColumns({"size": size, "raw": raw.cast("string")})
    return read.select("doc_id", F.array_join(checks, ",").alias("warnings")).filter("warnings <> ''")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "headings_titles": _column(headings=lambda: _joined(md.headings(T())), title=lambda: md.title(T(), F.lit("untitled"))),
    "frontmatter_fields": _front,
    "note_body": _column(body=lambda: md.body(T())),
    "wikilinks": _links,
    "summary_text": _column(summary=lambda: md.summary(T())),
    "first_paragraph": _column(excerpt=lambda: md.first_paragraphs(T())),
    "slugs": _slugs,
    "tokens": _token_counts,
    "content_hash": _hashes,
    "concept_candidates": _concepts,
    "quality_check": _quality,
}

_FROM = "FROM documents WHERE text IS NOT NULL"
ORACLE: dict[str, str] = {
    "headings_titles": f"SELECT doc_id, array_to_string({S.headings('text')}, chr(10)) AS headings, {S.title('text', chr(39) + 'untitled' + chr(39))} AS title {_FROM}",
    "frontmatter_fields": f"""
SELECT doc_id, {S.strip("split_part(line, ':', 1)")} AS field, {S.strip(S.strip(S.strip("substr(line, instr(line, ':') + 1)"), '"'), "'")} AS value
FROM (SELECT doc_id, unnest({S.front_lines('text')}) AS line {_FROM})""",
    "note_body": f"SELECT doc_id, {S.body('text')} AS body {_FROM}",
    "wikilinks": f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS place, unnest(l) AS target FROM (SELECT doc_id, {S.wikilinks('text')} AS l {_FROM})",
    "summary_text": f"SELECT doc_id, {S.summary('text')} AS summary {_FROM}",
    "first_paragraph": f"SELECT doc_id, {S.first_paragraphs('text')} AS excerpt {_FROM}",
    "slugs": f"SELECT note_id, {S.slug('title')} AS slug, {S.query_slug('title')} AS query_slug, {S.path_slug('path')} AS path_slug, {S.stem('path')} AS stem, {S.category('path')} AS category FROM vault_registry",
    "tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS token {_FROM}) GROUP BY token",
    "content_hash": f"SELECT doc_id, sha256(text) AS sha256, left(sha1(text), 12) AS short_hash {_FROM}",
    "concept_candidates": f"SELECT note_id, array_to_string({S.concept_candidates('title', 'coalesce(headings, [])')}, chr(10)) AS candidates FROM vault_registry WHERE title IS NOT NULL",
    "quality_check": f"""
SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN len({S.lines('text')}) = 0 THEN 'empty' END, CASE WHEN regexp_matches(text, '\\x{{fffd}}{{3,}}') THEN 'garbled' END,
  CASE WHEN len({S.lines('text')}) < 3 AND strlen(text) * CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 1 END > 10000 THEN 'few_lines' END,
  CASE WHEN doc_id % 11 = 0 THEN 'other_encoding' END) AS warnings {_FROM}) WHERE warnings <> ''""",
}
