"""What a changed source asks to be looked at: its summary page, candidate concepts, evidence, and the pages to review.

sources: source_path, text. pages: path, text. Pages to review are rows, not lists, as one term may stand in any number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators.search import occurrences
from vaultspark.session import stage_table

#: Why a page is to be reviewed; the first reason counts.
REASONS = ["category", "concept", "term", "recent"]
HEADINGS = 4


def summary_page(path: Column, folder: str = "wiki/summary") -> Column:
    """Page of a source's summary, in the folder of its category."""
    inner = F.regexp_replace(path, "^raw/sources/", "")
    return F.concat(F.lit(f"{folder}/"), md.category(inner), F.lit("/"), md.path_slug(md.stem(path)), F.lit(".md"))


def described(sources: DataFrame) -> DataFrame:
    """source_path, title, headings (all of which the candidates need), category, summary_page of every source with a text."""
    rows = sources.filter("text is not null and source_path is not null")
    return rows.select(
        "source_path", "text", md.title(F.col("text"), md.stem(F.col("source_path"))).alias("title"), md.headings(F.col("text")).alias("headings"),
        md.category(F.regexp_replace("source_path", "^raw/sources/", "")).alias("category"), summary_page(F.col("source_path")).alias("summary_page"),
    )


def entries(sources: DataFrame) -> DataFrame:
    """source_path, summary_page, concept_pages (candidates' pages), evidence (title, excerpt and first headings, one a line)."""
    rows = described(sources)
    pages = F.transform(md.concept_candidates(F.col("title"), F.col("headings")), lambda c: F.concat(F.lit("wiki/concept/"), md.slug(c), F.lit(".md")))
    excerpt = F.left(md.first_paragraphs(F.col("text")), F.lit(280))
    evidence = F.concat(F.array(F.concat(F.lit("title: "), "title"), F.concat(F.lit("excerpt: "), F.when(excerpt == "", "none").otherwise(excerpt))), F.transform(F.slice("headings", 1, HEADINGS), lambda h: F.concat(F.lit("heading: "), h)))
    return rows.select("source_path", "summary_page", F.array_distinct(pages).alias("concept_pages"), F.array_join(evidence, "\n").alias("evidence"))


def terms(sources: DataFrame) -> DataFrame:
    """source_path, word: a source's title and first headings in lower case."""
    all_ = F.concat(F.array("title"), F.slice("headings", 1, HEADINGS))
    return described(sources).select("source_path", F.explode(F.array_distinct(F.transform(all_, F.lower))).alias("word")).filter("word <> ''")


def pages_to_review(sources: DataFrame, pages: DataFrame, recent: list[str] | None = None, folder: str = "wiki/summary") -> DataFrame:
    """source_path, page, reason: pages of the same category, of its concepts, that hold one of its terms in text or name, or were asked for lately.

    Each page once, by the first reason; never the source's own summary page, nor the index unless it was asked for lately.
    """
    asked = stage_table(described(sources).select("source_path", "category", "summary_page", "title", "headings"))
    known = pages.filter("path is not null").select(F.col("path").alias("page"), "text")
    in_folder = known.filter(F.startswith("page", F.lit(f"{folder}/"))).select("page", F.split_part("page", F.lit("/"), F.lit(folder.count("/") + 2)).alias("category"))
    by_category = asked.join(in_folder, "category").filter("page <> summary_page").select("source_path", "page", F.lit(0).alias("rank"))
    candidates = asked.select("source_path", F.explode(F.array_distinct(F.transform(md.concept_candidates(F.col("title"), F.col("headings")), lambda c: F.concat(F.lit("wiki/concept/"), md.slug(c), F.lit(".md"))))).alias("page"))
    by_concept = candidates.join(known.select("page").distinct(), "page", "left_semi").select("source_path", "page", F.lit(1).alias("rank"))
    wanted = stage_table(terms(sources))
    both = known.select("page", F.lower(F.concat_ws("\n", F.coalesce("text", F.lit("")), md.stem(F.col("page")))).alias("held"))
    met = occurrences(both, "page", "held", wanted.select("word")).filter("page <> 'wiki/index.md'")
    by_term = wanted.join(met, "word").join(asked.select("source_path", "summary_page"), "source_path").filter("page <> summary_page").select("source_path", "page", F.lit(2).alias("rank"))
    out = by_category.unionByName(by_concept).unionByName(by_term)
    if recent:
        out = out.unionByName(asked.select("source_path", F.explode(F.array(*map(F.lit, recent))).alias("page"), F.lit(3).alias("rank")))
    first = out.groupBy("source_path", "page").agg(F.min("rank").alias("rank"))
    return first.select("source_path", "page", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank") + 1).alias("reason"))


def pages_of(sources: DataFrame, pages: DataFrame, recent: list[str] | None = None) -> DataFrame:
    """page: every page that a workset names, each once."""
    own = entries(sources).select(F.explode(F.array_union(F.array("summary_page"), F.col("concept_pages"))).alias("page"))
    return own.union(pages_to_review(sources, pages, recent).select("page")).distinct()
