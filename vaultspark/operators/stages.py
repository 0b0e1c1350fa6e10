"""States of books, sources and conversions, tombstones, paged indexes and histories.

books: book_slug, book_title, source_file, source_path, stages, qa flags, root_notes. An index is given in pages of bounded length, as
one section may hold any number of notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators.ordered import grouped_position

PAGE_ENTRIES = 500


def paged(rows: DataFrame, group: str, order: list[str], item: Column, entries: int = PAGE_ENTRIES) -> DataFrame:
    """group, page, n, body: the items of each group in order, in pages of bounded length."""
    placed = grouped_position(rows.withColumn("_item", item).select(group, *order, "_item"), [group], order).withColumn("page", F.ceil(F.col("position") / entries).cast("int"))
    pages = placed.groupBy(group, "page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", "_item"))).alias("items"))
    return pages.select(group, "page", "n", F.array_join(F.transform("items", lambda x: x["_item"]), "\n").alias("body"))


def book_state() -> Column:
    """tombstoned, else review, else blocked, else ready; null flags count as unset."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.when(flag("tombstoned"), "tombstoned").when(flag("review_needed"), "review").when(flag("promotion_blocked"), "blocked").otherwise("ready")


def book_status(books: DataFrame) -> DataFrame:
    """state, n_books, n_candidates of each state that any book has."""
    return books.groupBy(book_state().alias("state")).agg(F.count("*").alias("n_books"), F.coalesce(F.sum("qa_candidate_count"), F.lit(0)).cast("bigint").alias("n_candidates"))


def base_status(raws: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: n_sources there, n_tracked (with a hash), n_dirty (tracked with another hash), n_notes, n_query_notes, n_indexes."""
    there = raws.filter("removed_at is null")
    own = there.agg(F.count("*").alias("n_sources"), F.count_if(F.col("source_hash").isNotNull()).alias("n_tracked"), F.count_if(F.col("source_hash") != F.col("raw_hash")).alias("n_dirty"))
    kept = notes.filter("removed_at is null").agg(F.count("*").alias("n_notes"), F.count_if(F.col("note_type") == "query-note").alias("n_query_notes"), F.count_if(F.col("note_type") == "index").alias("n_indexes"))
    both = own.unionByName(kept, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n_sources", "n_tracked", "n_dirty", "n_notes", "n_query_notes", "n_indexes")])


def split_tallies(books: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: n_books, n_ok (split and with sections), n_failed, n_sections."""
    cut = sections.groupBy("source_file").agg(F.count("*").alias("n"))
    each = books.select("book_slug", "source_file", F.coalesce("stages.split", F.lit(False)).alias("split")).join(cut, "source_file", "left")
    ok = F.col("split") & (F.coalesce("n", F.lit(0)) > 0)
    return each.agg(F.count("*").alias("n_books"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sections"))


def conversion_tallies(converted: DataFrame) -> DataFrame:
    """status, n of converted files (path, status), and whether the batch is ok: it is unless every file failed."""
    failed = F.col("status").isin("error", "empty")
    totals = converted.groupBy("status").agg(F.count("*").alias("n"))
    any_ok = converted.filter(~failed).limit(1).count() > 0 or not converted.limit(1).count()
    return totals.withColumn("batch_ok", F.lit(any_ok))


def tombstones(books: DataFrame, live: DataFrame) -> DataFrame:
    """book_slug, book_title, n_root_notes of books, not yet tombstoned, whose source (source_file) is no longer among the live ones."""
    named = books.filter("coalesce(source_file, '') <> '' and not coalesce(tombstoned, false)")
    gone = named.join(live.select("source_file").distinct(), "source_file", "left_anti")
    return gone.select("book_slug", F.coalesce("book_title", "book_slug").alias("book_title"), F.coalesce(F.size("root_notes"), F.lit(0)).alias("n_root_notes"))


def live_notes(books: DataFrame, existing: DataFrame) -> DataFrame:
    """section (first folder), path of the books' root notes that exist (path), each once."""
    named = books.select(F.explode("root_notes").alias("path")).filter("path is not null").distinct()
    return named.join(existing.select("path").distinct(), "path", "left_semi").select(md.category(F.col("path")).alias("section"), "path")


def section_index(books: DataFrame, existing: DataFrame) -> DataFrame:
    """section, page, n, body: the live notes of each section as links; a section without any has no index."""
    notes = live_notes(books, existing)
    return paged(notes, "section", ["path"], F.concat(F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("]]")))


def root_index(books: DataFrame, existing: DataFrame) -> DataFrame:
    """section, n_notes of every section with live notes."""
    return live_notes(books, existing).groupBy("section").agg(F.count("*").alias("n_notes"))


def query_versions(filed: DataFrame) -> DataFrame:
    """slug, version, note_id, content_hash of answers filed (slug, note_id, mtime, content_hash): versions count from 1 by time, then note_id."""
    return grouped_position(filed.select("slug", "mtime", "note_id", "content_hash"), ["slug"], ["mtime", "note_id"]).select("slug", F.col("position").alias("version"), "note_id", "content_hash")


def query_history(versions: DataFrame) -> DataFrame:
    """slug, page, n, body: the versions of each answer as links, the latest first."""
    item = F.concat(F.lit("- [["), "slug", F.lit("--v"), F.col("version").cast("string"), F.lit("|Version "), F.col("version").cast("string"), F.lit("]]"))
    return paged(versions.withColumn("_back", -F.col("version")), "slug", ["_back"], item)


def scanned_books(pages: DataFrame, book: str, order: list[str], text: str, first: int = 3, least: int = 30) -> DataFrame:
    """book, mean_chars of books whose first pages hold fewer than `least` characters on average: pictures of pages without a text."""
    placed = grouped_position(pages.select(book, *order, text).filter(F.col(book).isNotNull()), [book], order)
    mean = F.avg(F.length(md.strip(F.coalesce(text, F.lit("")))))
    return placed.filter(F.col("position") <= first).groupBy(book).agg(F.round(mean, 3).alias("mean_chars")).filter(F.col("mean_chars") < least)
