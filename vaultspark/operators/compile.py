"""Incremental ingest and compile: what changed, concept pages, progress of files and books, promotion plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators.ordered import grouped_position
from vaultspark.session import spread, stage_table


def ingest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (new, changed, unchanged, removed) between two snapshots (path, hash); null hashes count as changed."""
    b, a = before.groupBy("path").agg(F.max("hash").alias("old")), after.groupBy("path").agg(F.max("hash").alias("new"), F.lit(True).alias("there"))
    joined = b.withColumn("was", F.lit(True)).join(a, "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("there").isNull(), "removed").when(F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "unchanged").otherwise("changed")
    return joined.select("path", change.alias("change"))


def dirty(sources: DataFrame, tracked: DataFrame) -> DataFrame:
    """path of sources (path, hash) to compile: not tracked (path, hash, has_summary), other hash or no summary."""
    known = tracked.groupBy("path").agg(F.max("hash").alias("tracked_hash"), F.bool_or("has_summary").alias("has_summary"))
    clean = (F.col("hash") == F.col("tracked_hash")) & F.col("has_summary")
    return sources.join(known, "path", "left").filter(~F.coalesce(clean, F.lit(False))).select("path")


def concepts(notes: DataFrame) -> DataFrame:
    """key, title, n_aliases, n_sources of every concept, from the candidates of all titles and headings.

    The title is that of the least note_id; distinct aliases and sources are counted, not gathered, as one concept may be
    everywhere.
    """
    heads = F.coalesce("headings", F.array().cast("array<string>"))
    each = spread(notes.select("note_id", "title", "headings")).filter("title is not null").select("note_id", F.posexplode(md.concept_candidates(F.col("title"), heads)).alias("place", "candidate"))
    keyed = each.withColumn("key", md.slug(F.col("candidate")))
    return keyed.groupBy("key").agg(F.min_by("candidate", F.struct("note_id", "place")).alias("title"), F.count_distinct("candidate").alias("n_aliases"), F.count_distinct("note_id").alias("n_sources"))


def concept_sources(notes: DataFrame) -> DataFrame:
    """key, note_id: every concept with the notes it comes from."""
    heads = F.coalesce("headings", F.array().cast("array<string>"))
    return spread(notes.select("note_id", "title", "headings")).filter("title is not null").select(F.explode(md.concept_candidates(F.col("title"), heads)).alias("candidate"), "note_id").select(md.slug(F.col("candidate")).alias("key"), "note_id").distinct()


def summary_pages(sources: DataFrame) -> DataFrame:
    """path, content of a summary page for each source (path, text, hash)."""
    name = md.stem(F.col("path"))
    front = md.front_matter_text([("type", F.lit("summary")), ("title", md.title(F.col("text"), name)), ("source_path", F.col("path")), ("source_hash", F.col("hash"))])
    content = F.concat_ws("\n", front, F.lit(""), F.concat(F.lit("# "), md.title(F.col("text"), name)), F.lit(""), md.first_paragraphs(F.col("text")), F.lit(""))
    return spread(sources).filter("text is not null").select(F.concat(F.lit("wiki/summaries/"), md.path_slug(F.col("path")), F.lit(".md")).alias("path"), content.alias("content"))


def book_progress(books: DataFrame) -> DataFrame:
    """stage, n_books that reached it."""
    stages = [f.name for f in books.schema["stages"].dataType.fields]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(f"stages.{s}"), F.lit(False)).cast("int").alias("done")) for s in stages])).alias("s")
    return books.select(each).groupBy("s.stage").agg(F.sum("s.done").alias("n_books"))


def stale_targets(old: DataFrame, desired: DataFrame) -> DataFrame:
    """Targets (book_slug, target) of old that are no longer desired."""
    return old.distinct().join(desired.distinct(), ["book_slug", "target"], "left_anti")


def promotion_targets(notes: DataFrame) -> DataFrame:
    """note_id, target_path, place: where each summary note goes in the shared tier; of equal targets all but the least note_id take its stem as suffix."""
    target = F.concat(F.lit("distilled/"), F.coalesce(F.nullif(md.slug(F.coalesce("category", F.lit("notes"))), F.lit("")), F.lit("notes")), F.lit("/"), md.file_name(F.coalesce("title", F.lit("untitled"))))
    each = notes.filter("note_type = 'summary'").select("note_id", md.stem(F.col("path")).alias("stem"), target.alias("target"))
    first = each.groupBy("target").agg(F.min("note_id").alias("first_id"))
    path = F.when(F.col("note_id") == F.col("first_id"), F.col("target")).otherwise(F.concat("target", F.lit("-"), "stem"))
    return each.join(first, "target").select("note_id", F.concat(path, F.lit(".md")).alias("target_path"))


def promotion_plan(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """target, action of each proposal (target, owner, content) against existing pages (target, owner, content): write, identical, update, or conflict with another owner's page."""
    page = existing.groupBy("target").agg(F.max(F.struct("owner", "content")).alias("e"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "write").when(~F.coalesce(F.col("e.owner") == F.col("owner"), F.lit(False)), "conflict").when(F.col("e.content") == F.col("content"), "identical").otherwise("update")
    return proposals.join(page, "target", "left").select("target", "owner", action.alias("action"))


def inside_root(path):  # noqa: ANN001, ANN201
    """Whether a relative path stays under its root: no leading /, never more `..` than folders before them."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda s, p: F.struct((s["depth"] + F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)).alias("depth"), F.least(s["least"], s["depth"] + F.when(p == "..", -1).otherwise(0)).alias("least")),
    )
    return ~F.startswith(path, F.lit("/")) & (depth["least"] >= 0)


def log_entries(lines: DataFrame) -> DataFrame:
    """seq, stamp, operation, title, n_lines of each entry of logs (log, line_no, text): `## [stamp] operation | title` begins one.

    A header of another shape has an empty stamp and operation. An entry's lines are found from the place of the next header, so
    only headers are ordered.
    """
    head = r"^## \[(.+?)\] ([^|]+)\| (.+)$"
    ends = lines.groupBy("log").agg(F.max("line_no").alias("last_no"))
    heads = stage_table(grouped_position(lines.filter("startswith(text, '## [')").select("log", "line_no", "text"), ["log"], ["line_no"])).withColumnRenamed("position", "seq")
    following = heads.select("log", (F.col("seq") - 1).alias("seq"), F.col("line_no").alias("next_no"))
    placed = heads.join(following, ["log", "seq"], "left").join(ends, "log")
    well = F.col("text").rlike(head)
    part = lambda k: F.when(well, md.strip(F.regexp_extract("text", head, k))).otherwise("")
    title = F.when(well, part(3)).otherwise(md.strip(F.substr(F.col("text"), F.lit(4))))
    return placed.select("log", "seq", part(1).alias("stamp"), part(2).alias("operation"), title.alias("title"), (F.coalesce("next_no", F.col("last_no") + 1) - F.col("line_no") - 1).cast("int").alias("n_lines"))
