"""The vault's notes as a graph: links, registry, integrity and maintenance checks.

notes: note_id, path, title, note_type, concept_key, source_file, category, parent, status, source_path, page_sources,
outbound_links, headings, summary, mtime, removed_at. Stems are the last part of a path without its extension.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators.ordered import grouped_position, neighbours
from vaultspark.operators.search import BLOCK, automaton, occurrences
from vaultspark.session import stage_table

#: Entries of one page of a category index.
PAGE_ENTRIES = 500
# How texts refer to other pages by name.
XREF = [r"[見见参參](?:照|閱|阅)?[《「](.+?)[》」]", r"(?:根[據据]|依照|按照)第\s*(\S+?)[條条部章節节]", r"[見见]第\s*(\S+?)[條条部章節节]", r"(?i)(?:see|refer to|as per)\s+((?:Chapter|Section|Part)\s+\S+)"]


def with_stem(notes: DataFrame) -> DataFrame:
    return notes.withColumn("stem", md.stem(F.col("path")))


def one_per_stem(notes: DataFrame) -> DataFrame:
    """stem, path, note_id of the note with the greatest path for each stem, the least note_id among equal ones."""
    best = F.max(F.struct("path", (-F.col("note_id")).alias("n")))
    return with_stem(notes).groupBy("stem").agg(best.alias("b")).select("stem", F.col("b.path").alias("path"), (-F.col("b.n")).alias("note_id"))


def link_occurrences(notes: DataFrame) -> DataFrame:
    """note_id, target of every entry of outbound_links that isn't null, repeated ones too; target is the name after the last /."""
    entry = notes.select("note_id", F.explode("outbound_links").alias("link")).filter("link is not null")
    return entry.select("note_id", md.strip(F.substring_index(md.link_target(F.col("link")), "/", -1)).alias("target"))


def inbound(notes: DataFrame) -> DataFrame:
    """stem, n_links (occurrences), n_sources (distinct notes) of every stem, 0 where nothing links to it."""
    counted = link_occurrences(notes).groupBy("target").agg(F.count("*").alias("n_links"), F.count_distinct("note_id").alias("n_sources"))
    stems = with_stem(notes).select("stem").distinct()
    zero = F.lit(0).cast("bigint")
    return stems.join(counted, F.col("stem") == F.col("target"), "left").select("stem", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_sources", zero).alias("n_sources"))


def broken_links(notes: DataFrame) -> DataFrame:
    """note_id, target, n of links that name no note's stem."""
    stems = with_stem(notes).select(F.col("stem").alias("target")).distinct()
    return link_occurrences(notes).groupBy("note_id", "target").agg(F.count("*").alias("n")).join(stems, "target", "left_anti").select("note_id", "target", "n")


def orphan_notes(notes: DataFrame) -> DataFrame:
    """note_id, path of notes, indexes apart, that no page links to and that link to none."""
    linked = link_occurrences(notes).select(F.col("target").alias("stem")).distinct()
    alone = F.size(F.array_compact(F.coalesce("outbound_links", F.array().cast("array<string>")))) == 0
    return with_stem(notes.filter(alone & (F.coalesce("note_type", F.lit("")) != "index"))).join(linked, "stem", "left_anti").select("note_id", "path")


def weak_notes(notes: DataFrame, least: int = 2) -> DataFrame:
    """note_id, degree of notes, indexes apart, with fewer than `least` links in (distinct sources) and out (occurrences) together."""
    out = link_occurrences(notes).groupBy("note_id").agg(F.count("*").alias("n_out"))
    own = with_stem(notes.filter("coalesce(note_type, '') <> 'index'")).select("note_id", "stem")
    degree = F.coalesce("n_out", F.lit(0)) + F.coalesce("n_sources", F.lit(0))
    return own.join(inbound(notes).select("stem", "n_sources"), "stem", "left").join(out, "note_id", "left").select("note_id", degree.alias("degree")).filter(F.col("degree") < least)


def sibling_links(sections: DataFrame) -> DataFrame:
    """source_file, stem, previous, following by order of stems within a source_file; rows without either name are left out."""
    rows = sections.filter("source_file is not null and stem is not null").select("source_file", "stem").distinct()
    return neighbours(rows, "source_file", "stem").filter("previous is not null or following is not null")


def category_index(notes: DataFrame, entries: int = PAGE_ENTRIES) -> DataFrame:
    """category, page, n, body: the notes of each category with two or more, as list items by stem, in pages of bounded length."""
    rows = with_stem(notes).filter("coalesce(category, '') <> ''").select("category", "stem", "note_id")
    placed = grouped_position(rows, ["category"], ["stem", "note_id"]).withColumn("page", F.ceil(F.col("position") / entries).cast("int"))
    several = rows.groupBy("category").agg(F.count("*").alias("c")).filter("c >= 2").select("category")
    items = F.array_sort(F.collect_list(F.struct("position", "stem")))
    pages = placed.join(several, "category").groupBy("category", "page").agg(F.count("*").alias("n"), items.alias("items"))
    return pages.select("category", "page", "n", F.array_join(F.transform("items", lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]]"))), "\n").alias("body"))


def title_mentions(texts: DataFrame, key: str, text: str, titles: DataFrame, own: str | None = None, block: int = BLOCK) -> DataFrame:
    """key, title: titles (title) of three or more characters that occur in a text which doesn't link to them.

    own is the column with the text's own title, which counts for no mention. The titles are matched by one automaton over each
    text, in blocks of a fixed number of titles, so neither side is paired with the other. An empty table of titles gives no rows.
    """
    wanted = titles.filter("length(title) >= 3").select(F.col("title").alias("word"))
    return occurrences(texts, key, text, wanted, block, own, unlinked=True).withColumnRenamed("word", "title")


def cross_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, reference: what a text refers to by name, each once."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in XREF]))
    return texts.filter(F.col(text).isNotNull()).select(key, F.explode(found).alias("reference")).select(key, md.strip(F.col("reference")).alias("reference"))


def reference_links(texts: DataFrame, key: str, text: str, own: str, titles: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, target: the pages that a text refers to by name, each once; own is the column with the text's own title.

    A reference means the smallest title (title), other than the text's own, that it contains or that contains it. Both ways are
    searched by an automaton over blocks of fixed size; as a text has one title of its own, a reference's two smallest are enough.
    """
    found = stage_table(cross_references(texts, key, text).filter("reference <> ''"))
    references = stage_table(found.select(F.col("reference").alias("x")).distinct())
    named = stage_table(titles.filter("title <> ''").select(F.col("title").alias("x")).distinct())
    matched = _contained(named, references, block).select(F.col("outer").alias("reference"), F.col("inner").alias("title"))
    matched = matched.unionByName(_contained(references, named, block, of_inner=True).select(F.col("inner").alias("reference"), F.col("outer").alias("title")))
    first = matched.groupBy("reference").agg(F.min("title").alias("first"))
    second = matched.join(first, "reference").filter("title > first").groupBy("reference").agg(F.min("title").alias("second"))
    pages = texts.filter(F.col(text).isNotNull()).select(key, F.col(own).alias("own")).distinct()
    target = F.when(F.col("first").eqNullSafe(F.col("own")), F.col("second")).otherwise(F.col("first"))
    linked = found.join(first.join(second, "reference", "left"), "reference").join(pages, key)
    return linked.select(key, target.alias("target")).filter("target is not null").distinct()


def _contained(inner: DataFrame, outer: DataFrame, block: int, of_inner: bool = False) -> DataFrame:
    """inner, outer: texts (x) of inner that occur in one of outer; for each of outer (with of_inner, of inner) a batch's two least partners."""
    schema = "inner string, outer string"
    n_blocks = -(-inner.count() // block)
    out = inner.sparkSession.createDataFrame([], schema)
    for b in range(n_blocks):
        part = [r.x for r in inner.filter(F.pmod(F.xxhash64("x"), F.lit(n_blocks)) == b).collect()]

        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], part: list[str] = part, name: str = name) -> Iterator[pd.DataFrame]:
            own = automaton(name, part)
            for batch in batches:
                least: dict[str, list[str]] = {}
                for x in batch["x"] if part else ():
                    for t in {t for _, t in own.iter(x)}:
                        a, b = (t, x) if of_inner else (x, t)
                        held = least.setdefault(a, [])
                        if len(held) < 2 or b < held[-1]:
                            held[:] = sorted([*held, b])[:2]
                rows = [(a, b) if of_inner else (b, a) for a, bs in least.items() for b in bs]
                yield pd.DataFrame(rows, columns=["inner", "outer"])

        out = out.unionByName(outer.mapInPandas(run, schema))
    return out


def registry_notes(notes: DataFrame) -> DataFrame:
    """The registry's row of each note, with its links counted anew."""
    counted = inbound(notes)
    return with_stem(notes).join(counted, "stem").select("note_id", "path", F.coalesce("title", "stem").alias("title"), F.coalesce("note_type", F.lit("")).alias("note_type"), F.coalesce(F.size("headings"), F.lit(0)).alias("n_headings"), F.coalesce(F.size("outbound_links"), F.lit(0)).alias("n_outbound"), "n_links", "n_sources")


def page_sources(notes: DataFrame) -> DataFrame:
    """source, path: distinct pages of each source, from page_sources and source_path."""
    entry = F.explode(F.array_union(F.coalesce("page_sources", F.array().cast("array<string>")), F.array("source_path"))).alias("source")
    return notes.select(entry, "path").filter("source is not null and source <> ''").distinct()


def registry_stats(notes: DataFrame) -> DataFrame:
    """One row: n_notes, n_links, n_categories, n_sources."""
    links = F.coalesce(F.sum(F.size("outbound_links")), F.lit(0)).alias("n_links")
    own = notes.agg(F.count("*").alias("n_notes"), links, F.count_distinct(F.nullif("category", F.lit(""))).alias("n_categories"))
    sources = page_sources(notes).agg(F.count_distinct("source").alias("n_sources"))
    both = own.unionByName(sources, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n_notes", "n_links", "n_categories", "n_sources")])


def missing_metadata(notes: DataFrame, text: str, fields: tuple[str, ...] = ("type",)) -> DataFrame:
    """note_id, missing of notes whose front matter lines (text) lack a field; one that is there but empty is no case."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: md.strip(F.substring_index(x, ":", 1)))
    missing = F.filter(F.array(*map(F.lit, fields)), lambda f: ~F.array_contains(names, f))
    return notes.select("note_id", F.array_join(missing, ",").alias("missing")).filter("missing <> ''")


def duplicate_concepts(notes: DataFrame) -> DataFrame:
    """concept, n, first_id of concept keys that several notes have, regardless of case."""
    keyed = notes.filter("note_type = 'concept' and coalesce(concept_key, '') <> ''")
    return keyed.groupBy(F.lower("concept_key").alias("concept")).agg(F.count("*").alias("n"), F.min("note_id").alias("first_id")).filter("n > 1")


def uncovered_sources(raws: DataFrame, notes: DataFrame) -> DataFrame:
    """path of raw sources that no note has as its source_path."""
    named = notes.select(F.col("source_path").alias("path")).filter("path is not null").distinct()
    return raws.filter("removed_at is null and path is not null").select("path").distinct().join(named, "path", "left_anti")


def sources_without_pages(raws: DataFrame, notes: DataFrame) -> DataFrame:
    """path of raw sources from which no page was made: none names them among its page_sources."""
    made = notes.select(F.explode("page_sources").alias("path")).filter("path is not null").distinct()
    return raws.filter("removed_at is null and path is not null").select("path").distinct().join(made, "path", "left_anti")


def stale_summaries(pages: DataFrame, tracked: DataFrame) -> DataFrame:
    """page_id, path of pages (page_id, path, source_path, source_hash) whose hash isn't the tracked one of their source (source_path, hash).

    A source without a hash, or one that isn't there, makes nothing stale; a null source_hash differs from every other.
    """
    now = tracked.filter("coalesce(hash, '') <> ''").groupBy("source_path").agg(F.max("hash").alias("hash"))
    return pages.join(now, "source_path").filter(~F.coalesce(F.col("source_hash") == F.col("hash"), F.lit(False))).select("page_id", "path")


def stale_indexes(notes: DataFrame) -> DataFrame:
    """note_id, path of index notes older than the newest note of all."""
    newest = notes.agg(F.max("mtime")).first()[0]  # one value
    return notes.filter(F.col("note_type") == "index").filter(F.col("mtime") < F.lit(newest)).select("note_id", "path")


def missing_concepts(notes: DataFrame) -> DataFrame:
    """heading, n of headings that several notes have and no concept's stem is named after."""
    heads = notes.select(F.explode(F.array_distinct("headings")).alias("heading")).groupBy(F.replace(F.lower("heading"), F.lit(" "), F.lit("-")).alias("heading")).agg(F.count("*").alias("n")).filter("n >= 2")
    stems = with_stem(notes.filter("note_type = 'concept'")).select(F.col("stem").alias("heading")).distinct()
    return heads.join(stems, "heading", "left_anti")


def concept_conflicts(concepts: DataFrame) -> DataFrame:
    """conflict_group, n_sources, key: concept pages (key, n_sources) made from several sources, grouped by how many, one row a page."""
    group = F.concat(F.lit("concept-pages-with-"), F.col("n_sources").cast("string"), F.lit("-sources"))
    return concepts.filter("n_sources >= 2").select(group.alias("conflict_group"), "n_sources", "key")


def conflicting_sources(raws: DataFrame) -> DataFrame:
    """raw_id, path of raw sources whose own hash differs from the tracked one."""
    return raws.filter("source_hash is not null and raw_hash <> source_hash").select("raw_id", "path")


def cold_notes(notes: DataFrame, before: str, limit: int | None = None) -> DataFrame:
    """Notes, indexes apart, not written since `before` and without links from later notes; with a limit a report's first by path."""
    recent = link_occurrences(notes.filter(F.col("mtime") >= F.lit(before).cast("timestamp_ntz"))).select(F.col("target").alias("stem")).distinct()
    old = with_stem(notes.filter((F.col("mtime") < F.lit(before).cast("timestamp_ntz")) & (F.coalesce("note_type", F.lit("")) != "index")))
    cold = old.join(recent, "stem", "left_anti").select("path", "note_id")
    return cold if limit is None else cold.orderBy("path", "note_id").limit(limit)


def contract_violations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, violation, n: unbalanced wikilinks, and Markdown links to .md pages, one for each occurrence."""
    t = F.col(text)
    links = F.size(F.filter(F.regexp_extract_all(t, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1)), lambda x: F.endswith(x, F.lit(".md")) & ~F.contains(x, F.lit("://"))))
    unbalanced = (F.size(F.split(t, r"\[\[", -1)) != F.size(F.split(t, r"\]\]", -1))).cast("int")
    each = F.explode(F.array(F.struct(F.lit("unbalanced_wikilink").alias("violation"), unbalanced.alias("n")), F.struct(F.lit("markdown_link").alias("violation"), links.alias("n")))).alias("v")
    return texts.filter(t.isNotNull()).select(key, each).select(key, "v.*").filter("n > 0")


# Fields that a version of an answer must have.
VERSION_FIELDS = ["question", "sources", "derived_from_query_output", "version", "version_group"]


def query_page_violations(pages: DataFrame, folder: str = "queries") -> DataFrame:
    """note_id, violation, missing of pages of answers (note_id, path, frontmatter) that break their contract.

    A version (`--v` in its name) must be a query-note with all VERSION_FIELDS, any other page an index of kind query-history.
    """
    fields = F.transform(F.split(F.coalesce("frontmatter", F.lit("")), "\n"), lambda x: md.strip(x))
    names = F.transform(fields, lambda x: md.strip(F.substring_index(x, ":", 1)))
    value = lambda name: F.coalesce(md.strip(md.strip(F.substring_index(F.try_element_at(F.filter(fields, lambda x: F.startswith(x, F.lit(f"{name}:"))), F.lit(-1)), ":", -1)), '"'), F.lit(""))
    missing = F.filter(F.array(*map(F.lit, VERSION_FIELDS)), lambda f: ~F.array_contains(names, f))
    version = F.contains(F.substring_index("path", "/", -1), F.lit("--v"))
    broken = F.when(version & ((value("type") != "query-note") | (F.size(missing) > 0)), "version").when(~version & ((value("type") != "index") | (value("index_kind") != "query-history")), "history")
    return pages.filter(F.startswith("path", F.lit(f"{folder}/"))).select("note_id", broken.alias("violation"), F.when(version, F.array_join(missing, ",")).otherwise("").alias("missing")).filter("violation is not null")


def homepage_item() -> Column:
    """A note's line of the homepage: its path as a link, with the beginning of its summary."""
    return F.concat(F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("]]"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), F.left("summary", F.lit(180)))).otherwise(""))


def homepage(notes: DataFrame, entries: int = PAGE_ENTRIES) -> DataFrame:
    """section (first folder), page, n, body: all notes by path as list items with the beginning of their summaries, in pages of bounded length."""
    rows = notes.filter("path is not null").select(md.category(F.col("path")).alias("section"), "path", "note_id", homepage_item().alias("item"))
    placed = grouped_position(rows, ["section"], ["path", "note_id"]).withColumn("page", F.ceil(F.col("position") / entries).cast("int"))
    pages = placed.groupBy("section", "page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", "item"))).alias("items"))
    return pages.select("section", "page", "n", F.array_join(F.transform("items", lambda x: x["item"]), "\n").alias("body"))


def children(notes: DataFrame) -> DataFrame:
    """parent, n_children of every parent that notes name."""
    return notes.filter("coalesce(parent, '') <> ''").groupBy("parent").agg(F.count("*").alias("n_children"))


def expanded_aliases(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, token, term: each token of a question (question_id, question) with the terms that mean the same.

    aliases: topic, alias. A token that is an alias, regardless of case, brings the topic's other aliases; any brings itself.
    """
    tokens = questions.select("question_id", F.explode(F.array_distinct(md.tokens(F.col("question")))).alias("token"))
    known = aliases.select(F.lower("alias").alias("token"), "topic").distinct()
    others = aliases.select("topic", F.lower("alias").alias("term")).distinct()
    return tokens.join(known, "token").join(others, "topic").select("question_id", "token", "term").union(tokens.select("question_id", "token", F.col("token").alias("term"))).distinct()
