"""New contents of pages: injected links and summaries, front matter keys, distilled notes, reports, log entries.

All are (path or key, content) tables; `sources.vaultfiles.write_pages` puts them on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md

# A summary's callout; kinds of links that lead around a book, others are related pages.
OLD_CALLOUT = r"(?i)> \[!tldr\][^\n]*\n(?:>[^\n]*\n)*"
AROUND = {"previous": "Previous", "next": "Next", "parent": "Up"}


def front_block(text: Column) -> Column:
    """The front matter with its fences, empty where there is none."""
    return F.regexp_extract(text, md.FRONT, 0)


def with_links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """stem, content, n_added of pages (stem, content) after the links (src, dst, kind) they don't have yet.

    Each target is linked once, its first kind by name counting; links around the book stand in one section, related pages in another.
    A page without new links stays as it is.
    """
    once = edges.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("kind").alias("kind"))
    fresh = once.join(pages.select(F.col("stem").alias("src"), "content"), "src").filter(~F.contains("content", F.concat(F.lit("[["), "dst", F.lit("]]"))))
    label = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in AROUND.items()])
    line = F.when(label.isNotNull(), F.concat(F.lit("- "), label, F.lit(": [["), "dst", F.lit("]]"))).otherwise(F.concat(F.lit("- [["), "dst", F.lit("]]")))
    part = F.when(label.isNotNull(), "a").otherwise("b")
    listed = fresh.select("src", F.struct(part.alias("part"), line.alias("line")).alias("l")).groupBy("src").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    lines = lambda p: F.transform(F.filter("lines", lambda x: x["part"] == p), lambda x: x["line"])
    section = lambda p, name: F.when(F.size(lines(p)) > 0, F.concat(F.lit(f"\n\n## {name}\n\n"), F.array_join(lines(p), "\n"))).otherwise("")
    joined = pages.join(listed.withColumnRenamed("src", "stem"), "stem", "left")
    added = F.concat(F.col("content"), section("a", "Navigation"), section("b", "Related"))
    return joined.select("stem", F.when(F.col("lines").isNull(), F.col("content")).otherwise(added).alias("content"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_added"))


def with_summary(content: Column, summary: Column, mode: str = "callout") -> Column:
    """A page with its summary as a callout below the front matter in place of those it has, or as the last front matter field in place of one.

    An empty or null summary changes nothing, nor does a field for a page without front matter.
    """
    if mode == "callout":
        content = F.when(F.coalesce(md.strip(summary), F.lit("")) == "", content).otherwise(F.regexp_replace(content, OLD_CALLOUT, ""))
    front = front_block(content)
    rest = F.substr(content, F.length(front) + 1)
    none = F.coalesce(md.strip(summary), F.lit("")) == ""
    if mode == "callout":
        return F.when(none, content).otherwise(F.concat(front, F.lit("> [!tldr]\n> "), F.replace(summary, F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), rest))
    field = F.concat(F.lit('summary: "'), F.replace(F.replace(summary, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kept = F.regexp_replace(F.regexp_replace(F.regexp_extract(content, md.FRONT, 1), r"(?m)^summary:[^\r\n]*(?:\r?\n|\z)", ""), r"\s+\z", "")
    return F.when(none | (front == ""), content).otherwise(F.concat(F.lit("---\n"), kept, F.lit("\n"), field, F.lit("\n---\n"), rest))


def with_fields(content: Column, fields: list[tuple[str, Column]]) -> Column:
    """A page with further front matter fields; one without front matter stays as it is."""
    front = front_block(content)
    block = F.array_join(F.array(*[F.concat(F.lit(f'{name}: "'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"')) for name, c in fields]), "\n")
    inner = F.regexp_extract(content, md.FRONT, 1)
    return F.when(front == "", content).otherwise(F.concat(F.lit("---\n"), inner, F.lit("\n"), block, F.lit("\n---\n"), F.substr(content, F.length(front) + 1)))


def distilled_note(title: Column, owner: Column, source: Column, summary: Column, heads: Column) -> Column:
    """Content of a shared note made from one book's page."""
    front = md.front_matter_text([("type", F.lit("distilled-note")), ("title", title), ("book_slug", owner), ("source_page", source)])
    key = F.when(F.size(heads) > 0, F.concat(F.lit("\n\n## Key headings\n\n- "), F.array_join(heads, "\n- "))).otherwise("")
    return F.concat(front, F.lit("\n\n# "), title, F.lit("\n\n"), F.coalesce(summary, F.lit("")), key, F.lit("\n"))


def log_entry(stamp: Column, operation: Column, title: Column, details: Column) -> Column:
    """One entry for the append-only log."""
    return F.concat(F.lit("## ["), F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit("] "), operation, F.lit(" | "), title, F.when(F.size(details) > 0, F.concat(F.lit("\n- "), F.array_join(details, "\n- "))).otherwise(""), F.lit("\n"))


def report(counts: DataFrame, title: str) -> DataFrame:
    """One page of checks and their counts (check_name, n); there is a row for each check, so the page is short."""
    lines = F.array_sort(F.collect_list(F.struct("check_name", "n")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["check_name"], F.lit(": "), x["n"].cast("string"))), "\n")
    return counts.agg(F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n")).alias("content"))
