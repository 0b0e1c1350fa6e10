"""Chapters of Markdown texts: boundary lines, absorption of small sections, sections with their bodies.

A text's lines stay in its row: boundaries, the order-dependent fold and the sections are array expressions without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.session import spread

# Patterns of boundary lines in the order they are tried, with the type of what they begin.
PATTERNS = [
    (r"^#{1,2}\s+第.+部", "part"),
    (r"^#{1,2}\s+第.+章", "chapter"),
    (r"^#{1,2}\s+附表", "appendix"),
    (r"^#{1,2}\s+附錄", "appendix"),
    (r"^#{1,3}\s+Chapter\s+\d+", "chapter"),
    (r"^#{1,3}\s+Section\s+\d+", "section"),
    (r"^#{1,3}\s+[A-Z]{2,}-\d{3}", "code"),
    (r"^#\s+", "heading1"),
    (r"^##\s+", "heading2"),
    (r"^###\s+", "heading3"),
]
# Pattern sets that a text may be split by.
PATTERN_SETS = {
    "regulatory": [
        (r"^第[一二三四五六七八九十百零\d]+部[分]?\s", "part"),
        (r"^第[一二三四五六七八九十百零\d]+章\s", "chapter"),
        (r"^第[一二三四五六七八九十百零\d]+節\s", "section"),
        (r"^第[一二三四五六七八九十百零\d]+條", "article"),
        (r"^附表[一二三四五六七八九十\d]*", "appendix_table"),
        (r"^附錄[一二三四五六七八九十\d]*", "appendix_doc"),
        (r"^LD-[A-Z0-9]+-\d+", "ref_code_LD"),
        (r"^GL-[A-Z0-9]+-\d+", "ref_code_GL"),
    ],
    "technical": [
        (r"^Part\s+(\d+|[IVXLC]+)[.:\s]", "part"),
        (r"^Chapter\s+(\d+|[IVXLC]+)[.:\s]", "chapter"),
        (r"^Section\s+\d+(\.\d+)*[.:\s]", "section"),
        (r"^\d+(\.\d+)+\s+[A-Z]", "numbered"),
        (r"^Appendix\s+[A-Z\d]+[.:\s]", "appendix"),
        (r"^Annex\s+[A-Z\d]+[.:\s]", "annex"),
        (r"^Schedule\s+[A-Z\d]+[.:\s]", "schedule"),
    ],
    "academic": [
        (r"^(Abstract|摘要)[:\s]?", "abstract"),
        (r"^(\d+\.?\s+)?(Introduction|引言|前言|緒論)", "introduction"),
        (r"^(\d+\.?\s+)?(Literature Review|Related Work|文獻回顧)", "lit_review"),
        (r"^(\d+\.?\s+)?(Methodology|Methods|研究方法)", "methodology"),
        (r"^(\d+\.?\s+)?(Results|Findings|研究結果)", "results"),
        (r"^(\d+\.?\s+)?(Discussion|討論)", "discussion"),
        (r"^(\d+\.?\s+)?(Conclusion[s]?|結論)", "conclusion"),
        (r"^(References|Bibliography|參考文獻)", "references"),
        (r"^(Acknowledgments?|致謝)", "acknowledgments"),
    ],
    "markdown": [(r"^# (?!#)", "h1"), (r"^## (?!#)", "h2"), (r"^### (?!#)", "h3"), (r"^#### (?!#)", "h4"), (r"^(-{3,}|_{3,}|\*{3,})\s*$", "hr")],
}
#: Lines of a piece where no pattern set fits, and least and most characters of one.
FIXED_LINES, LEAST_CHARS, MOST_CHARS = 500, 200, 8000
MIN_LINES, MAX_LINES = 20, 5000


def kind(line: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """Type of the first pattern that a line matches."""
    out = F.when(line.rlike(patterns[0][0]), patterns[0][1])
    for regex, name in patterns[1:]:
        out = out.when(line.rlike(regex), name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: as the variable of a transform over one element."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def boundary_array(lines: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """(line from 0, type, title) of the boundary lines."""
    any_ = "|".join(f"(?:{regex})" for regex, _ in patterns)
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(any_), F.struct(i.alias("line"), kind(x, patterns).alias("type"), md.strip(F.regexp_replace(x, r"^#+\s*", "")).alias("title"))))
    return F.filter(marked, lambda b: b["type"].isNotNull())


def with_boundaries(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """key, boundaries of every text that isn't null."""
    rows = spread(texts.select(key, text)).filter(F.col(text).isNotNull())
    return rows.select(key, let(md.lines(F.col(text)), lambda lines: boundary_array(lines, patterns)).alias("boundaries"))


def boundaries(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    return with_boundaries(texts, key, text, patterns).select(key, F.explode("boundaries").alias("b")).select(key, "b.*")


def absorb(found: Column, min_lines: int = MIN_LINES) -> Column:
    """Boundaries at least min_lines after the last kept one; the anchor moves, so this is a fold."""
    first = F.slice(found, 1, 1)
    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), first, lambda kept, b: F.when(b["line"] - F.try_element_at(kept, F.lit(-1))["line"] >= min_lines, F.array_append(kept, b)).otherwise(kept))


def chapters(texts: DataFrame, key: str, text: str, min_lines: int = MIN_LINES, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """key, seq (two digits or more), first_line, end_line, type, title, body of each section; what stands before the first is the preamble.

    Texts without boundaries aren't split and have no rows.
    """
    before = F.struct(F.lit(0).alias("line"), F.lit("preamble").alias("type"), F.lit("preamble").alias("title"))

    def led(kept: Column) -> Column:
        return F.when(F.try_element_at(kept, F.lit(1))["line"] > 0, F.concat(F.array(before), kept)).otherwise(kept)

    def section(lines: Column, starts: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            end = F.coalesce(F.try_element_at(starts, i + 2)["line"], F.size(lines))
            seq = F.when(i < 99, F.lpad((i + 1).cast("string"), 2, "0")).otherwise((i + 1).cast("string"))
            body = F.array_join(F.slice(lines, b["line"] + 1, end - b["line"]), "\n")
            return F.struct(seq.alias("seq"), b["line"].alias("first_line"), end.alias("end_line"), b["type"].alias("type"), b["title"].alias("title"), body.alias("body"))

        return F.transform(starts, lambda b, i: one(b, i))

    cut = let(md.lines(F.col(text)), lambda lines: let(boundary_array(lines, patterns), lambda found: let(led(absorb(found, min_lines)), lambda starts: section(lines, starts))))
    rows = spread(texts.select(key, text)).filter(F.col(text).isNotNull())
    return rows.select(key, F.explode(cut).alias("s")).select(key, "s.*")


def chapter_pages(sections: DataFrame, key: str) -> DataFrame:
    """key, path (`NN-title.md`), content of each section from `chapters`: its body under front matter with title, type and place."""
    front = md.front_matter_text([("title", F.col("title")), ("type", F.col("type")), ("seq", F.col("seq")), ("first_line", F.col("first_line"))])
    return sections.select(key, F.concat("seq", F.lit("-"), md.file_name(F.col("title")), F.lit(".md")).alias("path"), F.concat(front, F.lit("\n\n"), "body", F.lit("\n")).alias("content"))


def chosen_set(lines: Column, n_lines: int = 100) -> Column:
    """Name of the pattern set with most matches in the first lines: special sets before Markdown's, ties by name; `lines` where none matches."""
    head = F.slice(lines, 1, n_lines)

    def hits(name: str) -> Column:
        any_ = "|".join(f"(?:{r})" for r, _ in PATTERN_SETS[name])
        return F.size(F.filter(head, lambda x: x.rlike(any_)))

    def votes(names: list[str]) -> Column:
        return F.array_min(F.array(*[F.struct((-hits(name)).alias("n"), F.lit(name).alias("name")) for name in sorted(names)]))

    special = votes([name for name in PATTERN_SETS if name != "markdown"])
    fallback = votes(["markdown"])
    return F.when(special["n"] < 0, special["name"]).when(fallback["n"] < 0, "markdown").otherwise("lines")


def pattern_set(texts: DataFrame, key: str, text: str, n_lines: int = 100) -> DataFrame:
    """key, pattern_set of every text that isn't null."""
    return spread(texts).filter(F.col(text).isNotNull()).select(key, let(md.lines(F.col(text)), lambda lines: chosen_set(lines, n_lines)).alias("pattern_set"))


def best_set(lines: list[str]) -> str:
    """As chosen_set, of a text's first lines."""
    hits = {name: sum(any(re.search(r, x) for r, _ in patterns) for x in lines) for name, patterns in PATTERN_SETS.items()}
    special = min((-n, name) for name, n in hits.items() if name != "markdown")
    return special[1] if special[0] else "markdown" if hits["markdown"] else "lines"


def fitted_pieces(text: str) -> list[tuple[str, int, int, int, str, int]]:
    """(pattern set, seq, first line, end line, type, characters) of each piece of a text."""
    lines = text.splitlines()
    name = best_set(lines[:100])
    begins = [0]
    for x in lines:
        begins.append(begins[-1] + len(x) + 1)

    def marks(name: str, first: int, end: int) -> list[tuple[int, str]]:
        if name == "lines":
            return [(k, "lines") for k in range(first, end, FIXED_LINES)]
        found = ((k, next((t for r, t in PATTERN_SETS[name] if re.search(r, lines[k])), None)) for k in range(first, end))
        return [(k, t) for k, t in found if t]

    def pieces(name: str, first: int, end: int, kind_: str) -> list[tuple[int, int, str]]:
        kept = [(first, kind_)]
        for k, t in marks(name, first, end):
            if k == first:
                kept[0] = (k, t)
            elif begins[k] - begins[kept[-1][0]] >= LEAST_CHARS:
                kept.append((k, t))
        return [(k, e, t) for (k, t), e in zip(kept, [*(k for k, _ in kept[1:]), end])]

    out = []
    for first, end, t in pieces(name, 0, len(lines), "preamble") if lines else ():
        weaker = name not in ("markdown", "lines") and begins[end] - begins[first] > MOST_CHARS
        out += pieces("markdown", first, end, t) if weaker else [(first, end, t)]
    return [(name, n, first, end, t, begins[end] - begins[first]) for n, (first, end, t) in enumerate(out, 1)]


def fitted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern_set, seq, first_line, end_line, type, n_chars of the pieces of every text, by the pattern set that fits it.

    A boundary counts if LEAST_CHARS or more characters lie between it and the last one kept; pieces above MOST_CHARS are cut at
    Markdown boundaries too, where another set was chosen. Texts that no set fits are cut every FIXED_LINES lines. Line ends count as
    one character. A null text or one without lines has no piece.
    """
    schema = "pattern_set string, seq int, first_line int, end_line int, type string, n_chars int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *piece) for k, t in zip(batch[key], batch[text]) for piece in fitted_pieces(t)]
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in schema.split(", ")]])

    rows = spread(texts.select(key, text)).filter(F.col(text).isNotNull())
    return rows.mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, {schema}")
