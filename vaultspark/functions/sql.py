"""The same text rules as DuckDB expressions, for the SQL that queries are held against."""

from __future__ import annotations

from vaultspark.functions.md import FENCED, FRONT, LINE_END, SPACE, STOPWORDS, UNSAFE


def strip(x: str, characters: str = SPACE) -> str:
    quoted = characters.replace("'", "''")
    return f"regexp_replace({x}, '^[{quoted}]+|[{quoted}]+$', '', 'g')"


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{LINE_END}')"
    return f"(CASE WHEN {x} = '' THEN [] WHEN list_extract({parts}, -1) = '' THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END)"


def stripped_lines(x: str) -> str:
    return f"list_transform({lines(x)}, lambda x: {strip('x')})"


def headings(x: str, limit: int = 10) -> str:
    marked = f"list_filter({stripped_lines(x)}, lambda x: starts_with(x, '#'))"
    clean = "regexp_replace(x, '^#+', '')"
    return f"list_slice(list_filter(list_transform({marked}, lambda x: {strip(clean)}), lambda x: x <> ''), 1, {limit})"


def title(x: str, fallback: str) -> str:
    first = f"list_extract(list_filter({stripped_lines(x)}, lambda x: starts_with(x, '#')), 1)"
    return f"coalesce(nullif({strip(f'regexp_replace({first}, $$^#+$$, $$$$)')}, ''), {fallback})"


def front_lines(x: str) -> str:
    return f"list_filter({lines(f'regexp_extract({x}, $${FRONT}$$, 1)')}, lambda x: contains(x, ':'))"


def body(x: str) -> str:
    return strip(f"regexp_replace({x}, '{FRONT}', '')")


def wikilinks(x: str) -> str:
    inner = strip("split_part(split_part(x, '|', 1), '#', 1)")
    return f"list_transform(regexp_extract_all({x}, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: {inner})"


def prose(x: str, skip: str) -> str:
    unfenced = f"regexp_replace({x}, '{FENCED}', '', 'g')"
    return f"list_filter({stripped_lines(unfenced)}, lambda x: NOT regexp_matches(x, '^(?:{skip})') AND x <> '')"


def summary(x: str, n: int = 240) -> str:
    plain = f"list_transform({prose(x, r'#|---|\||> \[!')}, lambda x: {strip('regexp_replace(x, $$^[> ]+$$, $$$$)')})"
    return strip(f"left(array_to_string(list_filter({plain}, lambda x: x <> ''), ' '), {n})")


def first_paragraphs(x: str, n: int = 700) -> str:
    return strip(f"left(array_to_string({prose(x, r'#|\|')}, ' '), {n})")


def slug(x: str) -> str:
    kept = f"regexp_replace({strip(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_{SPACE}\\-/]+', '', 'g')"
    out = strip(f"regexp_replace(regexp_replace({kept}, '[{SPACE}/]+', '-', 'g'), '-{{2,}}', '-', 'g')", r"\-")
    return f"coalesce(nullif({out}, ''), 'untitled')"


def query_slug(x: str) -> str:
    out = strip(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g')", r"\-")
    return f"coalesce(nullif({out}, ''), 'query')"


def path_slug(x: str) -> str:
    kept = f"replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_.\\-/]+', '-', 'g'), '/', '__')"
    out = strip(f"regexp_replace({kept}, '[-_]{{3,}}', '__', 'g')", r"\-_")
    return f"coalesce(nullif({out}, ''), 'untitled')"


def file_name(x: str) -> str:
    safe = strip(f"regexp_replace({x}, '{UNSAFE}', '_', 'g')")
    return f"coalesce(nullif(regexp_replace(regexp_replace({safe}, '[{SPACE}]+', '-', 'g'), '[-_]{{2,}}', '-', 'g'), ''), 'untitled')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2)"


def stem(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^.*/', ''), '\\.[^.]*$', '')"


def category(x: str) -> str:
    return f"CASE WHEN contains({x}, '/') THEN split_part({x}, '/', 1) ELSE 'uncategorized' END"


def concept_candidates(name: str, heads: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    both = f"array_to_string(list_concat([{name}], {heads}), ' ')"
    runs = f"list_transform(regexp_extract_all({both}, '[\\p{{L}}\\p{{N}}_+/.\\-]+'), lambda x: {strip('x', r'+/.\-')})"
    words = f"list_filter({runs}, lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9+/.\\-]{{2,}}$'))"
    dressed = f"regexp_replace({strip('x', r' \-:#`')}, '[{SPACE}]+', ' ', 'g')"
    clean = f"list_filter(list_transform(list_concat([{name}], {heads}, {words}), lambda x: {dressed}), lambda x: length(x) >= 3 AND lower(x) NOT IN ({stop}))"
    return f"list_slice(list_filter({clean}, lambda x, i: list_position(list_transform({clean}, lambda y: lower(y)), lower(x)) = i), 1, 10)"
