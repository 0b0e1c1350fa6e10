"""Places in extracted pages that look damaged: six detectors over the lines of each text.

Every text is examined in its own row, so nothing is shuffled; runs of lines are found with arrays of conditions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md

# Line shapes, relation and chart terms, confidence of each risk.
HEADING = re.compile(r"^\s{0,3}#{1,6}\s+")
NOISE = re.compile(r"^\s*(?:\d+|Page\s+\d+|第\s*\d+\s*页|[-_=]{2,}|[·•])\s*$")
ITEM = re.compile(r"^\s*(?:[-*•]\s+|\d+[.)、]\s+|[一二三四五六七八九十]+[、.)])")
CELLS = re.compile(r"\s{2,}|\t+")
RELATIONS = {"刑", "冲", "破", "害", "合", "克", "生"}
CHART = {
    "子", "丑", "寅", "卯", "辰", "巳", "午", "未", "申", "酉", "戌", "亥", "甲", "乙", "丙", "丁", "戊", "己", "庚", "辛", "壬", "癸",
    "贵", "后", "阴", "玄", "常", "虎", "空", "龙", "勾", "合", "朱", "蛇",
}
CONFIDENCE = {"table_fragment": 0.9, "chart_block": 0.86, "short_column_relation": 0.82, "running_header_noise": 0.75, "heading_break": 0.71, "list_fragment": 0.68}
PAGE_MARK = re.compile(r"(?:第\s*)?\d+(?:\s*页)?")
#: Lines in which a page mark is looked for, and lines of context on either side.
HINT_LINES, RADIUS = 8, 2
FOUND = "risk_type string, confidence double, start_line int, end_line int, heading string, excerpt string, page_hint string, context_before array<string>, context_after array<string>"


def _runs(marks: list[bool]) -> Iterator[tuple[int, int]]:
    """Maximal runs of marked places as half-open ranges."""
    start = None
    for k, m in enumerate([*marks, False]):
        if m and start is None:
            start = k
        elif not m and start is not None:
            yield start, k
            start = None


def detect(text: str) -> list[tuple[str, int, int]]:
    """(risk, first line, end) of each damaged place, lines counting from 0 and the end not included."""
    raw = text.splitlines()
    lines = [x.strip() for x in raw]
    heads = [bool(HEADING.match(x)) for x in raw]
    fit = [bool(x) and not h for x, h in zip(lines, heads)]
    found: list[tuple[str, int, int]] = []

    cells = [[c for c in CELLS.split(x) if c] if f else [] for x, f in zip(lines, fit)]
    for a, b in _runs([len(c) >= 3 and all(len(x) <= 12 for x in c) for c in cells]):
        first = b - 1
        while first > a and len(cells[first - 1]) == len(cells[b - 1]):
            first -= 1
        if b - first >= 3:
            found.append(("table_fragment", first, b))

    def charted(x: str) -> bool:
        parts = x.split()
        known = sum(p in CHART for p in parts)
        return len(x) <= 24 and 0 < len(parts) <= 8 and known >= max(2, len(parts) // 2)

    found += [("chart_block", a, b) for a, b in _runs([f and charted(x) for x, f in zip(lines, fit)]) if b - a >= 4]
    items = [bool(ITEM.match(x)) for x in lines]
    for a, b in _runs([f and len(x) <= 8 and not i for x, f, i in zip(lines, fit, items)]):
        if b - a >= 4 and sum(bool(RELATIONS & set(x)) for x in lines[a:b]) >= 2:
            found.append(("short_column_relation", a, b))
    last = None
    for k, x in enumerate(lines):
        if k and last is not None and heads[last] and NOISE.match(raw[k]):
            found.append(("running_header_noise", k, k + 1))
        if x:
            last = k
    for k, head in enumerate(heads):
        if head:
            probed = lines[k + 1 : k + 6]
            stop = next((j for j, x in enumerate(probed) if len(x) > 12), len(probed))
            short = [x for x, i in zip(probed[:stop], items[k + 1 :]) if x and len(x) <= 4 and not i]
            if len(short) >= 3:
                found.append(("heading_break", k, k + 2 + max(j for j, x in enumerate(probed[:stop]) if x)))
    for a, b in _runs([f and (len(x) <= 4 or i) for x, f, i in zip(lines, fit, items)]):
        start = next((k for k in range(a, b) if items[k]), None)
        if start is not None and sum(len(x) <= 4 for x in lines[start + 1 : b]) >= 2:
            found.append(("list_fragment", start, b))
    return found


def candidates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, risk_type, confidence, start_line (from 1), end_line, heading above, excerpt, page_hint, context_before, context_after of every damaged place.

    The page hint is the nearest page mark in its first line and the seven before; context are the lines that aren't blank among two
    on either side. Null texts have no places.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                lines = t.splitlines()
                for risk, a, b in detect(t):
                    head = next((lines[j].strip().lstrip("#").strip() for j in range(a, -1, -1) if HEADING.match(lines[j])), "")
                    hint = next((x for j in range(a, max(-1, a - HINT_LINES), -1) if PAGE_MARK.fullmatch(x := lines[j].strip())), None)
                    around = [[x for x in lines[i:j] if x.strip()] for i, j in ((max(0, a - RADIUS), a), (b, b + RADIUS))]
                    rows.append((k, risk, CONFIDENCE[risk], a + 1, b, head, "\n".join(lines[a:b]).strip(), hint, *around))
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in FOUND.split(", ")]])

    return texts.filter(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, {FOUND}")


def normalised(excerpt: Column) -> Column:
    """An excerpt's lines trimmed, with single spaces inside, blank ones left out."""
    return F.array_join(F.filter(F.transform(md.lines(excerpt), lambda x: F.regexp_replace(md.strip(x), f"[{md.SPACE}]+", " ")), lambda x: x != ""), "\n")


def page_hint(lines: Column) -> Column:
    """The nearest page mark in the last HINT_LINES of some lines, trimmed; null where there is none."""
    near = F.transform(F.slice(lines, F.greatest(F.size(lines) - HINT_LINES + 1, F.lit(1)), F.lit(HINT_LINES)), lambda x: md.strip(x))
    return F.try_element_at(F.filter(near, lambda x: x.rlike(f"^{PAGE_MARK.pattern}$")), F.lit(-1))


def top(found: DataFrame, n: int = 10) -> DataFrame:
    """A report's first candidates: highest confidence, then path and line."""
    return found.orderBy(F.desc("confidence"), "chapter_path", "start_line", "candidate_id").limit(n)


def deduplicated(found: DataFrame, key: list[str]) -> DataFrame:
    """One candidate for each key (path, risk, normalised excerpt): highest confidence, then earliest."""
    best = F.min_by(F.struct(*[c for c in found.columns if c not in key]), F.struct(-F.col("confidence"), F.col("start_line"), F.col("candidate_id")))
    return found.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")
