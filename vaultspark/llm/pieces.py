"""Splitting oversized items at natural boundaries (p2): dynamic programming over boundary positions.

A split minimises the penalties of its cuts and the imbalance of its pieces, none of which is longer than the limit; each piece
but the first begins with the end of the one before. Items are independent rows, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
KINDS = ["paragraph", "line", "sentence", "word", "mark", "forced"]
#: Penalty of a cut by its kind; one forced cut costs more than any number of natural ones in a window.
PENALTY = np.array([0.0, 0.5, 1.0, 2.0, 3.0, 1000.0])
#: Of an overlap shorter than asked for, and weight of the imbalance.
SHORTENED, IMBALANCE = 50.0, 4.0
#: Inside an unbroken stretch forced cuts lie on a grid of this share of the limit (10 code points of 4,000); all natural boundaries count.
GRID = 400

MARKS = np.array([ord(c) for c in ".!?。！？"])
WIDE_MARKS = np.array([ord(c) for c in "。！？"])
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
PIECES = "piece_no int, first int, n_chars int, n_overlap int, cut string"


def boundaries(codes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, kinds, all natural positions): where a text of these code points may be cut, 0 and its end included."""
    n = len(codes)
    space = np.isin(codes, SPACES)
    mark = np.isin(codes, MARKS)
    edge = np.diff(space.astype(np.int8), prepend=0, append=0)
    begins, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    lines = np.concatenate([[0], np.cumsum((codes == 10) | ((codes == 13) & ~np.append(codes[1:] == 10, False)))])
    breaks = lines[ends] - lines[begins]
    after_mark = np.where(begins > 0, mark[np.maximum(begins - 1, 0)], False)
    kind = np.where(breaks >= 2, 0, np.where(breaks == 1, 1, np.where(after_mark, 2, 3)))
    marks = np.nonzero(mark)[0] + 1
    wide = np.isin(codes[marks - 1], WIDE_MARKS)
    inner = marks[(marks < n) & ~space[np.minimum(marks, n - 1)]]
    inner_kind = np.where(wide[(marks < n) & ~space[np.minimum(marks, n - 1)]], 2, 4)
    before_mark = np.nonzero(mark)[0]
    within = np.nonzero(space[:-1] & space[1:])[0] + 1  # inside a run of white space
    at = np.concatenate([ends, inner, within, begins, before_mark])
    of = np.concatenate([kind, inner_kind, np.full(len(within), 3), np.full(len(begins) + len(before_mark), 4)])
    order = np.lexsort((of, at))
    at, of = at[order], of[order]
    first = np.append(True, at[1:] != at[:-1]) if len(at) else np.empty(0, bool)
    at, of = at[first], of[first]
    inside = (at > 0) & (at < n)
    at, of = at[inside], of[inside]
    rim = np.concatenate([[0], at, [n]])
    wide_gaps = np.nonzero(np.diff(rim) > limit)[0]
    natural = at[of <= 3]
    if len(wide_gaps):
        grid = np.concatenate([np.arange(rim[g] + max(1, limit // GRID), rim[g + 1], max(1, limit // GRID)) for g in wide_gaps])
        at, of = np.concatenate([at, grid]), np.concatenate([of, np.full(len(grid), 5)])
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
    return np.concatenate([[0], at, [n]]), np.concatenate([[0], of, [0]]), natural


def cheapest(at: np.ndarray, penalty: np.ndarray, back: np.ndarray, limit: int, target: float) -> tuple[float, list[int]]:
    """(cost, places of the cuts from 0 to the end) of the cheapest split at these positions; infinite where a gap is above the limit."""
    m = len(at)
    cost, came = np.zeros(m), np.zeros(m, np.int64)
    low = np.searchsorted(at, at - limit)
    # pieces from before this place have no room for the whole overlap; where overlaps begin never falls
    full = np.maximum(np.searchsorted(np.maximum.accumulate(at - back), at - limit), low)
    weight, place = IMBALANCE / target**2, at.astype(float)
    for j, (a, b, c, p) in enumerate(zip(low.tolist(), full.tolist(), (place - target).tolist(), penalty.tolist())):
        if j == 0:
            continue
        if a == j:
            return float("inf"), []
        off = place[a:j] - c
        off *= off
        off *= weight
        off += cost[a:j]
        if b > a:
            off[: b - a] += SHORTENED
        best = int(off.argmin())
        came[j] = a + best
        cost[j] = off[best] + p
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(int(came[cuts[-1]]))
    return float(cost[-1]), cuts[::-1]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(first, length, overlap, kind of the cut at its end) of each piece, in code points; the last one's cut is `end`."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "end")]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at, kinds, natural = boundaries(codes, limit)
    near = np.minimum(np.searchsorted(natural, at - overlap), max(len(natural) - 1, 0))
    start = natural[near] if len(natural) else at - overlap
    back = np.where((start >= at - overlap) & (start < at), at - start, np.minimum(overlap, at))
    back[0] = 0
    target = n / np.ceil((n - overlap) / (limit - overlap))
    # strong boundaries first: a split that uses a weaker one costs its penalty at least, so one below that is the cheapest over all
    for level in range(1, len(KINDS)):
        some = np.nonzero(kinds <= level)[0]
        cost, cuts = cheapest(at[some], PENALTY[kinds[some]], back[some], limit, target)
        if level + 1 == len(KINDS) or cost <= PENALTY[level + 1]:
            break
    cuts = some[cuts].tolist()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        over = int(min(back[a], limit - (at[b] - at[a])))
        out.append((int(at[a]) - over, int(at[b] - at[a]) + over, over, KINDS[kinds[b]] if b < len(at) - 1 else "end"))
    return out


def _split(with_text: bool, limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 200):
                rows = []
                for item, body in batch.iloc[begin : begin + 200].itertuples(index=False):
                    for no, (first, length, over, cut) in enumerate(split(body, limit, overlap), 1):
                        rows.append((item, no, first, length, over, cut, *([body[first : first + length]] if with_text else [])))
                yield pd.DataFrame(rows, columns=["section_id", "piece_no", "first", "n_chars", "n_overlap", "cut", *(["text"] if with_text else [])])

    return run


def cut_points(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    """section_id, piece_no, first (0-based), n_chars, n_overlap, cut [, text] of the pieces of every body above the limit.

    Null bodies and those up to the limit have no rows here. Rows with a repeated section_id are split each.
    """
    schema = f"section_id bigint, {PIECES}" + (", text string" if with_text else "")
    return items.filter(F.length("body") > limit).select(F.col("section_id").cast("bigint"), "body").mapInPandas(_split(with_text, limit, overlap), schema)


def all_pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """As cut_points with the text, and a body up to the limit as its one piece; null bodies give no piece."""
    whole = items.filter(F.length("body") <= limit).select(
        F.col("section_id").cast("bigint"), F.lit(1).alias("piece_no"), F.lit(0).alias("first"), F.length("body").alias("n_chars"), F.lit(0).alias("n_overlap"), F.lit("end").alias("cut"), F.col("body").alias("text")
    )
    return whole.unionByName(cut_points(items, limit, overlap, with_text=True))


def find_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """section_id, boundary (natural, or forced where a cut had to fall inside an unbroken stretch) of every body above the limit."""
    cuts = cut_points(items, limit, overlap)
    return cuts.groupBy("section_id").agg(F.when(F.bool_or(F.col("cut") == "forced"), "forced").otherwise("natural").alias("boundary"))
