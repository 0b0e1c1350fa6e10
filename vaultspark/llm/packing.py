"""Filling fixed-capacity containers with items (p8): non-negative least squares over length combinations.

Everything that grows with the data stays distributed: token counts, the histogram (at most `capacity` rows reach the driver),
ranks within a length and the lookup of containers. The plan made from the histogram is bounded by the capacity alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.session import stage_table

CAPACITY = 2048
#: Room that a combination of lengths may leave, as a share of the capacity (16 tokens of 2,048).
WINDOW = 128
#: Items in a salted block in which those of one length are ranked, about; there are more blocks for more items.
BLOCK_ITEMS = 50_000
#: The solution has converged when no combination's repeats would move by more than this, half a container.
STEP = 0.5


class LengthCombinations:
    """All combinations of up to three of the sizes whose sum leaves no more room than the window.

    They are kept as pairs (first, second <= third); for each pair the preferred third lies in a window of lengths, a full container
    before one with room, so the best combinations are found without listing all.
    """

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity, self.window = capacity, capacity // WINDOW
        self.there = np.zeros(capacity + 1, bool)
        self.there[sizes] = True
        self.there[0] = True
        sizes = np.nonzero(self.there)[0]
        pairs = [(a, sizes[(sizes >= a) & (sizes <= (capacity - a) // 2)]) for a in sizes[sizes <= capacity // 3].tolist()]
        self.first = np.concatenate([np.full(len(b), a) for a, b in pairs])
        self.second = np.concatenate([b for _, b in pairs])

    def best(self, left: np.ndarray, most: int = 6000) -> tuple[np.ndarray, np.ndarray]:
        """(combinations, steps): those whose repeats would move most against the residual `left`, steepest first; lengths padded with 0."""
        lengths = np.arange(self.capacity + 1)
        worth = np.concatenate([np.full(self.window, -np.inf), np.where(self.there, left, -np.inf)])
        view = np.lib.stride_tricks.sliding_window_view(worth, self.window + 1)
        # a shorter third must be worth an average length's residual more for each token of room it leaves
        short = (view[:, ::-1] - np.arange(self.window + 1) * np.abs(left).mean()).argmax(1)
        room = self.capacity - self.first - self.second
        slope = left[self.first] + left[self.second] + view[lengths, self.window - short][room]
        ok = np.flatnonzero(slope > STEP)
        if len(ok) > most:
            ok = ok[np.argpartition(-slope[ok], most)[:most]]
        found = np.sort(np.stack([self.first[ok], self.second[ok], (lengths - short)[room[ok]]], 1), 1)
        step = slope[ok] / squares(found)
        order = np.argsort(-step, kind="stable")
        return found[order], step[order]


def squares(combos: np.ndarray) -> np.ndarray:
    """Sum of the squared numbers of items of each length in a combination (rows sorted, padded with 0)."""
    low, high = (combos[:, 0] == combos[:, 1]) & (combos[:, 0] > 0), (combos[:, 1] == combos[:, 2]) & (combos[:, 1] > 0)
    return (combos > 0).sum(1) + 2.0 * low + 2.0 * high + 2.0 * (low & high)


def repeat_counts(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats): the non-negative repeats with least ||A x - histogram||² over all combinations, solved to convergence.

    Columns are generated: the steepest combinations, few for each length, join the active ones; these are solved by projected
    gradient steps of Barzilai and Borwein's lengths, scaled by the diagonal; what stays at zero leaves. It ends when no combination
    of any two lengths with the third they prefer would move by STEP. Few columns stay active, so little is lost in rounding. The work depends on the lengths alone.
    """
    all_ = LengthCombinations(np.nonzero(histogram)[0], capacity)
    combos, x = np.empty((0, 3), np.int64), np.empty(0)

    def residual(x: np.ndarray) -> np.ndarray:
        left = histogram.astype(float)
        for k in range(3):
            left -= np.bincount(combos[:, k], weights=x, minlength=capacity + 1)
        left[0] = 0
        return left

    left = residual(x)
    while True:
        found, step = all_.best(left)
        known, used, added = set(map(tuple, combos.tolist())), np.zeros(capacity + 1, int), []
        for k, combo in enumerate(map(tuple, found.tolist())):
            if step[k] < STEP:
                break
            if combo not in known and all(used[s] < 2 for s in combo if s):
                known.add(combo)
                used[list(combo)] += 1
                added.append(k)
        if not added:
            return combos, x
        combos, x = np.concatenate([combos, found[added]]), np.concatenate([x, np.zeros(len(added))])
        norm = squares(combos)
        slope = lambda left: left[combos].sum(1) / norm
        left = residual(x)
        way, length = slope(left), 0.5
        while np.maximum(way, -x).max() >= STEP / 2 or (-np.maximum(way, -x)).max() >= STEP / 2:
            after = np.maximum(x + length * way, 0)
            moved, left = after - x, residual(after)
            turned = slope(left)
            curve = (moved * (way - turned) * norm).sum()
            length = min(max((moved * moved * norm).sum() / curve, 1e-3), 1e3) if curve > 0 else 1.0
            x, way = after, turned
        combos, x = combos[x > 0], x[x > 0]
        left = residual(x)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (items of each length in a container) with their repeats, that together use the histogram exactly.

    Repeats of least squares, rounded down, first; what they leave is packed greedily, largest length first, each container closed by the
    largest that still fits. Patterns repeat, so the work is bounded by the number of lengths.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] += n
    out: list[tuple[dict[int, int], int]] = []
    if counts[capacity]:
        out.append(({capacity: 1}, int(counts[capacity])))
        counts[capacity] = 0
    combos, x = repeat_counts(counts, capacity)
    order = np.argsort(-x, kind="stable")
    for j in order[x[order] >= 1].tolist():
        pattern: dict[int, int] = {}
        for s in combos[j].tolist():
            if s:
                pattern[s] = pattern.get(s, 0) + 1
        n = min(int(x[j]), *(int(counts[s]) // m for s, m in pattern.items()))
        if n > 0:
            out.append((pattern, n))
            for s, m in pattern.items():
                counts[s] -= n * m
    present = (np.nonzero(counts[1:])[0] + 1).tolist()
    while present:
        room, pattern, top = capacity, {}, len(present)
        while room and top:
            top = int(np.searchsorted(present[:top], room, side="right"))
            if not top:
                break
            s = present[top - 1]
            fits = min(room // s, int(counts[s]))
            pattern[s] = fits
            room -= pattern[s] * s
            top -= 1
        n = min(int(counts[s]) // m for s, m in pattern.items())
        out.append((pattern, n))
        for s, m in pattern.items():
            counts[s] -= n * m
        present = [s for s in present if counts[s]]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where items go: key (length * 2^40 + first rank), first container, items of that length in a container, sorted by key; number of containers."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in patterns:
        for size, many in pattern.items():
            start = taken.get(size, 0)
            rows.append(((size << 40) + start, first, many))
            taken[size] = start + n * many
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2], first


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece_no, n_tokens: an item above the capacity is divided into full pieces and a rest, any other stays whole."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    numbered = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    return numbered.select("doc_id", "piece_no", F.greatest(F.least(F.lit(capacity), F.col("n_tokens") - (F.col("piece_no") - 1) * capacity), F.lit(0)).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece_no, n_tokens, container_id of every item of sizes (doc_id, n_tokens).

    Items of size 0 (empty and null texts) take no room and are spread over the containers by their doc_id. Null sizes count as 0. Rows with the same
    doc_id are separate items. An empty table gives no rows.
    """
    staged = stage_table(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    items = pieces(staged, capacity)
    histogram = {r.n_tokens: r.n for r in items.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    keys, firsts, many, n_containers = slots(plan(histogram, capacity))
    blocks = 1 + sum(histogram.values()) // BLOCK_ITEMS
    blocked = items.filter("n_tokens > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)))
    sums = blocked.groupBy("n_tokens", "block").agg(F.count("*").alias("n"))
    offsets = sums.select("n_tokens", "block", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("block")) - F.col("n")).alias("offset"))
    order = Window.partitionBy("n_tokens", "block").orderBy("doc_id", "piece_no")
    ranked = blocked.withColumn("place", F.row_number().over(order)).join(offsets, ["n_tokens", "block"])
    ranked = ranked.select("doc_id", "piece_no", "n_tokens", (F.col("offset") + F.col("place") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "rank"))
            at = np.searchsorted(keys, (size << 40) + rank, side="right") - 1
            container = firsts[at] + (rank - (keys[at] & ((1 << 40) - 1))) // many[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece_no", "n_tokens")), pa.array(container, pa.int64())], ["doc_id", "piece_no", "n_tokens", "container_id"])

    packed = ranked.mapInArrow(assign, "doc_id bigint, piece_no int, n_tokens int, container_id bigint")
    return packed.unionByName(items.filter("n_tokens = 0").withColumn("container_id", F.pmod(F.xxhash64("doc_id"), F.lit(max(n_containers, 1)))))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers by tenths of fill: fill_tenth, n_containers, n_items, n_tokens."""
    each = packed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return each.groupBy(F.floor(F.col("tokens") * 10 / capacity).cast("int").alias("fill_tenth")).agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"))
