"""Parent-child rows to full hierarchies (p6).

Connected components are found by following (node, parent) pairs within chunks and by pointer doubling between them; each is
co-located and walked depth first, iteratively, with node colouring. A component above MAX_GROUP rows is never put into one task: what the walk gives comes from
further doubling over its pairs, equal in every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.operators.ordered import total_before
from vaultspark.session import drop_stage, stage_table

#: Rows of a component that one task may hold.
MAX_GROUP = 100_000

WALKED = "section_id bigint, component bigint, root_id bigint, depth int, path array<bigint>, n_descendants bigint, last_seq bigint, seq bigint, is_back_edge boolean, parent_id bigint"


def parent_pairs(sections: DataFrame) -> DataFrame:
    """section_id, parent_id (null for a root), source_file: parent names the stem of a section of the same source_file.

    Rows with a null section_id are left out, repeated section_ids give one row (the least parent_id); of sections that share
    stem and source_file the least section_id is the parent.
    """
    rows = sections.filter(F.col("section_id").isNotNull()).select("section_id", "source_file", "stem", F.nullif("parent", F.lit("")).alias("parent"))
    stems = rows.filter("stem is not null and source_file is not null").groupBy("source_file", F.col("stem").alias("parent")).agg(F.min("section_id").alias("parent_id"))
    linked = rows.filter("parent is not null and source_file is not null").join(stems, ["source_file", "parent"], "left")
    roots = rows.filter("parent is null or source_file is null").select("section_id", F.lit(None).cast("bigint").alias("parent_id"), "source_file")
    both = linked.select("section_id", "parent_id", "source_file").unionByName(roots)
    return both.groupBy("section_id").agg(F.min("parent_id").alias("parent_id"), F.min_by("source_file", F.coalesce("parent_id", F.lit(2**63 - 1))).alias("source_file"))


REACHED = "section_id bigint, parent_id bigint, up bigint, steps int, settled boolean, looped boolean"


def ends(parent_of: dict[int, int | None]) -> Iterator[tuple]:
    """(node, parent, up, steps, settled, looped) of each node: how far its ancestors lead among these nodes.

    Settled: to a root, or around a loop, whose least node is `up` then; else `up` is the first ancestor that isn't here.
    """
    loops = {x: min(ring) for ring in find_loops(parent_of) for x in ring}
    known: dict[int, tuple[int, int, bool, bool]] = {x: (least, 0, True, True) for x, least in loops.items()}
    for start in parent_of:
        trail, x = [], start
        while x in parent_of and x not in known and parent_of[x] is not None:
            trail.append(x)
            x = parent_of[x]
        up, steps, settled, looped = known.get(x) or (x, 0, x in parent_of, False)
        if x in parent_of and x not in known:
            known[x] = up, steps, settled, looped
        for y in reversed(trail):
            steps += 1
            known[y] = up, steps, settled, looped
    for x, p in parent_of.items():
        yield x, p, *known[x]


def _chunks(batches: Iterator[pa.RecordBatch], key: str, most: int = 50_000) -> Iterator[dict[int, int | None]]:
    """Parents by node of whole keys, some 50,000 rows at a time; batches are sorted by key, and a key may span several."""
    held: dict[int, int | None] = {}
    last = None
    for batch in batches:
        for k, node, parent in zip(*(batch.column(c).to_pylist() for c in (key, "section_id", "parent_id"))):
            if k != last and len(held) >= most:
                yield held
                held = {}
            last = k
            held[node] = parent
    if held:
        yield held


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
    names = [c.split()[0] for c in REACHED.split(", ")]
    for parent_of in _chunks(batches, "chunk"):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends(parent_of)), types)], names)


def components(pairs: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """section_id, parent_id, component, depth (null in components with a loop) of each node of a forest with loops.

    A component is named by its root, or by the least node of its loop. Chains are followed within chunks of a source_file of some
    `most` rows, which is all of it unless it is large; what leads out of a chunk is settled by pointer doubling: after k rounds a
    node knows where 2^k chunks lead. Rounds end when one settles no node: the numbers of chunks have no gap.
    """
    file = F.coalesce("source_file", F.concat(F.lit("\u0001"), F.pmod("section_id", F.lit(997)).cast("string")))
    keyed = pairs.withColumn("file", file)
    sizes = keyed.groupBy("file").agg(F.ceil(F.count("*") / most).alias("chunks"))
    placed = keyed.join(sizes, "file").select("section_id", "parent_id", F.concat("file", F.lit("\u0001"), F.pmod(F.xxhash64("section_id"), F.col("chunks")).cast("string")).alias("chunk"))
    far = stage_table(placed.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_reach, REACHED))
    unsettled = far.filter("not settled").count()
    while unsettled:
        target = far.select(F.col("section_id").alias("t_id"), F.col("up").alias("t_up"), F.col("steps").alias("t_steps"), F.col("settled").alias("t_settled"), F.col("looped").alias("t_looped"))
        moved = far.filter("not settled").join(target, F.col("up") == F.col("t_id"))
        moved = moved.select("section_id", "parent_id", F.col("t_up").alias("up"), (F.col("steps") + F.col("t_steps")).alias("steps"), F.col("t_settled").alias("settled"), F.col("t_looped").alias("looped"))
        after = stage_table(far.filter("settled").unionByName(moved))
        drop_stage(far)
        far, before = after, unsettled
        unsettled = far.filter("not settled").count()
        if unsettled == before:
            break
    done = far.filter("settled").select("section_id", "parent_id", F.col("up").alias("component"), F.when(~F.col("looped"), F.col("steps")).alias("depth"))
    if not unsettled:
        return done
    rest = far.filter("not settled").select("section_id", "parent_id")
    looped = _loops(rest.select("section_id", "parent_id"), rest.select(F.col("section_id").alias("id")))
    return done.unionByName(rest.join(looped, "section_id").select("section_id", "parent_id", "component", F.lit(None).cast("int").alias("depth")))


def _loops(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes that lead to a loop, with the least node of that loop.

    The images of all nodes 1, 2, 4, ... steps up shrink strictly until they are just the loops' nodes. Then least-node
    values are doubled along the loops until a round changes none.
    """
    edges = stage_table(ids.join(pairs, F.col("id") == F.col("section_id")).select("id", F.col("parent_id").alias("up")))
    far, size = edges, None
    while True:
        image = far.select("up").distinct().count()
        if image == size:
            break
        size = image
        far = _jump(far)
    ring = stage_table(far.select(F.col("up").alias("id")).distinct())
    least = stage_table(ring.join(edges, "id").select("id", "up", F.least("id", "up").alias("least")))
    while True:
        other = least.select(F.col("id").alias("o_id"), F.col("up").alias("o_up"), F.col("least").alias("o_least"))
        after = stage_table(least.join(other, F.col("up") == F.col("o_id")).select("id", F.col("o_up").alias("up"), F.least("least", "o_least").alias("least"), (F.col("o_least") < F.col("least")).alias("changed")))
        changed = after.filter("changed").limit(1).count()
        drop_stage(least)
        least = after.drop("changed")
        if not changed:
            break
    ends = far.select(F.col("id").alias("section_id"), F.col("up").alias("end"))
    return ends.join(least.select(F.col("id").alias("end"), F.col("least").alias("component")), "end").select("section_id", "component")


def _jump(far: DataFrame) -> DataFrame:
    other = far.select(F.col("id").alias("o_id"), F.col("up").alias("o_up"))
    return stage_table(far.join(other, F.col("up") == F.col("o_id")).select("id", F.col("o_up").alias("up")))


def find_loops(parent_of: dict[int, int | None]) -> list[list[int]]:
    """The loops among parent links, each as its nodes; a parent may lead out of these nodes."""
    seen: dict[int, int] = {}
    loops = []
    for n, start in enumerate(parent_of):
        x: int | None = start
        while x in parent_of and x not in seen:
            seen[x] = n
            x = parent_of[x]
        if seen.get(x) == n:
            ring, y = [x], parent_of[x]
            while y != x:
                ring.append(y)
                y = parent_of[y]
            loops.append(ring)
    return loops


def walk_forest(parent_of: dict[int, int | None], paths: bool = True) -> Iterator[tuple]:
    """Iterative depth-first walk, with node colouring, of the components of one forest with loops.

    Yields (id, component, root, depth, path, descendants, last_seq, seq, is_back_edge, parent) in pre-order. The walk of a
    loop starts at its least node; its back edge is the link of that node to its parent, found grey when reached again.
    """
    children: dict[int, list[int]] = {}
    for i, p in parent_of.items():
        if p is not None:
            children.setdefault(p, []).append(i)
    loops = {min(ring): set(ring) for ring in find_loops(parent_of)}
    for root in [*(i for i, p in parent_of.items() if p is None), *loops]:
        ring = loops.get(root, set())
        order, last, back = {root: 0}, {}, set()
        grey = [(root, iter(sorted(children.get(root, ()))))]
        while grey:
            node, rest = grey[-1]
            child = next(rest, None)
            if child is None:  # black
                last[node] = len(order) - 1
                grey.pop()
            elif child in order:  # grey, as every node has one parent: a back edge
                back.add(child)
            else:
                order[child] = len(order)
                grey.append((child, iter(sorted(children.get(child, ())))))
        trail: list[int] = []
        depths: dict[int, int] = {}
        for node, seq in order.items():
            up = parent_of[node] if node != root else None
            depths[node] = 0 if up is None else depths[up] + 1
            del trail[depths[node] :]
            trail.append(node)
            below = last[root] if node in ring else last[node] - seq
            yield node, root, root, -1 if node in ring else -2 if ring else depths[node], list(trail) if paths else [], below, last[node], seq, node in back, parent_of[node]


def _walk(paths: bool):
    """Batches sorted by component to walked rows; whole components are walked together."""
    schema = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}[kind]) for c, kind in (x.split() for x in WALKED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parent_of in _chunks(batches, "component"):
            out, load = [], 0
            for row in walk_forest(parent_of, paths):
                out.append(row)
                load += 10 + len(row[4])
                if load > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, load = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _sizes(edges: DataFrame) -> DataFrame:
    """section_id, below: how many nodes stand below each in a forest (section_id, up).

    After k rounds a node has counted those less than 2^k steps below it, so every round is of the forest's size.
    """
    state = stage_table(edges.select("section_id", "up", F.lit(1).cast("bigint").alias("n")))
    while state.filter("up is not null").limit(1).count():
        more = state.filter("up is not null").groupBy(F.col("up").alias("m_id")).agg(F.sum("n").alias("more"))
        other = state.select(F.col("section_id").alias("o_id"), F.col("up").alias("o_up"))
        counted = state.join(more, F.col("section_id") == F.col("m_id"), "left").join(other, F.col("up") == F.col("o_id"), "left")
        after = stage_table(counted.select("section_id", F.col("o_up").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        drop_stage(state)
        state = after
    return state.select("section_id", (F.col("n") - 1).alias("below"))


def _distributed(nodes: DataFrame, paths: bool) -> DataFrame:
    """Rows as from the walk for components (section_id, component, depth, parent_id) too large for one task.

    A loop is cut at the link of its least node, which makes its component a tree. A node's place in the walk is the sum, over its
    path, of the sizes of what is walked between each node and its parent; paths and these sums are doubled together. Ring nodes
    are the images of all nodes of looped components far enough up.
    """
    least = F.col("section_id") == F.col("component")
    edges = stage_table(nodes.select("section_id", "component", "parent_id", F.col("depth").isNull().alias("looped"), F.when(~(F.col("depth").isNull() & least), F.col("parent_id")).alias("up")))
    sizes = stage_table(_sizes(edges))
    beside = total_before(edges.filter("up is not null").join(sizes, "section_id").select("up", "section_id", (F.col("below") + 1).alias("size")), ["up"], ["section_id"], "size")
    steps = beside.select("section_id", (F.col("before") + 1).alias("seq"))
    path = F.array("section_id") if paths else F.array().cast("array<bigint>")
    state = stage_table(edges.join(steps, "section_id", "left").select("section_id", "up", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps"), path.alias("path")))
    while state.filter("up is not null").limit(1).count():
        other = state.select(F.col("section_id").alias("o_id"), F.col("up").alias("o_up"), F.col("seq").alias("o_seq"), F.col("steps").alias("o_steps"), F.col("path").alias("o_path"))
        moved = state.filter("up is not null").join(other, F.col("up") == F.col("o_id"))
        moved = moved.select("section_id", F.col("o_up").alias("up"), (F.col("seq") + F.col("o_seq")).alias("seq"), (F.col("steps") + F.col("o_steps")).alias("steps"), F.concat("o_path", "path").alias("path"))
        after = stage_table(state.filter("up is null").unionByName(moved))
        drop_stage(state)
        state = after
    far, size = edges.filter("looped").select(F.col("section_id").alias("id"), F.col("parent_id").alias("up")), None
    far = stage_table(far)
    while (image := far.select("up").distinct().count()) != size:
        size, far = image, _jump(far)
    ring = far.select(F.col("up").alias("section_id")).distinct().withColumn("on_ring", F.lit(True))
    others = edges.filter("looped").groupBy("component").agg((F.count("*") - 1).alias("others"))
    joined = state.drop("up").join(edges, "section_id").join(sizes, "section_id").join(ring, "section_id", "left").join(others, "component", "left")
    depth = F.when(F.col("on_ring"), -1).when(F.col("looped"), -2).otherwise(F.col("steps"))
    return joined.select(
        "section_id", "component", F.col("component").alias("root_id"), depth.cast("int").alias("depth"), "path", F.when(F.col("on_ring"), F.col("others")).otherwise(F.col("below")).alias("n_descendants"),
        (F.col("seq") + F.col("below")).alias("last_seq"), "seq", (F.col("looped") & least).alias("is_back_edge"), "parent_id",
    )


def hierarchy(sections: DataFrame, paths: bool = True, max_group: int = MAX_GROUP) -> DataFrame:
    """Every section with component, root_id, depth, path (ids from the root), n_descendants, pre-order places and back edges.

    A section whose parent is null, empty or no stem of its own source_file is a root of depth 0. On a loop depth is -1,
    leading into one -2, and root_id is the least section_id of the loop, where its path begins. Descendants of x within its
    component are the rows with seq in (x.seq, x.last_seq]; of a node on a loop all others. Rows with a null section_id are left
    out, repeated rows give one row; of sections that share stem and source_file the least is the parent. An empty table gives no
    rows; columns besides those read are ignored. Without paths they stay empty.

    Components of up to max_group rows are walked where they are co-located, larger ones give the same rows without being gathered.
    """
    nodes = components(parent_pairs(sections), max_group)
    large = stage_table(nodes.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > max_group).select("component"))
    any_large = bool(large.limit(1).count())
    rest = nodes.join(large, "component", "left_anti") if any_large else nodes
    walked = rest.select("component", "section_id", "parent_id").repartition("component").sortWithinPartitions("component", "section_id").mapInArrow(_walk(paths), WALKED)
    return walked.unionByName(_distributed(nodes.join(large, "component", "left_semi"), paths)) if any_large else walked


def descendants(walked: DataFrame, loops: bool = False) -> DataFrame:
    """section_id, descendant_id, distance: one row for each section and section below it, taken from the paths.

    With loops also for sections on or below a loop: a node of a ring has all others of its component below it, a node below
    has its subtree; distance is the least number of steps. Else those have none; the walk reports them by their depth.
    """
    at = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("place", "ancestor_id")
    kept = walked if loops else walked.filter(F.col("depth") > 0)
    below = kept.filter(F.size("path") > 1).select(F.col("section_id").alias("descendant_id"), F.size("path").alias("n"), at).select(F.col("ancestor_id").alias("section_id"), "descendant_id", (F.col("n") - 1 - F.col("place")).cast("int").alias("distance"))
    return below.unionByName(_around(walked)) if loops else below


def _around(walked: DataFrame) -> DataFrame:
    """Rows of descendants that lead over the link a loop's path is cut at: ring nodes that aren't on a node's path."""
    looped = stage_table(walked.filter("depth < 0").select("section_id", "root_id", "depth", "path"))
    ring = looped.filter("depth = -1").select("root_id", F.col("section_id").alias("ring_id"), F.size("path").alias("place"))
    size = ring.groupBy("root_id").agg(F.count("*").cast("int").alias("n_ring"))
    pairs = looped.join(ring.join(size, "root_id"), "root_id").filter(~F.array_contains("path", F.col("ring_id")))
    return pairs.select(F.col("ring_id").alias("section_id"), F.col("section_id").alias("descendant_id"), (F.size("path") + F.col("n_ring") - F.col("place")).cast("int").alias("distance"))
