import random

from vaultspark.operators import hierarchy as H

SCHEMA = "section_id bigint, source_file string, stem string, parent string, depth int, path string, component string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash", "clash") for r in rows], SCHEMA)


def walked(spark, rows, **how):
    return {r.section_id: r for r in H.hierarchy(table(spark, rows), **how).collect()}


def brute(rows):
    ids, stems = {}, {}
    for i, f, s, _ in sorted(set(rows), key=lambda r: (r[0], str(r))):
        if f is not None and s is not None:
            stems.setdefault((f, s), i)
    for i, f, _, p in rows:
        ids[i] = stems.get((f, p)) if f is not None and p else None
    out = {}
    for i in ids:
        path, x = [i], ids[i]
        while x is not None and x not in path:
            path.append(x)
            x = ids[x]
        ring = [] if x is None else path[path.index(x) :]
        out[i] = (path[-1], len(path) - 1) if x is None else (min(ring), -1 if i in ring else -2)
    return out


ROWS = [(1, "f", "a", None), (2, "f", "b", "a"), (3, "f", "c", "b"), (4, "f", "d", "a"), (5, "g", "a", "b"), (6, "g", "x", ""), (7, "f", "p", "q"), (8, "f", "q", "p"), (9, "f", "r", "q"), (10, None, "a", "a"), (11, "h", "s", "s"), (12, "f", None, "a")]


def test_roots_depths_paths_and_loops(spark):
    got = walked(spark, ROWS + ROWS[:3])
    assert {i: (r.root_id, r.depth) for i, r in got.items()} == brute(ROWS)
    assert got[3].path == [1, 2, 3] and got[1].n_descendants == 4 and got[2].n_descendants == 1
    assert [i for i, r in got.items() if r.is_back_edge] == [7, 11] and got[9].depth == -2
    below = [i for i, r in got.items() if r.root_id == 1 and got[1].seq < r.seq <= got[1].last_seq]
    assert sorted(below) == [2, 3, 4, 12]
    pairs = {(r.section_id, r.descendant_id, r.distance) for r in H.descendants(H.hierarchy(table(spark, ROWS))).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1), (1, 12, 1)}


def test_large_source_files_go_the_distributed_way(spark):
    random.seed(5)
    rows = [(i + 100, "hot", f"s{i}", f"s{random.randint(max(0, i - 6), i + 1)}" if random.random() < 0.93 else None) for i in range(400)] + ROWS
    got = walked(spark, rows, max_group=20)
    assert {i: (r.root_id, r.depth) for i, r in got.items()} == brute(rows)
    local = walked(spark, rows)
    assert {i: r.path for i, r in got.items() if r.depth >= 0} == {i: r.path for i, r in local.items() if r.depth >= 0}
    assert {i: r.n_descendants for i, r in got.items() if r.depth >= 0} == {i: r.n_descendants for i, r in local.items() if r.depth >= 0}


def test_chunks_whose_parents_lie_in_others(spark):
    """6 million sections failed by a KeyError, as their books fall into chunks that lie in several tasks."""
    assert {x[0]: x[2:] for x in H.ends({1: 9, 2: 1, 3: 4, 4: 3, 5: 4, 6: None})} == {1: (9, 1, False, False), 2: (9, 2, False, False), 3: (3, 0, True, True), 4: (3, 0, True, True), 5: (3, 1, True, True), 6: (6, 0, True, False)}
    random.seed(6)
    rows = [(i, "hot", f"s{i}", f"s{random.randint(max(0, i - 6), i + 1)}" if random.random() < 0.95 else None) for i in range(400)] + [(i + 400, "hot", f"s{i + 400}", f"s{400 + (i + 1) % 90}") for i in range(90)]
    local = walked(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with large tables, each task has few chunks
    try:
        got = walked(spark, rows, max_group=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {i: (r.root_id, r.depth) for i, r in got.items()} == brute(rows)
    assert got == local


def test_deep_chain_and_empty_table(spark):
    chain = [(i, "f", f"s{i}", f"s{i - 1}" if i else None) for i in range(3000)]
    got = walked(spark, chain, paths=False)
    assert got[2999].depth == 2999 and got[0].n_descendants == 2999
    assert walked(spark, []) == {}
    assert walked(spark, [(None, "f", "a", None)]) == {}
