"""Whole results where a query used to stop short."""

import json
import random

from tests.test_hierarchy import ROWS, table
from vaultspark.operators import compile as C
from vaultspark.operators import hierarchy as H
from vaultspark.operators import notes as N
from vaultspark.operators import rank
from vaultspark.plans import vault


def test_hints_count_before_pages_are_left_out(spark):
    texts = {1: "iron iron iron", 2: "iron iron", 3: "iron", 4: "gate", 5: "nothing", 6: "nothing", 7: None, 8: "quiet"}
    bonus, entries = {4: 2, 5: 1, 7: 9}, {3: {"title": "Iron Gate iron"}, 6: {"title": "a Gate"}}
    pages = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    hints = spark.createDataFrame([(i, bonus.get(i, 0), json.dumps(entries[i]) if i in entries else None) for i in sorted({*bonus, *entries})], "doc_id bigint, bonus int, entry string")
    tokens = {1: ["iron", "gate"], 2: ["absent"]}
    asked = spark.createDataFrame([(1, "Iron gate?"), (2, "absent"), (3, None)], "question_id bigint, question string")
    want = set()
    for q, words in tokens.items():
        scored = [(sum((t or "").count(w) for w in words) + bonus.get(i, 0) + sum(w in json.dumps(entries.get(i, "")).lower() for w in words), i) for i, t in texts.items() if t is not None]
        best = sorted(((s, i) for s, i in scored if s > 0), key=lambda x: (-x[0], x[1]))[:3]
        want |= {(q, i, s, k) for k, (s, i) in enumerate(best, 1)}
    got = {(r.question_id, r.doc_id, r.score, r.place) for r in rank.ranked(asked, pages, 3, hints).collect()}
    assert got == want and (1, 4, 3, 3) in got - {(1, 2, 2, 3)} and (2, 5, 1, 2) in got


def test_index_mentions_and_registry_entries(spark):
    names = spark.createDataFrame([("a/b",), ("a/c",), ("b",), (None,)], "name string")
    lines = spark.createDataFrame([("- [[a/bc]]: x",), (None,)], "text string")
    assert {r.name for r in rank.mentioned(names, lines, block=1).collect()} == {"a/b", "b"}
    notes = spark.createDataFrame([(1, "p.md", "Old"), (2, "p.md", "New"), (3, None, "x")], "note_id bigint, path string, title string")
    assert [(r.page, json.loads(r.entry)) for r in rank.registry_entries(notes).collect()] == [("wiki/p.md", {"path": "p.md", "title": "New"})]


def looped_rows():
    random.seed(9)
    tails = [(i + 100, "hot", f"s{i}", f"s{random.randint(0, i - 1) if i > 5 else (i + 1) % 6}") for i in range(60)]
    return tails + [(i + 300, "hot", f"t{i}", f"t{i - 1}" if i else None) for i in range(30)] + ROWS


def test_paths_of_loops_are_the_same_in_large_files(spark):
    columns = ("root_id", "depth", "path", "n_descendants", "is_back_edge", "parent_id")
    low, high = ({r.section_id: tuple(r[c] for c in columns) for r in H.hierarchy(table(spark, looped_rows()), max_group=m).collect()} for m in (20, 10_000))
    assert low == high and low[100][1] == -1 and low[100][3] == 59 and any(len(r[2]) > 6 for r in low.values() if r[1] == -2)


def test_descendants_of_loops(spark):
    rows = looped_rows()
    stems = {}
    for i, f, s, _ in sorted(rows, key=lambda r: r[0]):
        if f is not None and s is not None:
            stems.setdefault((f, s), i)
    up = {i: stems.get((f, p)) if f is not None and p else None for i, f, _, p in rows}
    want = set()
    for i in up:
        x, steps, seen = up[i], 1, {i}
        while x is not None and x not in seen:
            want.add((x, i, steps))
            seen.add(x)
            x, steps = up[x], steps + 1
    for m in (20, 10_000):
        got = [tuple(r) for r in H.descendants(H.hierarchy(table(spark, rows), max_group=m), loops=True).select("section_id", "descendant_id", "distance").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_references_link_to_the_smallest_title(spark):
    rows = [(1, "Chapter 4", "see Chapter 4 and 見《Gate》"), (2, "Iron Gate", "見《Gate》"), (3, "Gate", "見《The Iron Gate》 見《nowhere》"), (4, None, None), (5, "12-第12章", "見第2章")]
    texts = spark.createDataFrame(rows, "k int, own string, t string")
    titles = texts.select("own").toDF("title")
    names = sorted(t for _, t, _ in rows if t)
    refs = {1: ["Chapter 4", "Gate"], 2: ["Gate"], 3: ["The Iron Gate", "nowhere"], 5: ["2"]}
    own = {k: t for k, t, _ in rows}
    want = {(k, next((t for t in names if t != own[k] and (t in r or r in t)), None)) for k, rs in refs.items() for r in rs}
    for block in (1, 100):
        assert {tuple(r) for r in N.reference_links(texts, "k", "t", "own", titles, block).collect()} == {w for w in want if w[1]}


def test_conflicts_are_concepts_of_several_sources(spark):
    notes = spark.createDataFrame([(1, "Iron", ["Gate"]), (2, "Iron", ["Gate"]), (3, "Gate", []), (4, "Rose", None)], "note_id bigint, title string, headings array<string>")
    counts = {r.key: r.n_sources for r in C.concepts(notes).collect()}
    got = {(r.conflict_group, r.n_sources, r.key) for r in N.concept_conflicts(C.concepts(notes)).collect()}
    assert got == {(f"concept-pages-with-{n}-sources", n, k) for k, n in counts.items() if n >= 2} and ("concept-pages-with-2-sources", 2, "iron") in got
    assert "conflict_group" in vault.QUERIES["lint_conflicts"](spark, "/root/testdata/sf0.001").columns
